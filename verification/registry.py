"""Registration of queries and assembly of their SQL counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow import fixtures
from furrow.operators.enrich import analysis_mart, current_trials
from furrow.operators.profile import with_missing_band
from furrow.schema import MART_COLS, NUMERIC, SCORES
from furrow.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6

_NAMES = {t: t for t in fixtures.TABLES}

# Common table expressions in dependency order.
CTES = {
    "trials": fixtures.TRIALS.format(**_NAMES),
    "env": fixtures.ENV_LOOKUP.format(**_NAMES),
    "dirty": fixtures.DIRTY.format(trials="trials"),
    "history": fixtures.HISTORY.format(trials="trials"),
    "snapshot": fixtures.SNAPSHOT.format(trials="trials"),
    "raw_names": fixtures.RAW_NAMES.format(**_NAMES),
    "current": "SELECT h.name1, CAST(h.year AS BIGINT) AS year, h.location, h.experiment_name, "
               "CAST(h.plot AS BIGINT) AS plot, coalesce(e.env_type, 'UNKNOWN') AS env_type, "
               "CASE WHEN lower(h.experiment_name) LIKE '%process%' THEN 'PROCESS' "
               "WHEN lower(h.experiment_name) LIKE '%ware%' THEN 'WARE' ELSE 'UNKNOWN' END AS trial_type, "
               "CASE WHEN lower(h.experiment_name) LIKE '%clay%' THEN 'CLAY' "
               "WHEN lower(h.experiment_name) LIKE '%sand%' THEN 'SAND' ELSE 'UNKNOWN' END AS soil_type, "
               + ", ".join(f"CASE WHEN h.{c} < 0 OR h.{c} > 9 THEN NULL ELSE h.{c} END AS {c}" for c in SCORES)
               + ", CASE WHEN coalesce(h.finalyield, h.yield_total_t_ha) < 0 "
                 "OR coalesce(h.finalyield, h.yield_total_t_ha) > 250 THEN NULL "
                 "ELSE coalesce(h.finalyield, h.yield_total_t_ha) END AS yield, "
                 "h.record_id AS business_key, h.source_file AS source_file_name, "
                 "CAST(h.source_row AS BIGINT) AS source_row_number "
                 "FROM history h LEFT JOIN env e ON lower(trim(h.location)) = lower(trim(e.location)) "
                 "WHERE h.valid_to IS NULL",
    "mart": f"SELECT {', '.join(MART_COLS)} FROM current WHERE o_a_score IS NOT NULL AND env_type IN ('MED', 'NE')",
    "known": f"SELECT {', '.join(MART_COLS)} FROM current WHERE env_type IN ('MED', 'NE')",
    "banded": "SELECT *, CASE WHEN f = 0 THEN 'complete' WHEN f <= 0.5 THEN 'medium' ELSE 'incomplete' END AS band FROM "
              "(SELECT *, (" + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in NUMERIC)
              + ") / 11.0::DOUBLE AS f FROM known)",
    "predictions": "SELECT 'trait' AS model, CAST(year % 5 AS INT) AS fold, name1, env_type, o_a_score AS y_true, "
                   "coalesce(appearance, 4.5) AS y_pred, band AS missing_band FROM banded",
}
NEEDS = {
    "trials": [], "env": [], "dirty": ["trials"], "history": ["trials"], "snapshot": ["trials"], "raw_names": [],
    "current": ["history", "env"], "mart": ["current"], "known": ["current"], "banded": ["known"],
    "predictions": ["banded"],
}


def assemble(body: str, uses: list[str], doubles: list[str] | None = None, extra: dict[str, str] | None = None,
             recursive: bool = False) -> str:
    """WITH clause of the used relations, then the body with its double columns rounded."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS[name]:
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in uses:
        add(name)
    parts = [f"{name} AS ({CTES[name].strip()})" for name in wanted]
    parts += [f"{name} AS ({text.strip()})" for name, text in (extra or {}).items()]
    if doubles:
        rounded = ", ".join(f"round({c}, {DIGITS}) + 0.0::DOUBLE AS {c}" for c in doubles)
        body = f"SELECT * REPLACE ({rounded}) FROM ({body})"
    with_clause = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} " if parts else ""
    return with_clause + body


def rounded(df: DataFrame) -> DataFrame:
    """Round doubles: float sums depend on the order of the rows in the last digits."""
    return df.select(*[(F.round(f"`{n}`", DIGITS) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`")
                       for n, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# Relations the queries share, as DataFrames.

def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_trials(fixtures.history(spark, sf_dir), fixtures.env_lookup(spark, sf_dir))


def mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis_mart(current(spark, sf_dir))


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(spark, sf_dir).where(F.col("env_type").isin("MED", "NE")).select(*MART_COLS)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_missing_band(known(spark, sf_dir)).select(
        F.lit("trait").alias("model"), (F.col("year") % 5).cast("int").alias("fold"), "name1", "env_type",
        F.col("o_a_score").alias("y_true"), F.coalesce("appearance", F.lit(4.5)).alias("y_pred"),
        F.col("band").alias("missing_band"))


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, so that all executors see it."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/work-{uuid.uuid4().hex[:12]}"
