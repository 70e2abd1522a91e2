"""From drop folder to exported mart in one Spark application."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators import checks
from furrow.operators.enrich import analysis_mart, current_trials, location_env_type, stage_quarantine, stage_trials
from furrow.sources.tables import export_snapshot, materialise_table, materialise_view
from furrow.sources.versioned import VersionedStore
from furrow.streaming.folder import FileOutcome, stream_folder


@dataclass(frozen=True)
class MedallionRun:
    files: list[FileOutcome]
    checks: DataFrame
    snapshot: dict[str, Any]


def build(history: DataFrame, lookup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current view, mart) as lazy frames; Catalyst folds them into one scan, one lookup join and a projection."""
    current = current_trials(history, lookup)
    return current, analysis_mart(current)


def all_checks(staged: DataFrame, current: DataFrame, mart: DataFrame, lookup: DataFrame) -> DataFrame:
    """Every declared check with its relation and failure count."""
    from pyspark.sql import functions as F

    parts = [("stg_trials", staged, checks.STAGING_SUITE), ("int_trials_current", current, checks.CURRENT_SUITE),
             ("mart_overall_analysis", mart, checks.MART_SUITE), ("location_env_type", lookup, checks.LOOKUP_SUITE)]
    frames = [checks.run_suite(df, suite).withColumn("relation", F.lit(name)) for name, df, suite in parts]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def run(spark: SparkSession, incoming: str, archive: str, store_root: str, stream_checkpoint: str, out_folder: str,
        boundary: str, lookup: DataFrame | None = None) -> MedallionRun:
    """Ingest new files, build the relations, check them, export the mart."""
    store = VersionedStore(spark, store_root)
    outcomes = stream_folder(store, incoming, archive, stream_checkpoint, boundary)
    history = store.history()
    if history is None:
        raise ValueError("nothing has been loaded yet")
    lookup = location_env_type(spark) if lookup is None else lookup
    staged = stage_trials(history)
    current, mart = build(history, lookup)
    materialise_view(staged, "stg_trials")
    materialise_view(current, "int_trials_current")
    quarantine = store.quarantine()
    if quarantine is not None:
        materialise_view(stage_quarantine(quarantine), "stg_quarantine")
    relation = materialise_table(mart, "mart_overall_analysis")
    table = spark.table(relation)
    return MedallionRun(outcomes, all_checks(staged, current, table, lookup), export_snapshot(table, relation, out_folder))
