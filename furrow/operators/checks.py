"""Declarative data checks: all row-wise checks of a suite run in one pass, each uniqueness check is one aggregation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.schema import MERGE_KEY, SCORE_RANGE, SCORES, UNKNOWN, YIELD_RANGE


@dataclass(frozen=True)
class Suite:
    not_null: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    accepted: dict[str, list[str]] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)


# The declared checks of every relation.
STAGING_SUITE = Suite(not_null=["year", "name1", "experiment_name", "plot", "location", "business_key",
                                "source_file_name", "source_row_number"])
QUARANTINE_SUITE = Suite(not_null=["error_message", "source_file_name", "source_row_number", "business_key"])
CURRENT_SUITE = Suite(
    not_null=["year", "name1", "experiment_name", "plot", "location", "business_key", "env_type", "trial_type",
              "soil_type"],
    unique=[MERGE_KEY],
    accepted={"env_type": ["MED", "NE", UNKNOWN], "trial_type": ["PROCESS", "WARE", UNKNOWN],
              "soil_type": ["SAND", "CLAY", UNKNOWN]},
    ranges={**{c: SCORE_RANGE for c in SCORES}, "yield": YIELD_RANGE},
)
MART_SUITE = Suite(not_null=["o_a_score", "env_type"], unique=[MERGE_KEY], accepted={"env_type": ["MED", "NE"]})
LOOKUP_SUITE = Suite(not_null=["location", "env_type"], unique=[["location"]],
                     accepted={"env_type": ["MED", "NE"]})


def _violations(suite: Suite) -> list[tuple[str, str, Column]]:
    rows = [("not_null", c, F.col(c).isNull()) for c in suite.not_null]
    rows += [("accepted_values", c, ~F.col(c).isin(*values)) for c, values in suite.accepted.items()]
    rows += [("accepted_range", c, (F.col(c) < low) | (F.col(c) > high))
             for c, (low, high) in suite.ranges.items()]
    return rows


def row_checks(df: DataFrame, suite: Suite) -> DataFrame:
    """(check, column, failures) of the not-null, accepted-values and range checks, in one aggregation."""
    checks = _violations(suite)
    counted = df.agg(*[F.count_if(broken).alias(f"f{i}") for i, (_, _, broken) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(check).alias("check"), F.lit(column).alias("column"),
                              F.col(f"f{i}").alias("failures")) for i, (check, column, _) in enumerate(checks)])
    return counted.select(F.inline(rows))


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Non-null key combinations that occur more than once."""
    present = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in key)) if len(key) == 1 else df
    return present.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def run_suite(df: DataFrame, suite: Suite) -> DataFrame:
    """All checks of a suite as (check, column, failures)."""
    results = row_checks(df, suite) if _violations(suite) else None
    for key in suite.unique:
        found = repeated_keys(df, key).agg(F.count("*").alias("failures")).select(
            F.lit("unique").alias("check"), F.lit(",".join(key)).alias("column"), "failures")
        results = found if results is None else results.unionByName(found)
    return results


def reconcile_keys(current: DataFrame, history: DataFrame, key: list[str] = MERGE_KEY) -> DataFrame:
    """Rows of the current view against distinct current keys of the history."""
    rows = current.agg(F.count("*").alias("current_rows"))
    keys = (history.where("valid_to is null").select(*key).distinct()
            .agg(F.count("*").alias("distinct_keys")))
    return (rows.select("current_rows", F.lit(None).cast("long").alias("distinct_keys"))
            .unionByName(keys.select(F.lit(None).cast("long").alias("current_rows"), "distinct_keys"))
            .agg(F.max("current_rows").alias("current_rows"), F.max("distinct_keys").alias("distinct_keys"))
            .withColumn("equal", F.col("current_rows") == F.col("distinct_keys")))


def unmapped_locations(current: DataFrame) -> DataFrame:
    """Locations without a known environment and how many rows they hold."""
    return (current.where(F.col("env_type") == UNKNOWN)
            .groupBy("location").agg(F.count("*").alias("n_rows")))
