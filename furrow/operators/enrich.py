"""Bronze to gold: staging casts, current versions, environment lookup, value rules, mart projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.cleaning import classify, lookup_key, within
from furrow.schema import (
    ENVIRONMENTS, LOCATION_ENV_TYPE, MART_COLS, SCORE_RANGE, SCORES, SOIL_TYPE_RULES, TARGET, TRIAL_TYPE_RULES,
    UNKNOWN, YIELD_RANGE,
)


def location_env_type(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Location lookup: a CSV file when given, else the built-in table."""
    schema = "location string, env_type string"
    if path:
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.createDataFrame(LOCATION_ENV_TYPE, schema)


def stage_trials(history: DataFrame) -> DataFrame:
    """Versioned rows with loader columns renamed and keys cast."""
    names = {"record_id": "business_key", "source_file": "source_file_name", "source_row": "source_row_number"}
    casts = {c: F.col(c).cast("long") for c in ("source_row_number", "plot", "year")}
    return history.drop("row_hash").withColumnsRenamed(names).withColumns(casts)


def stage_quarantine(quarantine: DataFrame) -> DataFrame:
    names = {"row_id": "business_key", "source_file": "source_file_name", "source_row": "source_row_number"}
    return (quarantine.withColumnsRenamed(names)
            .withColumn("source_row_number", F.col("source_row_number").cast("long")))


def current_versions(staged: DataFrame) -> DataFrame:
    return staged.where(F.col("valid_to").isNull())


def with_environment(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Left join on the normalised location; no match gives UNKNOWN.

    No broadcast hint: Spark broadcasts the lookup while its measured size allows and splits a hot location otherwise.
    """
    keyed = lookup.select(lookup_key(F.col("location")).alias("__key"), F.col("env_type").alias("__env"))
    return (df.join(keyed, lookup_key(F.col("location")) == F.col("__key"), "left")
            .withColumn("env_type", F.coalesce("__env", F.lit(UNKNOWN)))
            .drop("__key", "__env"))


def with_value_rules(df: DataFrame) -> DataFrame:
    """Limit the scores and the yield to their ranges, derive trial and soil type from the experiment name."""
    scores = {c: within(F.col(c), *SCORE_RANGE) for c in SCORES if c in df.columns}
    experiment = F.col("experiment_name")
    return df.withColumns({
        **scores,
        "yield": within(F.coalesce("finalyield", "yield_total_t_ha"), *YIELD_RANGE),
        "trial_type": classify(experiment, TRIAL_TYPE_RULES),
        "soil_type": classify(experiment, SOIL_TYPE_RULES),
    })


def current_trials(history: DataFrame, lookup: DataFrame) -> DataFrame:
    return with_value_rules(with_environment(current_versions(stage_trials(history)), lookup))


def analysis_mart(current: DataFrame) -> DataFrame:
    """Scored rows of known environments, in mart column order."""
    return (current.where(F.col(TARGET).isNotNull() & F.col("env_type").isin(*ENVIRONMENTS))
            .select(*MART_COLS))
