"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "furrow", master: str | None = None, **conf) -> SparkSession:
    """Session with UTC, ANSI, AQE and Arrow on; extra settings override."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Shuffle files go when the query that made them ends; else they stay until the driver happens to collect its garbage.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

_OWNED: list[list[str]] = []


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share; there is no fallback to a machine's own folder."""
    sc = spark.sparkContext
    tidy(spark)
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def tidy(spark: SparkSession) -> None:
    """From now on the session's queries leave no shuffle files behind. A frame that is run twice makes its shuffles again."""
    for key, value in TIDY.items():
        spark.conf.set(key, value)


@contextmanager
def owned_cuts(spark: SparkSession) -> Iterator[None]:
    """Tables that lineage is cut with inside of the block are deleted at its end: use it around a job that writes its result."""
    _OWNED.append([])
    try:
        yield
    finally:
        for text in _OWNED.pop():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, outlive: bool = False) -> DataFrame:
    """Write the frame to the shared checkpoint folder and read it back.

    The result survives lost executors, is computed once (an eager checkpoint computes twice), and its file size is known
    to the planner.
    """
    return counted_cut(df, outlive)[0]


def counted_cut(df: DataFrame, outlive: bool = False) -> tuple[DataFrame, int]:
    """``cut_lineage`` with the row count, taken while writing. ``outlive``: the table belongs to the next outer scope."""
    spark, seen = df.sparkSession, Observation()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    owners = _OWNED[:-1] if outlive else _OWNED
    if owners:
        owners[-1].append(path)
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]


def order_buckets(spark: SparkSession) -> int:
    """How many value ranges a distributed ordering uses: follows the session's shuffle width."""
    return max(8, min(1024, int(spark.conf.get("spark.sql.shuffle.partitions"))))
