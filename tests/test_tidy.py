"""What written tables and loads leave on disk, and when it goes."""

from pathlib import Path

from pyspark.sql import functions as F

from furrow.schema import MERGE_KEY
from furrow.session import cut_lineage, ensure_checkpoint_dir
from furrow.sources.versioned import VersionedStore


def _shuffles(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {str(f) for d in dirs for f in Path(d).rglob("shuffle_*")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = _shuffles(spark)
    rows = cut_lineage(spark.range(10_000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n")))
    assert rows.agg(F.sum("n")).first()[0] == 10_000
    assert _shuffles(spark) <= before


def _store_and_tables(spark, tmp_path, monkeypatch):
    """A store, and how many tables stood beside it when each of its tables was written."""
    store, seen = VersionedStore(spark, str(tmp_path / "store")), {}
    plain, folder = VersionedStore._write, Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    at_start = set(folder.glob("cut-*"))

    def counting(self, df, name, *rest, **more):
        seen.setdefault(name, []).append(len(set(folder.glob("cut-*")) - at_start))
        return plain(self, df, name, *rest, **more)

    monkeypatch.setattr(VersionedStore, "_write", counting)
    return store, seen


def _rows(spark, shift, file):
    keys = [F.lit(2000).cast("long").alias("year") if c == "year" else F.col("id").alias(c) if c == "plot" else F.lit("x").alias(c) for c in MERGE_KEY]
    return spark.range(50).select(*keys, (F.col("id") + shift).cast("double").alias("o_a_score"), F.lit(file).alias("source_file"), F.lit(2).cast("long").alias("source_row"))


def _nothing(rows):
    return rows.where(F.lit(False)).select("source_file", "source_row", F.lit("").alias("error_message"))


def test_a_load_drops_its_batch_before_it_deals_the_versions(spark, tmp_path, monkeypatch):
    store, seen = _store_and_tables(spark, tmp_path, monkeypatch)
    for k in range(2):
        rows = _rows(spark, k, "a.csv")
        result = store.load(rows, _nothing(rows), f"load-{k}", f"2024-01-0{k + 1} 00:00:00")
        assert (result.n_opened, result.n_closed) == (50, 50 * k)
    assert seen["versions"] == [1, 1]
    assert store.active().count() == 50 and store.history().count() == 100


def test_many_deliveries_drop_what_came_before_they_deal_the_versions(spark, tmp_path, monkeypatch):
    store, seen = _store_and_tables(spark, tmp_path, monkeypatch)
    rows = _rows(spark, 0, "0.csv").unionByName(_rows(spark, 1, "1.csv"))
    results = store.load_many(rows, _nothing(rows), [("a", "0.csv"), ("b", "1.csv")], "2024-01-01 00:00:00", "both")
    assert [(r.n_opened, r.n_closed) for r in results] == [(50, 0), (50, 50)]
    assert seen["versions"] == [2]  # what opens, and the events
