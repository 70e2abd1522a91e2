"""Shards by jump consistent hashing.

The shard of a row depends on its key and the number of shards alone; with one shard more, the share ``1 / (n + 1)`` of the rows
moves, all of it into the new shard. No table of a ring is kept. Slots number the rows of a shard from 0 without gaps: rows are
numbered within their task for each shard, and a small table of counts (tasks x shards) gives the offset of each task, so no
shard is ever gathered or sorted in one place.

Edge cases: a null key is a key like any other; rows with equal keys share their shard; null text has no bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.session import cut_lineage

_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard (0 to ``shards - 1``) of each unsigned 64-bit key: jumps ahead through the shard counts at which the key moves."""
    state = keys.astype(np.uint64).copy()
    at, ahead = np.zeros(len(state), dtype=np.int64), np.zeros(len(state), dtype=np.int64)
    open_ = np.arange(len(state))
    while len(open_):
        at[open_] = ahead[open_]
        state[open_] = state[open_] * _STEP + np.uint64(1)
        draw = ((state[open_] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[open_] = ((at[open_] + 1).astype(np.float64) * (float(1 << 31) / draw)).astype(np.int64)
        open_ = open_[ahead[open_] < shards]
    return at


def _assign(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, dtype=np.int64)
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            shard = jump_hash(keys, shards)
            order = np.argsort(shard, kind="stable")
            count = np.bincount(shard, minlength=shards)
            rank = np.empty(len(shard), dtype=np.int64)
            rank[order] = np.arange(len(shard)) - np.repeat(np.cumsum(count) - count, count)
            columns = {n: batch.column(n) for n in batch.schema.names if n != "key"}
            columns |= {"shard": pa.array(shard.astype(np.int32)), "grown_shard": pa.array(jump_hash(keys, shards + 1).astype(np.int32)),
                        "part": pa.array(np.full(len(shard), part, dtype=np.int32)), "rank": pa.array(rank + seen[shard])}
            seen += count
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    return run


def assign_shards(rows: DataFrame, key: Column, shards: int) -> DataFrame:
    """The rows with shard, grown_shard (with one more shard) and slot. Keep ``rows`` thin: they are written once."""
    names = [c for c in rows.columns]
    thin = rows.withColumn("__key", F.xxhash64(key)).toDF(*[f"c{k}" for k in range(len(names))], "key")
    schema = ", ".join(f"{n} {t}" for n, t in thin.dtypes[:-1])
    dealt = cut_lineage(thin.mapInArrow(_assign(shards), f"{schema}, shard int, grown_shard int, part int, rank long"))
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    out = dealt.join(offsets, ["shard", "part"])
    return out.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)], "shard", "grown_shard", (F.col("offset") + F.col("rank")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) under the law ``key``: id and shard count decide."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    thin = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign_shards(thin, F.col(id_col), shards)
    return out.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, folder: str, shards: int = 16, id_col: str = "doc_id") -> None:
    """All columns of the documents as Parquet under ``folder``/shard=K, without a shuffle; a column ``shard`` of their own is an error."""
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("the documents have a column named shard")

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy().view(np.uint64), shards).astype(np.int32))

    docs.withColumn("shard", shard(F.xxhash64(id_col))).write.partitionBy("shard").parquet(folder)
