"""What the operators share: tables, ids, a bounded membership filter and components of a graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.session import counted_cut, cut_lineage

NO_ID = (1 << 63) - 1
BITMAP_SPAN = 32768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rid`` (a null id becomes the largest), ``sig`` (tells rows of one id with different texts apart), ``text``.

    Rows that agree in id and text agree in every result, so (rid, sig) is all an operator has to carry.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("rid"),
                       F.xxhash64(text).alias("sig"), text.alias("text"))


def fresh(name: str, columns: list[str]) -> str:
    """The name, with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch some rows at a time, so that few texts are Python objects at once."""
    for low in range(0, batch.num_rows, rows):
        yield batch.slice(low, rows)


class Membership:
    """A one-hash bitmap of a set of longs: no false negatives, and false positives only cost work.

    Size: ``per_key`` (8) to twice as many bits per key, at most ``most_bits`` (32 MB by default), so sending it to every task is safe at any input size;
    with more keys it fills up and lets more through. Built by a distributed aggregation of 4 KB pieces.
    """

    def __init__(self, keys: DataFrame, column: str, count: int, most_bits: int = 1 << 28, per_key: int = 8):
        bits = min(most_bits, max(1 << 17, 1 << (max(1, per_key * count) - 1).bit_length()))
        at = F.pmod(F.col(column), F.lit(bits)) + 1
        pieces = keys.groupBy(F.bitmap_bucket_number(at).alias("piece")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("map"))
        image = np.zeros(bits // 8, dtype=np.uint8)
        for row in pieces.toLocalIterator():
            low = (row["piece"] - 1) * BITMAP_SPAN // 8
            image[low:low + BITMAP_SPAN // 8] = np.frombuffer(row["map"], dtype=np.uint8)
        self.bits, self.image = bits, keys.sparkSession.sparkContext.broadcast(image)

    def __getstate__(self):
        return {"bits": self.bits, "image": self.image}

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Of unsigned 64-bit hashes, whose signed value was a key."""
        at = hashes & np.uint64(self.bits - 1)
        return (self.image.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of an undirected graph (nodes of any type with an order): component is the smallest node of its connected part.

    Every node joins its neighbour of least hash (or itself), twice over; the edges are carried to the joined nodes and
    repeats go. A hash order makes chains of any order of ids shrink by a share in each round. Each round is written to the
    shared checkpoint folder; nodes with many edges are pre-aggregated before the shuffle and never meet in one list.
    """
    def key(c: str):
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))

    rest, count = counted_cut(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a != b").distinct())
    steps = []
    while count:
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(key("b")).alias("m")).select(
            F.col("a").alias("node"), F.least("m", key("a"))["v"].alias("to"))
        first = cut_lineage(first)
        again = first.select(F.col("node").alias("to"), F.col("to").alias("far"))
        step = cut_lineage(first.join(again, "to").select("node", F.col("far").alias("to")))
        steps.append(step)
        ends = step.select(F.col("node").alias("a"), F.col("to").alias("pa"))
        rest, count = counted_cut(
            rest.join(ends, "a").join(ends.select(F.col("a").alias("b"), F.col("pa").alias("pb")), "b")
            .where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not steps:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    root = steps[0].select("node", F.col("to").alias("root"))
    for step in steps[1:]:
        root = root.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root"))
    root = cut_lineage(root)
    least = root.groupBy("root").agg(F.min("node").alias("component"))
    return root.join(least, "root").select("node", "component")
