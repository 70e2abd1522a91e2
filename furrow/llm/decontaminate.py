"""Benchmark decontamination by greedy string tiling.

Words are compared without case (A-Z) and ASCII punctuation. A test item is covered by *tiles*: the longest runs of words that
the item and the document share, taken greedily, longest first, without overlap, each of at least ``seed`` words. Because tiles
may come in any order, a reordered passage is covered too. A document is contaminated by an item whose covered share of words
reaches ``threshold``.

Plan: (1) a bitmap of the items' seeds (Karp-Rabin hashes of ``seed`` words) goes to the map tasks, which keep the runs of
document words whose seeds all occur in some item: every tile lies in such a run, so texts are never shuffled. (2) Seeds join
items by hash. A covered item has at least ``ceil(threshold * words / seed)`` matched seed positions, so that many less one of its
positions, those most frequent in documents, are left out of this join without loss. (3) Candidates are tiled one by one.

Edge cases: null text has no words; items with fewer than ``seed`` words cannot be covered; repeated item rows give one result
row each; null ids are carried as null; documents of one id are judged separately.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import NO_ID, Membership, keyed
from furrow.llm.words import blocks
from furrow.session import counted_cut, cut_lineage


def _lists(values: np.ndarray, sizes) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.view(np.int64)))


def _item_words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), plain=True):
                at, hashes = block.grams(seed)
                seeds = np.bincount(block.row[at], minlength=block.rows) if len(at) else np.zeros(block.rows, dtype=int)
                keys = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [keys.column("iid"), _lists(block.hash, np.diff(block.bounds())), _lists(hashes, seeds)],
                    ["iid", "words", "seeds"])
    return run


def _runs(seed: int, wanted: Membership):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, sig = batch.column("rid").to_numpy(), batch.column("sig").to_numpy()
            for block in blocks(batch.column("text"), plain=True):
                at, hashes = block.grams(seed)
                hit = wanted.has(hashes)
                at, hashes = at[hit], hashes[hit]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (block.row[at[1:]] != block.row[at[:-1]])
                begin = np.flatnonzero(new)
                seeds = np.diff(np.append(begin, len(at)))
                first, size = at[begin], seeds + seed - 1
                words = np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                row = block.row[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[block.first + row]), pa.array(sig[block.first + row]),
                     pa.array((first - np.searchsorted(block.row, row)).astype(np.int64)),
                     _lists(block.hash[words.astype(np.int64)], size), _lists(hashes, seeds)], ["rid", "sig", "at", "words", "seeds"])
    return run


def tile(item: list[int], runs: list[tuple[int, list[int]]], seed: int) -> list[tuple[int, int, int]]:
    """Tiles (item start, document start, length), in the order in which they were taken."""
    words = {}
    for start, run in runs:
        words.update(enumerate(run, start))
    free = [True] * len(item)
    taken: set[int] = set()
    tiles = []
    table: dict[tuple, list[int]] = {}
    for start, run in runs:
        for k in range(len(run) - seed + 1):
            table.setdefault(tuple(run[k:k + seed]), []).append(start + k)
    starts = [table.get(tuple(item[i:i + seed]), ()) for i in range(len(item) - seed + 1)]
    while True:
        longest, best = seed, []
        for i, places in enumerate(starts):
            for j in places:
                n = 0
                while i + n < len(item) and free[i + n] and j + n not in taken and words.get(j + n) == item[i + n]:
                    n += 1
                if n > longest:
                    longest, best = n, [(i, j)]
                elif n == longest:
                    best.append((i, j))
        if not best:
            return tiles
        for i, j in best:
            if all(free[i:i + longest]) and taken.isdisjoint(range(j, j + longest)):
                free[i:i + longest] = [False] * longest
                taken.update(range(j, j + longest))
                tiles.append((i, j, longest))


def _tiled(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles = [tile(words, [(r["at"], r["words"]) for r in runs], seed)
                     for words, runs in zip(batch.column("item").to_pylist(), batch.column("runs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("sig"), batch.column("iid"), batch.column("n_item_words"),
                 pa.array([sum(n for *_, n in t) for t in tiles], pa.int64()),
                 pa.array([[{"item_at": i, "doc_at": j, "n_words": n} for i, j, n in t] for t in tiles],
                          pa.list_(pa.struct([("item_at", pa.int64()), ("doc_at", pa.int64()), ("n_words", pa.int64())])))],
                ["rid", "sig", "iid", "n_item_words", "n_covered", "tiles"])
    return run


def coverage(docs: DataFrame, items: DataFrame, seed: int, threshold: float) -> DataFrame:
    """(rid, sig, iid, n_item_words, n_covered, tiles) of ``keyed`` documents and items (iid, text) with enough coverage."""
    tests = cut_lineage(items.select("iid", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _item_words(seed), "iid string, words array<long>, seeds array<long>"))
    places = tests.select("iid", F.size("words").alias("n"), F.posexplode("seeds").alias("pos", "seed"))
    distinct, many = counted_cut(places.select("seed").distinct())
    wanted = Membership(distinct, "seed", many)
    runs = cut_lineage(docs.mapInArrow(_runs(seed, wanted), "rid long, sig long, at long, words array<long>, seeds array<long>"))
    hits = runs.select("rid", "sig", F.explode("seeds").alias("seed")).distinct()
    often = hits.groupBy("seed").agg(F.count("*").alias("often"))
    spare = F.ceil(F.col("n") * threshold / seed) - 1
    rare = places.join(often, "seed").withColumn("rank", F.row_number().over(
        Window.partitionBy("iid").orderBy(F.desc("often"), "pos"))).where(F.col("rank") > spare).select("seed", "iid").distinct()
    pairs = hits.join(rare, "seed").select("rid", "sig", "iid").distinct()
    per_doc = runs.groupBy("rid", "sig").agg(F.collect_set(F.struct("at", "words")).alias("runs"))
    whole = tests.select("iid", F.col("words").alias("item"), F.size("words").cast("long").alias("n_item_words"))
    tiled = pairs.join(per_doc, ["rid", "sig"]).join(whole, "iid").select("rid", "sig", "iid", "item", "n_item_words", "runs").mapInArrow(
        _tiled(seed), "rid long, sig long, iid string, n_item_words long, n_covered long, "
                      "tiles array<struct<item_at: long, doc_at: long, n_words: long>>")
    return tiled.where(F.col("n_covered") >= threshold * F.col("n_item_words"))


def _named(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # items that repeat id and text are one; items that share an id only are told apart by their text
    return items.select(F.col(item_col).alias("item_id"), text.alias("text"),
                        F.concat_ws(":", F.coalesce(F.col(item_col).cast("string"), F.lit("null")), F.sha1(text)).alias("iid"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", seed: int = 4, threshold: float = 0.5) -> DataFrame:
    """One row per document and item that covers it: ids, n_item_words, n_covered, coverage, tiles."""
    named = _named(items, item_col, item_text_col)
    rows = keyed(docs, id_col, text_col)
    found = coverage(rows, named.select("iid", "text").distinct(), seed, threshold)
    found = found.join(named.select("iid", "item_id"), "iid")
    return found.select(F.when(F.col("rid") != NO_ID, F.col("rid")).alias(id_col), F.col("item_id"), "n_item_words", "n_covered",
                        (F.col("n_covered") / F.col("n_item_words")).alias("coverage"), "tiles")


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         item_col: str = "item_id", item_text_col: str = "text", seed: int = 4, threshold: float = 0.5) -> DataFrame:
    """The documents, all their columns, that no item contaminates."""
    named = _named(items, item_col, item_text_col).select("iid", "text").distinct()
    bad = coverage(keyed(docs, id_col, text_col), named, seed, threshold).select("rid", "sig").distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    match = (F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)) == bad["rid"]) & (F.xxhash64(text) == bad["sig"])
    return docs.join(bad, match, "left_anti")
