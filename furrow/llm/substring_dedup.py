"""Removal of repeated passages by super-k-mers.

Every window of ``width`` words has a minimiser: the least hash of the ``gram``-word runs inside it. Consecutive windows with
the same minimiser share most of their words, so they travel together as one packed string to the bucket of their minimiser;
equal windows have equal minimisers and meet there. Sorting the windows of a bucket by their 128-bit sequence hash puts equal
ones side by side with the smallest document first.

Plan: (1) one map pass sends (minimiser, id), pre-aggregated; a minimiser that only one document has cannot hold a repeat.
(2) A second pass sends the packed strings of the others to buckets of bounded size. A minimiser with more than ``hot`` super
-k-mers would overfill a bucket; its windows are aggregated one by one instead, with partial sums before the shuffle. (3) The
covered word ranges join the documents. Nothing is dropped or capped.

Edge cases: null text has no words. A null id counts as larger than all others (so it is never the one that keeps a passage
if another id has it). Rows of one id never remove each other's words. Rows with fewer than ``width`` words stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import NO_ID, Membership, keyed
from furrow.llm.words import Words, blocks, mix, slide_min
from furrow.session import counted_cut

_SECOND = 0xD6E8FEB86659FD93


def _windows(block: Words, width: int) -> np.ndarray:
    count = len(block.row) - width + 1
    return np.flatnonzero(block.row[:count] == block.row[width - 1:]) if count > 0 else np.zeros(0, dtype=np.int64)


def _super_kmers(block: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window (a word index), number of windows and minimiser of each super-k-mer of the block."""
    at = _windows(block, width)
    if not len(at):
        return at, at, at.astype(np.uint64)
    value = np.full(len(block.row), np.iinfo(np.uint64).max, dtype=np.uint64)
    where, hashes = block.grams(gram)
    value[where] = hashes
    least = slide_min(value[:len(value) - gram + 1], width - gram + 1)[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    return at[begin], np.diff(np.append(begin, len(at))), least[begin]


def _double_hash(block: Words, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    other = Words(block.raw, block.first, block.rows, block.start, block.end, block.row,
                  mix(block.hash, 5) * np.uint64(_SECOND))
    return mix(block._run(at, width)), mix(other._run(at, width), 9)


def _minimisers(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for block in blocks(batch.column("text")):
                first, _, least = _super_kmers(block, width, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least.view(np.int64)), pa.array(rid[block.first + block.row[first]])], ["m", "rid"])
    return run


def _pack(width: int, gram: int, live: Membership, hot: Membership | None):
    """Packed strings of the live super-k-mers; those of a hot minimiser are left to ``_single``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, sig = batch.column("rid").to_numpy(), batch.column("sig").to_numpy()
            for block in blocks(batch.column("text")):
                first, count, least = _super_kmers(block, width, gram)
                keep = live.has(least)
                if hot is not None:
                    keep &= ~hot.has(least)
                first, count, least = first[keep], count[keep], least[keep]
                row = block.row[first]
                begin = np.searchsorted(block.row, row)
                packed = [block.text(i, j) for i, j in zip(first.tolist(), (first + count + width - 1).tolist(), strict=True)]
                at = block.first + row
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least.view(np.int64)), pa.array(rid[at]), pa.array(sig[at]),
                     pa.array((first - begin).astype(np.int64)), pa.array(packed, pa.binary()).cast(pa.string())],
                    ["m", "rid", "sig", "at", "packed"])
    return run


def _ranges(rid, sig, at, row, width: int) -> pa.RecordBatch:
    """Covered word ranges from removed windows, given in order of (row, at): windows that follow each other become one range."""
    new = np.ones(len(at), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(at)) - 1 if len(at) else begin
    return pa.RecordBatch.from_arrays(
        [pa.array(rid[begin]), pa.array(sig[begin]), pa.array(at[begin]), pa.array(at[last] + width)], ["rid", "sig", "lo", "hi"])


def _sort_bucket(width: int):
    def run(bucket: pa.Table) -> pa.Table:
        rid, sig = bucket["rid"].to_numpy(), bucket["sig"].to_numpy()
        start = bucket["at"].to_numpy()
        one, two, row, at = [], [], [], []
        for block in blocks(bucket["packed"]):
            where = _windows(block, width)
            a, b = _double_hash(block, where, width)
            one.append(a)
            two.append(b)
            local = block.row[where]
            row.append(block.first + local)
            at.append(where - np.searchsorted(block.row, local))
        one, two, row, at = (np.concatenate(x) for x in (one, two, row, at))
        at = at + start[row]
        order = np.lexsort((rid[row], two, one))
        a, b, ids = one[order], two[order], rid[row][order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        least = ids[np.flatnonzero(new)[np.cumsum(new) - 1]]
        gone = np.zeros(len(order), dtype=bool)
        gone[order] = ids > least
        row, at = row[gone], at[gone]
        return pa.Table.from_batches([_ranges(rid[row], sig[row], at, row, width)])
    return run


def _single(width: int, gram: int, live: Membership, hot: Membership):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, sig = batch.column("rid").to_numpy(), batch.column("sig").to_numpy()
            for block in blocks(batch.column("text")):
                first, count, least = _super_kmers(block, width, gram)
                keep = live.has(least) & hot.has(least)
                at = np.repeat(first[keep] - np.append(0, np.cumsum(count[keep])[:-1]), count[keep]) + np.arange(count[keep].sum())
                a, b = _double_hash(block, at, width)
                row = block.row[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(rid[block.first + row]),
                     pa.array(sig[block.first + row]), pa.array((at - np.searchsorted(block.row, row)).astype(np.int64))],
                    ["one", "two", "rid", "sig", "at"])
    return run


def repeated_ranges(docs: DataFrame, width: int = 50, gram: int = 8, hot: int = 20_000) -> DataFrame:
    """(rid, sig, lo, hi): word ranges of ``keyed`` documents that a window covers which also starts under a smaller id."""
    spark = docs.sparkSession
    seen = docs.select("rid", "text").mapInArrow(_minimisers(width, gram), "m long, rid long")
    live, many = counted_cut(seen.groupBy("m").agg(F.min("rid").alias("low"), F.max("rid").alias("high"), F.count("*").alias("n"))
                             .where("low < high").select("m", "n"))
    members = Membership(live, "m", many)
    heavy = live.where(F.col("n") > hot)
    heavy_count, light = live.agg(F.count_if(F.col("n") > hot), F.coalesce(F.sum(F.when(F.col("n") <= hot, F.col("n"))), F.lit(0))).first()
    heavy_members = Membership(heavy, "m", heavy_count) if heavy_count else None
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-light // hot))
    found = (docs.mapInArrow(_pack(width, gram, members, heavy_members), "m long, rid long, sig long, at long, packed string")
             .withColumn("bucket", F.pmod(F.xxhash64("m"), F.lit(buckets))).groupBy("bucket")
             .applyInArrow(_sort_bucket(width), "rid long, sig long, lo long, hi long"))
    if heavy_members is not None:
        singles = docs.mapInArrow(_single(width, gram, members, heavy_members), "one long, two long, rid long, sig long, at long")
        least = singles.groupBy("one", "two").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).where("low < high")
        found = found.unionByName(singles.join(least, ["one", "two"]).where("rid > low")
                                  .select("rid", "sig", F.col("at").alias("lo"), (F.col("at") + width).alias("hi")))
    return found


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words_of, gone, kept = [], [], []
        for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
            words = text.as_py().encode().split()
            parts, at = [], 0
            for piece in sorted((r["lo"], r["hi"]) for r in ranges.as_py() or ()):
                if piece[0] > at:
                    parts.append(words[at:piece[0]])
                at = max(at, piece[1])
            parts.append(words[at:])
            left = [w for p in parts for w in p] if len(parts) > 1 else parts[0]
            words_of.append(len(words))
            gone.append(len(words) - len(left))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("sig"), pa.array(words_of, pa.int64()), pa.array(gone, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string())], ["rid", "sig", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, gram: int = 8,
                   hot: int = 20_000) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (the words left, joined by one space)."""
    rows = keyed(docs, id_col, text_col)
    ranges = repeated_ranges(rows, width, gram, hot).groupBy("rid", "sig").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    out = rows.join(ranges, ["rid", "sig"], "left").mapInArrow(
        _strip, "rid long, sig long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("rid") != NO_ID, F.col("rid")).alias(id_col), "n_words", "n_removed", "kept")
