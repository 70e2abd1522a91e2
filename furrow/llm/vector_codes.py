"""Compression of vectors into codes of their parts, by equal-average nearest-entry search.

Vectors are cut into ``parts`` equal parts; each part becomes the index of the nearest entry of its position's codebook. The
entries are sorted by the sum of their components. By the inequality of Cauchy and Schwarz the squared distance is at least the
squared difference of the sums over the dimension, so a search begins at the part's own sum, goes outward to the nearer sum each
time, and ends when that bound is strictly above the best distance. All is integer arithmetic, hence exact.

Plan: the kept integer vectors are written once; each round is one map pass with the codebooks in its closure (``entries`` x
dimension numbers), which gives sums for each entry of a task, one aggregation of those, and a collect of the same size.

Edge cases: vectors that are null or hold a null, NaN or infinite component are dropped. The first codebook are the vectors of the
``entries`` smallest ids (null ids last, among equal ids the smaller vector, repeated rows each count); fewer rows make smaller
codebooks. Null labels count as equal. An empty table gives an empty result. Vectors of different lengths, of a length that
``parts`` does not divide, or with a component beyond 2**17 in size (the sums would leave 64 bits) are an error. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.vectors import matrix, stepped, usable
from furrow.session import counted_cut, cut_lineage

LARGEST = 1 << 27


class Codebook:
    """Entries of one part position, also in order of their sums (equal sums by index)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.order = np.argsort(entries.sum(axis=1), kind="stable")
        self.sorted = entries[self.order]
        self.sums = self.sorted.sum(axis=1)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of the nearest entry (the lower one of equals) and squared distance of each part, and the distances computed."""
        total, size, n = parts.sum(axis=1), parts.shape[1], len(self.sums)
        best = np.full(len(parts), np.iinfo(np.int64).max)
        found = np.full(len(parts), n)
        work = np.arange(len(parts))
        above = np.searchsorted(self.sums, total)
        below = above - 1
        far = np.int64(1) << 31  # beyond any difference of sums whose square fits
        edge = np.concatenate([self.sums, [0]])
        seen = 0
        while len(work):
            down = np.where(below >= 0, total - edge[below], far)
            up = np.where(above < n, edge[above] - total, far)
            gap = np.minimum(down, up)
            go = (gap < far) & (gap * gap // max(size, 1) <= best[work])  # floor: no entry at the bound is missed
            work, total, below, above, down, up = (x[go] for x in (work, total, below, above, down, up))
            lower = down <= up
            entry = np.where(lower, below, above)
            below, above = below - lower, above + ~lower
            step = parts[work] - self.sorted[entry]
            distance = np.einsum("ij,ij->i", step, step)
            index = self.order[entry]
            better = (distance < best[work]) | ((distance == best[work]) & (index < found[work]))
            best[work[better]], found[work[better]] = distance[better], index[better]
            seen += len(work)
        return found, best, seen


@dataclass(frozen=True)
class Codes:
    """``rows``: id, label, code, error; ``books``: the final entries, (part, entry, position)."""

    rows: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        return sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _split(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    vectors = matrix(batch.column("v"))
    return vectors.reshape(len(vectors), parts, -1)


def _sums(books: list[Codebook]):
    """Number and component sums of the parts of each entry, one row for each component, once for each task."""
    count, size = len(books[0].entries), books[0].entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.zeros((len(books), count), dtype=np.int64)
        sums = np.zeros((len(books), count, size), dtype=np.int64)
        for batch in batches:
            vectors = _split(batch, len(books))
            for part, book in enumerate(books):
                found, _, _ = book.nearest(vectors[:, part])
                number[part] += np.bincount(found, minlength=count)
                np.add.at(sums[part], found, vectors[:, part])
        part, entry, at = np.nonzero(np.broadcast_to(number[:, :, None] > 0, sums.shape))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(at.astype(np.int32)),
             pa.array(number[part, entry]), pa.array(sums[part, entry, at])], ["part", "entry", "at", "n", "total"])
    return run


def _codes(books: list[Codebook]):
    digits = np.array([f"{k:02x}" for k in range(len(books[0].entries))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _split(batch, len(books))
            code, error = np.full(len(vectors), "", dtype="U1"), np.zeros(len(vectors), dtype=np.int64)
            for part, book in enumerate(books):
                found, distance, _ = book.nearest(vectors[:, part])
                code, error = np.char.add(code, digits[found]), error + distance
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code.tolist(), pa.string()),
                                              pa.array(error)], ["id", "label", "code", "error"])
    return run


def encode_vectors(frame: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codes:
    """Codebooks after ``rounds`` rounds over all rows, and the code and squared error of every kept row."""
    kept, count = counted_cut(frame.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                                           F.col(vector_col).alias("v")).where(usable(F.col("v")))
                              .withColumn("v", stepped(F.col("v"), scale)))
    if not count:
        none = kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return Codes(none, np.zeros((parts, 0, 0), dtype=np.int64))
    size = F.size("v")
    least, most, far = kept.agg(F.min(size), F.max(size), F.max(F.greatest(
        F.abs(F.coalesce(F.array_max("v"), F.lit(0))), F.abs(F.coalesce(F.array_min("v"), F.lit(0)))))).first()
    if least != most or most % parts or far >= LARGEST:
        raise ValueError(f"vectors of {least} to {most} components of up to {far / scale:g} in {parts} parts")
    first = kept.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()  # one codebook
    books = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = (kept.select("v").mapInArrow(_sums([Codebook(b) for b in books]), "part int, entry int, at int, n long, total long")
                .groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
        for r in sums.collect():  # one codebook
            books[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    rows = cut_lineage(kept.mapInArrow(_codes([Codebook(b) for b in books]),
                                       f"id {kinds['id']}, label {kinds['label']}, code string, error long"))
    return Codes(rows, books)


def with_label_error(codes: Codes, id_col: str = "vec_id") -> DataFrame:
    """id, code, error, label_error (errors summed over equal labels) and the codebooks' digest."""
    sums = cut_lineage(codes.rows.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "of")
    # the planner sends the sums where their file is small; a large table of labels is shuffled and hot labels are split
    return codes.rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
