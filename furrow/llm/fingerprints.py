"""Context-triggered piecewise fingerprints of texts.

A rolling hash over the last seven bytes ends a chunk where it meets a condition that depends on the block size; each chunk gives
one of 64 letters. The block size is the smallest ``3 * 2**k`` that promises at most 64 chunks, halved until there are at least
32 (or it is 3). A fingerprint is ``block size:letters:letters at twice the block size``. An edit changes the letters of the
chunks it touches only. Two fingerprints are compared at a block size that both have, by edit distance (insert and delete 1,
replace 2) over their letters with runs of one letter cut to three; they need a common run of four letters (half of a short one).

Everything up to the letters is NumPy over the bytes; the edit distance is bit-parallel, one step for each letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from furrow.llm.common import NO_ID
from furrow.llm.words import _BYTES, mix

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
LEAST, LENGTH, WINDOW, COMMON = 3, 64, 7, 4
_ROLL = [pow(0x01000193, k, 1 << 32) for k in range(WINDOW)]


def _rolled(data: np.ndarray) -> np.ndarray:
    """Hash of the last WINDOW bytes at every position (fewer at the start)."""
    out = np.zeros(len(data), dtype=np.uint32)
    value = data.astype(np.uint32) + np.uint32(1)
    for k, factor in enumerate(_ROLL[:len(data)]):
        out[k:] += value[:len(value) - k] * np.uint32(factor)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(13)
    return out


def _letters(ends: np.ndarray, total: np.ndarray, down: np.ndarray, most: int) -> bytes:
    """A letter for each chunk; beyond ``most`` the rest is one chunk."""
    size = len(total) - 1
    ends = ends[:most - 1]
    if not len(ends) or ends[-1] != size:
        ends = np.append(ends, size)
    begin = np.append(0, ends[:-1])
    return LETTERS[(mix((total[ends] - total[begin]) * down[begin]) >> np.uint64(58)).astype(np.int64)].tobytes()


def fingerprint(text: bytes) -> str:
    """Fingerprint of UTF-8 bytes; the empty text has ``3::``."""
    data = np.frombuffer(text, dtype=np.uint8)
    if not len(data):
        return f"{LEAST}::"
    rolled = _rolled(data)
    up, down = _BYTES.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    block = LEAST
    while block * LENGTH < len(data):
        block *= 2
    # every boundary of a block size is one of the halved size: look once for four halvings, then among the found
    least = block
    while True:
        if block == least:
            least = max(LEAST, block // 16)  # both are 3 * 2**k
            near = np.flatnonzero(rolled % np.uint32(least) == np.uint32(least - 1))
        ends = near[rolled[near] % np.uint32(block) == np.uint32(block - 1)] + 1
        if len(ends) >= LENGTH // 2 - 1 or block <= LEAST:
            break
        block //= 2
    double = ends[rolled[ends - 1] % np.uint32(2 * block) == np.uint32(2 * block - 1)]
    return f"{block}:{_letters(ends, total, down, LENGTH).decode()}:{_letters(double, total, down, LENGTH // 2).decode()}"


def _short_runs(letters: str) -> str:
    return "".join(c for k, c in enumerate(letters) if k < 3 or not c == letters[k - 1] == letters[k - 2] == letters[k - 3])


def _near(a: str, b: str) -> float:
    """1 minus the edit distance over the lengths' sum, 0 without a common run."""
    a, b = _short_runs(a), _short_runs(b)
    if not a or not b:
        return float(a == b)
    run = min(COMMON, max(1, min(len(a), len(b)) // 2))
    grams = {a[k:k + run] for k in range(len(a) - run + 1)}
    if not any(b[k:k + run] in grams for k in range(len(b) - run + 1)):
        return 0.0
    # longest common subsequence, a bit for each letter of a; distance = len(a) + len(b) - 2 * length
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def likeness(one: str, two: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 for block sizes that do not meet."""
    if one == two:
        return 1.0
    a, a1, a2 = one.split(":")
    b, b1, b2 = two.split(":")
    a, b = int(a), int(b)
    if a == b:
        return max(_near(a1, b1), _near(a2, b2) if a1 and b1 and len(a2) > COMMON and len(b2) > COMMON else 0.0)
    if a == 2 * b:
        return _near(a1, b2)
    if b == 2 * a:
        return _near(a2, b1)
    return 0.0


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, pa.array(prints, pa.string())],
                                         [*(n for n in batch.schema.names if n != "text"), "fingerprint"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row, in one map pass."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(_prints, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, text, bucket, extra): rows in id ranges, each sorted, and with the first row of the next range as an extra at its end.

    The ranges come from quantiles of the ids alone, so only one pass shuffles texts; the extras are one row for each range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("rid"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("rid", [k / parts for k in range(1, parts)] or [0.5], 100 * parts).alias("c")).first()["c"]
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<long>")
    first = rows.groupBy(F.size(F.filter(bounds, lambda c: c <= F.col("rid"))).alias("bucket")).agg(F.min("rid").alias("rid"))
    starts = [(r["bucket"], r["rid"]) for r in first.collect()]  # one row for each range
    starts.sort()
    before = {rid: starts[k - 1][0] for k, (_, rid) in enumerate(starts) if k}
    # after the last row comes the first
    if starts:
        before[starts[0][1]] = starts[-1][0]
    place = F.size(F.filter(bounds, lambda c: c <= F.col("rid")))
    marks = spark.createDataFrame([Row(rid=k, to=v) for k, v in before.items()] or [], "rid long, to int")
    own = rows.join(F.broadcast(marks), "rid", "left").select("rid", "text", F.explode(F.when(
        F.col("to").isNull(), F.array(F.struct(place.alias("bucket"), F.lit(0).alias("extra")))).otherwise(
        F.array(F.struct(place.alias("bucket"), F.lit(0).alias("extra")), F.struct(F.col("to").alias("bucket"), F.lit(1).alias("extra"))))).alias("p"))
    return own.select("rid", "text", "p.bucket", "p.extra").repartition(parts, "bucket").sortWithinPartitions(
        "bucket", "extra", "rid", "text")


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the following text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n] if n else text


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row that is no extra, with the row after it in its bucket."""
    names = ["rid", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    out: list[tuple] = []
    size = 0
    held = None

    def record(rid, text, mark, after, after_mark):
        edited = edit(text, after)
        edited_mark = mark if edited == text else fingerprint(edited.encode())
        return rid, len(text), edited, mark, edited_mark, likeness(mark, edited_mark), likeness(mark, after_mark)

    for batch in batches:
        for rid, text, bucket, extra in zip(*(batch.column(c).to_pylist() for c in ("rid", "text", "bucket", "extra")), strict=True):
            if held and held[2] == bucket and not held[3]:
                mark = fingerprint(text.encode())
                out.append(record(held[0], held[1], held[4], text, mark))
                size += len(text)
            elif not extra:
                mark = fingerprint(text.encode())
            held = (rid, text, bucket, extra, mark if not extra else "")
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_chars, the edited text, both fingerprints, likeness to the edited text and to the next document.

    The next document follows in the order of id, then text; null ids come last; after the last comes the first (a single row
    is its own next one). Null text is empty; an empty text is its own edited text. Rows that repeat follow each other.
    """
    ordered = in_order(docs, id_col, text_col)
    out = ordered.mapInArrow(_with_next, "rid long, n_chars long, edited string, fingerprint string, edited_fingerprint string, "
                                         "near_edited double, near_next double")
    return out.select(F.when(F.col("rid") != NO_ID, F.col("rid")).alias(id_col), "n_chars", "edited", "fingerprint",
                      "edited_fingerprint", "near_edited", "near_next")
