"""Quality scores by compression.

Two zstandard dictionaries hold labelled text, good and bad. A text that resembles one of them compresses better with it; the
difference of the two compressed sizes over the text's size is the raw value, and a logistic curve fitted on labelled rows that
are in neither dictionary makes it a score. The curve also has the text's brevity, because the difference tells little of a text
of a few words.

A text is compressed as consecutive pieces of ``PIECE`` bytes, each by itself and none left out, and the sizes are added up. In one
frame a long text would find its matches in itself rather than in the dictionaries, and its value would fall to 0 with its length.

The dictionaries are a bounded sample (``dictionary_bytes`` a class), chosen by a hash of the id and put together in one task; the
curve is fitted on the values of ``calibration_rows`` texts of any length, which are scored where they are. The model has a few
megabytes and every text is scored whole in one map pass.

Edge cases: null text is empty; an empty text has the raw value 0 and thus the score of the curve there; without labelled rows
of both classes the score is the share of good rows, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import slices
from furrow.session import cut_lineage

_SMOOTH = 20  # bytes added to the size in the ratio, so that a few bytes' difference of a tiny text weighs little
PIECE = 4096  # bytes compressed at a time


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries, level and the curve ``1 / (1 + exp(-(slope * value + intercept + brevity * short)))``."""

    good: bytes
    bad: bytes
    level: int
    slope: float = 0.0
    intercept: float = 0.0
    brevity: float = 0.0

    def scorer(self):
        """Raw value of a text (bytes)."""
        if not self.good or not self.bad:
            return lambda text: 0.0
        made = []
        for data in (self.good, self.bad):
            known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=self.level)
            made.append(zstandard.ZstdCompressor(level=self.level, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))
        good, bad = (x.compress for x in made)

        def value(text: bytes) -> float:
            pieces = (text[k:k + PIECE] for k in range(0, len(text), PIECE))
            return sum(len(bad(x)) - len(good(x)) for x in pieces) / (len(text) + _SMOOTH)

        return value

    def curve(self, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores from raw values and sizes in bytes."""
        return 1 / (1 + np.exp(-np.clip(self.slope * values + self.intercept + self.brevity * short(sizes), -500, 500)))


def short(sizes: np.ndarray) -> np.ndarray:
    """1 for the empty text, near 0 for a long one."""
    return 40 / (40 + sizes)


def fit_curve(values: np.ndarray, sizes: np.ndarray, good: np.ndarray, rounds: int = 100) -> tuple[float, float, float]:
    """Slope, intercept and brevity of the logistic curve by damped Newton steps, with targets drawn in by one row of each class."""
    n1, n0 = good.sum(), (~good).sum()
    if not n1 or not n0:
        p = (n1 + 1) / (n1 + n0 + 2)
        return 0.0, float(np.log(p / (1 - p))), 0.0
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = values.std() or 1.0
    x = np.stack([values / scale, np.ones(len(values)), short(sizes)], axis=1)
    w = np.array([0.0, np.log(n1 / n0), 0.0])
    hold = np.array([1e-3, 0.0, 1e-1])

    def loss(w):
        z = x @ w
        return (np.logaddexp(0, z) - target * z).sum() + (hold * w * w).sum()

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (p - target) + 2 * hold * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(2 * hold + 1e-9)
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1]), float(w[2])


def _dictionaries(dictionary_bytes: int):
    def run(sample: pa.Table) -> pa.Table:
        """Sample rows (good, h, text) to one row (good, bad)."""
        sample = sample.sort_by([("h", "ascending"), ("text", "ascending")])
        good, texts = sample["good"].to_pylist(), [t.encode() for t in sample["text"].to_pylist()]
        sides = [[t for t, g in zip(texts, good, strict=True) if g == side and t] for side in (True, False)]
        room = min(dictionary_bytes, *(sum(map(len, s)) for s in sides))  # as much of one class as of the other
        data = []
        for side in sides:
            taken, size = [], 0
            for t in side:
                if size + len(t) <= room or not taken:
                    taken.append(t)
                    size += len(t) + 1
            data.append(b"\n".join(taken))
        return pa.table({"good": pa.array([data[0]], pa.binary()), "bad": pa.array([data[1]], pa.binary())})
    return run


def fit_quality(docs: DataFrame, labels: DataFrame, good_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
                dictionary_bytes: int = 2 << 20, dictionary_rows: int = 2000, calibration_rows: int = 6000, sample_chars: int = 16_000,
                level: int = 6) -> CompressionModel:
    """Fit on documents (id, text) by labels (id, 0 or 1), one row for each id.

    Two thirds of the ids (by hash) are for the dictionaries, at most ``dictionary_rows`` of a class; the others calibrate, at most
    ``calibration_rows``. The ids are chosen from the labels, so only dictionary texts leave the documents: whole ones up to
    ``sample_chars``, of longer ones a stretch of that size from a place given by the hash. Calibrating texts count whole.
    """
    rows = labels.where(F.col(good_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), (F.col(good_col) == 1).alias("good"), F.xxhash64(id_col, F.lit(17)).alias("h"))
    part = F.pmod(F.xxhash64("h"), F.lit(3))
    picked = [rows.where((part > 0) & (F.col("good") == side)).orderBy("h", "id").limit(dictionary_rows).withColumn("use", F.lit("dictionary"))
              for side in (True, False)]
    picked.append(rows.where(part == 0).orderBy("h", "id").limit(calibration_rows).withColumn("use", F.lit("calibration")))
    chosen = cut_lineage(picked[0].unionByName(picked[1]).unionByName(picked[2]))  # bounded by the three limits
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def rows_for(use: str) -> DataFrame:
        return texts.join(F.broadcast(chosen.where(F.col("use") == use)), "id")

    spare = F.greatest(F.length("text") - sample_chars, F.lit(0))
    stretch = F.substring("text", (F.pmod(F.col("h"), spare + 1) + 1).cast("int"), F.lit(sample_chars))
    found = rows_for("dictionary").select("good", "h", stretch.alias("text"), F.lit(1).alias("one")).groupBy("one").applyInArrow(
        _dictionaries(dictionary_bytes), "good binary, bad binary").collect()
    model = CompressionModel(bytes(found[0]["good"]), bytes(found[0]["bad"]), level) if found else CompressionModel(b"", b"", level)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value.scorer()
        for batch in (part for b in batches for part in slices(b)):
            rest = [t.encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("good"), batch.column("h"), pa.array(map(len, rest), pa.int64()),
                                              pa.array(map(score, rest), pa.float64())], ["good", "h", "size", "value"])

    known = rows_for("calibration").select("good", "h", "text").mapInArrow(valued, "good boolean, h long, size long, value double").collect()
    known.sort(key=lambda r: (r["h"], r["size"], r["value"]))  # numbers only
    curve = fit_curve(np.array([r["value"] for r in known], dtype=float), np.array([r["size"] for r in known], dtype=float),
                      np.array([r["good"] for r in known], dtype=bool))
    return replace(model, slope=curve[0], intercept=curve[1], brevity=curve[2])


def score_quality(docs: DataFrame, model: CompressionModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The documents with their score (0 to 1), from the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value.scorer()
        for batch in (part for b in batches for part in slices(b)):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            values, sizes = np.array([score(t) for t in texts], dtype=float), np.array([len(t) for t in texts], dtype=float)
            keep = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sent.value.curve(values, sizes), pa.float64())], [*keep, "score"])

    names = [f"c{k}" for k in range(len(docs.columns))]
    wide = docs.toDF(*names).withColumn("text", F.coalesce(F.col(names[docs.columns.index(text_col)]).cast("string"), F.lit("")))
    schema = ", ".join(f"{n} {t}" for n, t in wide.dtypes[:-1])
    return wide.mapInArrow(run, f"{schema}, score double").toDF(*docs.columns, score_col)


def held_out(id_col: str = "doc_id"):
    """Rows kept from all learning: the CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learnable(labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, label) of the labels that are not held out; ids with contradicting labels are left out."""
    known = labels.where(~held_out()).groupBy("doc_id").agg(F.min(label).alias(label), F.max(label).alias("high"))
    return known.where(F.col(label) == F.col("high")).select("doc_id", label)
