"""The fitted curve, held-out accuracy, and odd inputs."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from furrow.llm.quality import CompressionModel, fit_curve, fit_quality, held_out, learnable, score_quality


def test_curve_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=20_000)
    good = rng.random(20_000) < 1 / (1 + np.exp(-(3 * x + 1)))
    slope, intercept, brevity = fit_curve(x, np.full(20_000, 1e9), good)
    assert abs(slope - 3) < 0.2 and abs(intercept - 1) < 0.1 and abs(brevity) < 0.1
    assert fit_curve(np.zeros(0), np.zeros(0), np.zeros(0, dtype=bool)) == (0.0, 0.0, 0.0)
    assert fit_curve(np.array([1.0, 2.0]), np.ones(2), np.array([True, True]))[0] == 0.0
    sizes = np.where(rng.random(20_000) < .5, 0.0, 1e9)
    assert fit_curve(x, sizes, good | (sizes == 0))[2] > 3


def test_held_out_is_the_crc_rule(spark):
    got = spark.range(200).select(F.col("id").alias("doc_id"), held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_registered_query_on_held_out_rows(spark):
    from furrow.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op2_quality_classifier"](spark, sf_dir).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = [(r.score, labels[i]) for i, r in got.items() if r.held_out and i in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    good, bad = [s for s, q in rows if q == 1], [s for s, q in rows if q == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.9


def test_labels_of_held_out_rows_are_not_used(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(0, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    used = {r.doc_id for r in learnable(labels).collect() if r.doc_id is not None}
    assert used == {i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 3 != 1}


def test_odd_inputs(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, None, 5.0), (None, "", 6.0), (2, "x" * 3_000_000, 7.0)], "doc_id long, text string, good double")
    got = score_quality(docs, fit_quality(docs, empty))
    assert [r.score for r in got.collect()] == [0.5] * 3 and got.columns == ["doc_id", "text", "good", "score"]
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 1), (5, 0)], empty.schema)
    assert all(0 < r.score < 1 for r in score_quality(docs, fit_quality(docs, one)).collect())
    model = CompressionModel(b"some good words here " * 20, b"BAD BAD " * 50, 3, 10.0, 0.5)
    scores = {r.doc_id: r.score for r in score_quality(docs, model).collect()}
    assert scores[1] == scores[None] == 1 / (1 + np.exp(-0.5))
    assert score_quality(docs.limit(0), model).collect() == []


def test_value_of_a_long_text_is_that_of_its_parts():
    rng = np.random.default_rng(5)
    good, bad = ([" ".join("".join(rng.choice(list(letters), 6)) for _ in range(12)) for _ in range(800)] for letters in ("abcdefghij", "klmnopqrst"))
    score = CompressionModel(" ".join(good).encode(), " ".join(bad).encode(), 6).scorer()
    for lines, sign in ((good, 1), (bad, -1)):
        values = [sign * score(" ".join(rng.choice(lines, n)).encode()) for n in (45, 400, 4000)]
        assert min(values) > 0.8 * max(values) > 0.1


def test_long_labelled_texts_are_learned_from(spark):
    rng = np.random.default_rng(6)
    words = [["".join(rng.choice(list(letters), 5)) for _ in range(300)] for letters in ("abcdefghij", "fghijklmno")]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words[i % 2], 5000))) for i in range(40)], "doc_id long, text string")
    model = fit_quality(docs, spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int"))
    assert model.good and model.bad and model.slope > 0
    assert all((r.score > 0.5) == (r.doc_id % 2 == 0) for r in score_quality(docs, model).collect())


def test_held_out_errors_by_length(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs, fit_quality(docs, learnable(labels))).join(labels.where(held_out()), "doc_id")
    size = F.octet_length("text")
    band = F.when(size < 1000, 0).when(size < 4096, 1).when(size < 16_000, 2).otherwise(3)
    wrong = (F.col("score") >= 0.5) != (F.col("quality") == 1)
    errors = {(r.band, r.quality): r.wrong for r in scored.groupBy(band.alias("band"), "quality").agg(F.avg(wrong.cast("int")).alias("wrong")).collect()}
    assert len(errors) == 8 and errors[3, 0] == errors[3, 1] == 0
    assert all(e < (0.03 if quality else 0.1) for (_, quality), e in errors.items())
