"""The pipeline against a brute-force version of each stage."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from furrow.llm.ngram_join import one_of_each
from furrow.llm.quality import fit_quality, learnable
from tests.llm import test_decontaminate, test_ngram_join, test_secrets


def test_same_as_brute_force(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(docs, learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    score = model.scorer()
    rows = [r for r in docs.collect() if model.curve(np.array([score((r.text or "").encode())]), np.array([len((r.text or "").encode())]))[0] >= 0.5]
    assert len(rows) < docs.count()
    low = {i: c for i, _, c in test_ngram_join.brute([(r.doc_id, r.text) for r in rows], 5, 80)}
    rows = [r for r in rows if low[r.doc_id] == r.doc_id]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    seeds = {tuple(w[k:k + 4]) for _, t in items for w in [test_decontaminate.words(t)] for k in range(len(w) - 3)}

    def bad(text):
        w = test_decontaminate.words(text)
        near = [k for k in range(len(w) - 3) if tuple(w[k:k + 4]) in seeds]
        keep = sorted({k + d for k in near for d in range(4)})
        cut = []  # words outside of any seed can't be in a tile
        for a, b in zip(keep, [*keep[1:], None], strict=False):
            cut += [w[a]] + (["|"] if b != a + 1 else [])
        return bool(test_decontaminate.brute([(0, " ".join(x if x != "|" else "\x80" for x in cut))], items, 4, .5))

    flagged = {r.doc_id for r in rows if bad(r.text)}
    rows = [r for r in rows if r.doc_id not in flagged]
    library, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for r in rows:
        text, at, out = r.text, 0, ""
        for a, b, _ in test_secrets.brute(text):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        out += text[at:]
        want[r.doc_id] = (r.lang, r.source, len(out), library.encode(out, add_special_tokens=False).ids)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: (r.lang, r.source, r.n_chars, np.frombuffer(r.ids, dtype="<u4").tolist()) for r in got} == want
    assert len(got) == len(want) and all(len(r.ids) == 4 * r.n_tokens for r in got)


def test_one_of_each_with_repeats_and_nulls(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(2, text, "a"), (1, text + " x", "b"), (1, text + " x", "c"), (1, "other words are here now ok", "d"), (None, text, "e"),
            (None, None, "f"), (None, None, "g"), (7, "", "h"), (7, "", "h"), (8, "one two", "i"), (9, "ONE two", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = one_of_each(docs)
    assert got.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.key) for r in got.collect()), key=str)
    assert sum(k in "bc" for *_, k in got) == 1
    assert [x for x in got if x[2] not in "bc"] == sorted([rows[3], rows[5], rows[6], rows[7], rows[8], rows[9]], key=str)
    assert one_of_each(docs.limit(0)).collect() == []


def test_stages_on_odd_rows_and_clashing_columns(spark, sf_dir):
    import corpus_pipeline

    given = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(40)
    like = given.first()
    odd = spark.createDataFrame(
        [(None, None, "en", "s", 0), (900_001, "", "en", "s", 0), (900_002, None, None, None, None), (like.doc_id, like.text, like.lang, like.source, like.n_chars),
         (None, like.text, "en", "s", 5), (900_003, "word " * 60_000, "en", "s", 300_000), (900_004, "password = abcdefgh12345", "en", "s", 24)], given.schema)
    docs = given.unionByName(odd)
    extra = {"score": F.lit(0.1), "spans": F.lit("mine"), "secret_spans": F.lit(7), "rid": F.lit(-1), "sig": F.lit(-2), "shard": F.lit(3), "key": F.lit("k"),
             "size": F.lit(9), "c0": F.lit("c")}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, wide = stage(spark, docs, sf_dir), stage(spark, docs.withColumns(extra), sf_dir)
        assert wide.columns == [*docs.columns, *extra] and plain.columns == docs.columns, name
        rows = sorted(map(tuple, plain.collect()), key=str)
        assert sorted((tuple(r)[:len(docs.columns)] for r in wide.collect()), key=str) == rows, name
        assert all(r.spans == "mine" and r.score == 0.1 and r.secret_spans == 7 for r in wide.collect()), name
        assert stage(spark, docs.limit(0), sf_dir).collect() == [], name
    cleaned = {r.doc_id: r.text for r in corpus_pipeline.secrets(spark, docs, sf_dir).collect()}
    assert cleaned[900_004] == "[SECRET]" and cleaned[900_001] == "" and cleaned[900_002] is None
    out = corpus_pipeline.tokens(spark, docs, sf_dir)
    assert out.count() == docs.count() and out.where("doc_id = 900002").first().n_tokens == 0
    assert corpus_pipeline.tokens(spark, docs.limit(0), sf_dir).collect() == []
