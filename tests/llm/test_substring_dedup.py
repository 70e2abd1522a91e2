"""Repeated passages against a brute-force version."""

import hashlib
import random

import pytest

from furrow.llm.substring_dedup import remove_repeats


def brute(rows, width):
    starts = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    big = 1 << 63
    for i, w in words:
        for a in range(len(w) - width + 1):
            key = tuple(w[a:a + width])
            starts[key] = min(starts.get(key, big + 1), big if i is None else i)
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - width + 1):
            if starts[tuple(w[a:a + width])] < (big if i is None else i):
                gone.update(range(a, a + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        out.append((i, len(w), len(gone), kept))
    return sorted(out, key=str)


def case(seed):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(rng.randrange(5, 40))) for _ in range(5)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            parts.append(rng.choice(passages) if rng.random() < .5 else " ".join(rng.choice("xyzé") + str(rng.randrange(9)) for _ in range(rng.randrange(1, 30))))
        rows.append((rng.randrange(100) if rng.random() < .95 else None, rng.choice([" ", "\n", "\t\x0b "]).join(parts)))
    rows += [(7, None), (None, None), (3, ""), (5, "one two"), (200, "v w x " * 400), (201, "v w x " * 300), (201, "v w x " * 300)]
    return rows


@pytest.mark.parametrize(("width", "gram", "hot"), [(10, 3, 20_000), (10, 3, 4), (50, 8, 20_000)])
def test_same_as_brute_force(spark, width, gram, hot):
    rows = case(width)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").repartition(5)
    got = remove_repeats(docs, width=width, gram=gram, hot=hot)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, width)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_registered_query(spark, sf_dir):
    from furrow.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute(rows, 50))
    assert sorted(map(tuple, QUERIES["op10_substring_dedup"](spark, sf_dir).collect())) == want
