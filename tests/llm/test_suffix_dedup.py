import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from furrow.llm.suffix_dedup import blind_trie, remove_repeats, sorted_suffixes

WIDTH = 100


def brute(rows, width=WIDTH):
    """rows: (doc_id, text); a row's key is its id, then (for rows of one id) any order given by ``sig``."""
    seen, out = {}, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = text.encode()
        gone = np.zeros(len(data), dtype=bool)
        for k in range(len(data) - width + 1):
            piece = data[k:k + width]
            if piece in seen:
                gone[k:k + width] = True
            else:
                seen[piece] = (doc, k)
        runs = int(np.sum(gone[1:] & ~gone[:-1]) + (len(gone) and gone[0]))
        out.append((doc, len(data), int(gone.sum()), runs, bytes(np.frombuffer(data, np.uint8)[~gone])))
    return sorted(out)


def result(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
                  for r in remove_repeats(frame, **options).collect())


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"{rng.choice('bcdfgmnprst')}{rng.choice('aeiouéß')}{rng.choice('lmnrst')}{k}" for k in range(60)]
    passage = [" ".join(rng.choices(words, k=rng.randint(15, 80))) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passage), " ".join(rng.choices(words, k=rng.randint(0, 20)))]
        rows.append((k, "".join(parts)))
    rows += [(n + 1, rows[3][1]), (n + 2, rows[3][1][1:]), (n + 3, "a" * 350), (n + 4, "a" * 99), (n + 5, "abc" * 90),
             (n + 6, "x" + "abc" * 60 + "y"), (n + 7, ""), (n + 8, "é" * 50), (n + 9, "é" * 51), (n + 10, "b" * 100)]
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 20_000), (2, 20_000), (3, 2), (4, 1)])
def test_equals_brute_force(spark, seed, hot):
    rows = corpus(seed)
    assert result(spark, rows, hot=hot) == brute(rows)


def test_pieces_of_long_texts(spark, monkeypatch):
    from furrow.llm import suffix_dedup
    monkeypatch.setattr(suffix_dedup, "PIECE", 128)
    block = list(suffix_dedup.blocks(__import__("pyarrow").array([("q" * 90 + "z") * 20, None, "", "w" * 227, "w" * 228]), WIDTH))
    starts = sorted((int(r), int(o)) for b in block for r, o in zip(b.row, b.offset))
    lengths = [1820, 0, 0, 227, 228]
    assert starts == [(r, k) for r, n in enumerate(lengths) for k in range(max(0, n - WIDTH + 1))]


def test_one_very_long_text(spark):
    rng = random.Random(9)
    line = "".join(rng.choices("abcdefgh ", k=997))
    rows = [(1, "".join(rng.choices("abcdefgh ", k=1_200_000)) + line), (2, line * 900)]
    assert result(spark, rows) == brute(rows)


def test_nulls_repeats_and_clashing_columns(spark):
    text = "".join(random.Random(5).choices("abcdefgh", k=300))
    rows = [(None, text), (4, text), (4, text), (4, text[50:250] + "!"), (7, None), (7, ""), (9, text[150:])]
    frame = spark.createDataFrame([(*r, 1, 2, 3, "n") for r in rows],
                                  "doc_id long, text string, rid int, sig int, m int, ranges string")
    out = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in remove_repeats(frame).collect()]
    assert out.count((4, 300, 0, 0)) + out.count((4, 201, 0, 0)) >= 1
    assert len(out) == 7 and out.count((7, 0, 0, 0)) == 2
    assert (None, 300, 300, 1) in out and (9, 150, 150, 1) in out
    # rows of one id: the texts are ordered by a hash, one of them loses what both have
    both = sorted(o for o in out if o[0] == 4)
    assert both in ([(4, 201, 200, 1), (4, 300, 0, 0), (4, 300, 0, 0)], [(4, 201, 0, 0), (4, 300, 200, 1), (4, 300, 200, 1)])


def test_empty_tables(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, None)]) == [(1, 0, 0, 0, b"")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=6).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=40))
def test_blind_trie_orders(texts):
    leaves = blind_trie(texts)
    assert [texts[leaf[0]] for leaf in leaves] == sorted(set(texts))
    assert sorted(k for leaf in leaves for k in leaf) == list(range(len(texts)))
    assert all(len({texts[k] for k in leaf}) == 1 for leaf in leaves)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=40, max_size=400).map(lambda b: bytes(x % 2 for x in b)), st.sampled_from([8, 16, 24]))
def test_sorted_suffixes(raw, shallow):
    at = np.arange(len(raw) - 32 + 1)
    order, new = sorted_suffixes(raw, at, 32, shallow)
    texts = [raw[a:a + 32] for a in at[order]]
    assert texts == sorted(texts)
    assert new.tolist() == [k == 0 or texts[k] != texts[k - 1] for k in range(len(texts))]


def test_registered_query(spark, sf_dir):
    from furrow.llm.queries import QUERIES
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    wanted = {d: (n, gone, runs, hashlib.sha256(kept).hexdigest()) for d, n, gone, runs, kept in
              brute([(r["doc_id"], r["text"] or "") for r in docs])}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in QUERIES["op13_suffix_array_dedup"](spark, sf_dir).collect()}
    assert got == wanted
