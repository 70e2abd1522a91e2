"""Similarity components against all pairs, and the signature tree on its own."""

import random
import re

import pytest

from furrow.llm.common import components, keyed
from furrow.llm.ngram_join import SignatureTree, _linked, map_bits, similar_components

SPLIT = re.compile("[\x20\x09-\x0d]+")


def shingles(text, n):
    w = [x for x in SPLIT.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    big, low = 1 << 63, {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), big), big if d is None else d)
    return sorted(((d, len(sets[i]), None if low[find(i)] == big else low[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def case():
    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(rng.randrange(1, 120))] for _ in range(25)]
    common = [rng.choice("xyz") + str(i) for i in range(30)]
    rows = []
    for i in range(400):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = rng.choice("KLM") + str(rng.randrange(5))
        if rng.random() < .3:
            w = w + common
        if rng.random() < .2:
            w = [x.upper() for x in w]
        rows.append((i * 3 % 1000 if rng.random() < .98 else None, rng.choice([" ", "\n ", "\t\r"]).join(w)))
    return rows + [(5, None), (6, ""), (None, " \n"), (7, "one two"), (8, "ONE two"), (9, "one"), (3, "É x y z w"), (2, "é x y z w"),
                   (50_000, " ".join(map(str, range(9000)))), (50_001, " ".join(map(str, range(8500)))), (50_001, "one two")]


@pytest.mark.parametrize(("bucket_rows", "block_tokens"), [(4096, 4_000_000), (7, 300)])
def test_same_as_all_pairs(spark, bucket_rows, block_tokens):
    rows = case()
    docs = spark.createDataFrame([(i, t, "s", b"k") for i, t in rows], "doc_id long, text string, size string, key binary").repartition(6)
    got = similar_components(docs, bucket_rows=bucket_rows, block_tokens=block_tokens)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 4, 85)


def test_nothing_links_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, None)]
    got = similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 4, 85)
    assert similar_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_tree_finds_the_same_parts_as_all_pairs(seed):
    rng = random.Random(seed)
    sets = []
    for _ in range(150):
        if sets and rng.random() < .7:
            s = set(rng.choice(sets))
            for _ in range(rng.randrange(0, max(1, len(s) // 6) + 1)):
                s.discard(next(iter(s)))
                s.add(rng.randrange(10**6))
            sets.append(s)
        else:
            sets.append({rng.randrange(10**6) for _ in range(rng.randrange(1, 400))})
    sets.sort(key=lambda s: map_bits(len(s)))

    def bits(s):
        out = 0
        for x in s:
            out |= 1 << (x * 2654435761 >> 7) % map_bits(len(s))
        return out

    def alike(i, j):
        a, b = sets[i], sets[j]
        return 100 * len(a & b) >= 85 * len(a | b)

    def parts(edges):
        parent = list(range(len(sets)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in edges:
            parent[max(find(i), find(j))] = min(find(i), find(j))
        return [find(i) for i in range(len(sets))]

    tree = SignatureTree([(len(s), map_bits(len(s)), bits(s)) for s in sets], 85, alike)
    assert parts(tree.links) == parts((i, j) for i in range(len(sets)) for j in range(i) if alike(i, j))
    assert len(tree.links) < len(sets)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, x) for x in range(1001, 1400)] + [(2000, 2000)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1400)}}


def test_registered_query(spark, sf_dir):
    from furrow.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op9_ngram_jaccard_join"](spark, sf_dir).collect()), key=str) == brute(rows, 4, 85)


def test_frequent_tokens_come_last_without_loss(spark):
    rng = random.Random(8)
    common = [f"c{i}" for i in range(40)]
    rows = []
    for i in range(300):
        own = [f"{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 25))]
        w = common[:rng.randrange(20, 41)] + own
        rows.append((i, " ".join(w)))
        if rng.random() < .2:
            rows.append((1000 + i, " ".join([*w[:-1], "x"])))
    rows += [(2000 + i, " ".join([*common, str(i)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for often in (1, 16, 10**9):
        described, parts = _linked(keyed(docs, "doc_id", "text"), 4, 85, 4096, 4_000_000, often)
        groups = {}
        for r in described.join(parts, "key", "left").collect():
            groups.setdefault(bytes(r.component or r.key), []).append(r.rid)
        low = {i: min(g) for g in groups.values() for i in g}
        assert sorted((i, low[i]) for i in low) == sorted((d, c) for d, _, c in brute(rows, 4, 85))


def test_a_token_too_large_to_hold():
    import numpy as np
    import pyarrow as pa

    from furrow.llm.ngram_join import _shared

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                           pa.array([r[2].to_bytes(16) for r in rows], pa.binary()), pa.array([0] * len(rows), pa.int64())],
                                          ["token", "size", "key", "lead"])

    rows = [(1, 10, 1), (1, 10, 2), (2, 5, 3), (2, 50, 4)] + [(3, 10, k) for k in range(40)] + [(4, 10, 1), (4, 10, 2), (5, 7, 9)]
    for step in (1, 3, 7, 100):
        for most in (5, 1000):
            got = [x for k in range(0, len(rows), step) for x in [batch(rows[k:k + step])]]
            found = pa.Table.from_batches(list(_shared(85, most)(iter(got)))).to_pylist()
            by = {}
            for r in found:
                by.setdefault(r["bucket"], set()).add(int.from_bytes(r["key"]))
            assert sorted(map(len, by.values())) == [2, 40], (step, most)
