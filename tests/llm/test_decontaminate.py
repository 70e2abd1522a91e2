"""Tiling against a plain version over all pairs, and planted passages."""

import random
import re

from furrow.llm.decontaminate import contaminated, tile, without_contaminated


def words(text):
    return re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", "".join(c.lower() if c.isascii() else c for c in text or "")).split()


def greedy(item, doc, seed):
    free, used, covered = [True] * len(item), [False] * len(doc), 0
    while True:
        longest, best = seed, []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and free[i + n] and not used[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > longest:
                    longest, best = n, [(i, j)]
                elif n == longest:
                    best.append((i, j))
        if not best:
            return covered
        for i, j in best:
            if all(free[i:i + longest]) and not any(used[j:j + longest]):
                free[i:i + longest], used[j:j + longest] = [False] * longest, [True] * longest
                covered += longest


def brute(docs, items, seed, threshold):
    out = []
    for d, t in docs:
        for i, q in items:
            item = words(q)
            n = greedy(item, words(t), seed) if len(item) >= seed else 0
            if item and n and n >= threshold * len(item):
                out.append((d, i, len(item), n))
    return sorted(out, key=str)


def case():
    rng = random.Random(4)
    vocab = [a + b for a in "abcdef" for b in "xyzé"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(2, 40)))) for i in range(12)]
    items += [(3, "same id other text here it is"), (None, "item without any id at all"), (20, None), (21, ""), (0, items[0][1])]
    docs = []
    for d in range(80):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 60)))]
        for _ in range(rng.randrange(0, 3)):
            w = rng.choice(items)[1] or "q"
            w = w.split()
            k = rng.randrange(len(w) + 1)
            w = w[k:] + w[:k] if rng.random() < .5 else w[k // 3:]
            parts.append(", ".join(w).upper() if rng.random() < .3 else "! ".join(w))
            rng.shuffle(parts)
        docs.append((d if d % 9 else None, "\n".join(parts)))
    return docs + [(1, None), (2, ""), (3, items[4][1]), (3, items[5][1]), (900, items[4][1] + " x" * 3000)], items


def test_same_as_all_pairs(spark):
    docs, items = case()
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, seed int").repartition(4)
    tests = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    for seed, threshold in ((3, .5), (4, .5), (4, .9)):
        got = contaminated(frame, tests, seed=seed, threshold=threshold).select("doc_id", "item_id", "n_item_words", "n_covered")
        assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, seed, threshold)
    kept = without_contaminated(frame, tests)
    bad = [(d, t) for d, t in docs if brute([(d, t)], items, 4, .5)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([x for x in docs if x not in bad], key=str)
    assert kept.columns == frame.columns


def test_reordered_passage_and_no_items(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, "x nine ten eleven twelve y five six seven eight one two three four"), (2, "one two three x four five")],
                                 "doc_id long, text string")
    tests = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.coverage, len(r.tiles)) for r in contaminated(docs, tests).collect()] == [(1, 5, 1.0, 3)]
    assert contaminated(docs, tests.limit(0)).collect() == []
    assert without_contaminated(docs, tests.limit(0)).count() == 2
    assert contaminated(docs.limit(0), tests).collect() == []


def test_tiles_do_not_overlap():
    rng = random.Random(2)
    for _ in range(200):
        item, doc = [rng.randrange(3) for _ in range(20)], [rng.randrange(3) for _ in range(30)]
        tiles = tile(item, [(0, doc)], 3)
        assert sum(n for *_, n in tiles) == greedy(item, doc, 3)
        assert all(item[i:i + n] == doc[j:j + n] for i, j, n in tiles)
