import hashlib
import random

import numpy as np
import pytest

from furrow.llm.vector_codes import Codebook, encode_vectors, with_label_error

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows: (id, label, vector or None), ids distinct; {id: (code, error, label_error)} and the digest."""
    kept = sorted(((i, lab, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]) for i, lab, v in rows
                   if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: r[0])
    if not kept:
        return {}, ""
    size = len(kept[0][2]) // parts
    cut = [[v[p * size:(p + 1) * size] for p in range(parts)] for *_, v in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            out.append([min((sum((x - y) ** 2 for x, y in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)])
        return out

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, at) if a[p][1] == k]
                if mine:
                    books[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
    at = assign()
    errors = [sum(d for d, _ in a) for a in at]
    by_label = {}
    for (_, lab, _), e in zip(kept, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return {i: ("".join(f"{k:02x}" for _, k in a), e, by_label[lab]) for (i, lab, _), a, e in zip(kept, at, errors)}, digest


def rows_of(seed, n, size=8):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(7)]
    out = [(k * 3, rng.choice([None, 1, 2, 3]), [c + rng.choice([0.0, 0.001, rng.gauss(0, 0.1)]) for c in rng.choice(centres)])
           for k in range(n)]
    out += [(n * 3 + k, 1, list(out[0][2])) for k in range(5)]
    out += [(n * 3 + 10, 2, None), (n * 3 + 11, None, [None] * size), (n * 3 + 12, 2, [float("nan")] + [0.0] * (size - 1)),
            (1, 2, [float("inf")] + [0.0] * (size - 1)), (n * 3 + 13, 3, [-0.0004] * size), (n * 3 + 14, 3, [0.0] * size)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,n,entries", [(1, 300, 256), (2, 40, 256), (3, 400, 16)])
def test_equals_brute_force(spark, seed, n, entries):
    rows = rows_of(seed, n)
    wanted, digest = brute(rows, entries=entries)
    codes = encode_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), entries=entries)
    got = with_label_error(codes).collect()
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in got} == wanted
    assert {r["codebooks_sha256"] for r in got} == {digest} and len(got) == len(wanted)


def test_search_is_exact_and_prunes():
    rng = np.random.default_rng(3)
    entries = rng.integers(-40, 40, (256, 4)) + rng.integers(-500, 500, (256, 1))
    entries[100] = entries[7]
    parts = np.concatenate([entries[rng.integers(0, 256, 500)] + rng.integers(-3, 4, (500, 4)), rng.integers(-600, 600, (200, 4))])
    found, distance, seen = Codebook(entries).nearest(parts)
    every = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (found == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert seen < 0.5 * every.size


def test_equal_sums_and_ties():
    entries = np.array([[3, 0], [0, 3], [3, 0], [1, 2], [2, 1]])
    found, distance, _ = Codebook(entries).nearest(np.array([[3, 0], [0, 0], [1, 1], [2, 2]]))
    assert found.tolist() == [0, 3, 3, 3] and distance.tolist() == [0, 5, 1, 1]


def test_null_ids_repeats_and_clashing_columns(spark):
    rows = [(None, 1, [0.5] * 4), (3, 1, [0.25] * 4), (3, 1, [0.25] * 4), (2, None, [0.0] * 4), (2, 5, None)]
    frame = spark.createDataFrame([(*r, 7, "x", 1.0) for r in rows], f"{SCHEMA}, v int, code string, id double")
    got = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"])
                  for r in with_label_error(encode_vectors(frame)).collect()))
    assert got == [(False, 2, "00000000", 0, 0), (False, 3, "01010101", 0, 0), (False, 3, "01010101", 0, 0), (True, 0, "03030303", 0, 0)]


def test_empty_and_uneven(spark):
    assert with_label_error(encode_vectors(spark.createDataFrame([], SCHEMA))).collect() == []
    assert with_label_error(encode_vectors(spark.createDataFrame([(1, 1, None)], SCHEMA))).collect() == []
    with pytest.raises(ValueError):
        encode_vectors(spark.createDataFrame([(1, 1, [1.0] * 4), (2, 1, [1.0] * 8)], SCHEMA))
    with pytest.raises(ValueError):
        encode_vectors(spark.createDataFrame([(1, 1, [1.0] * 5)], SCHEMA))
