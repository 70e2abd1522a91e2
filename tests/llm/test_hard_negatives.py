import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from furrow.llm import hard_negatives as module
from furrow.llm.hard_negatives import SharedList, _Best, _units, hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>"
BIG = (1 << 63) - 1


def brute(rows, every=10, positives=5, negatives=10, scale=256):
    kept = [(BIG if i is None else i, lab, tuple(int(np.floor(np.float64(np.float32(x)) * scale)) for x in v)) for i, lab, v in rows
            if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, lab, v in sorted({r for r in kept if r[0] != BIG and r[0] % every == 0}):
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in kept if j != i)
        for p, pid, _ in [s for s in scored if s[2] == lab][:positives]:
            fits = [s for s in scored if s[2] != lab and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(i, None if pid == BIG else pid, k, None if nid == BIG else nid, -p, -n) for k, (n, nid, _) in enumerate(fits, 1)]
    return sorted(out, key=str)


def found(frame, every=10):
    return sorted((tuple(r) for r in hard_negatives(frame, F.col("vec_id") % every == 0).collect()), key=str)


def rows_of(seed, n, size=6, labels=4, spread=0.2):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(8)]
    rows = [(k, rng.randrange(labels), [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for k in range(n)]
    rows += [(n + k, rng.randrange(labels), list(rows[5][2])) for k in range(12)]
    rows += [(n + 20, None, rows[0][2]), (n + 21, 1, None), (n + 22, 1, [None] * size), (n + 23, 1, [float("nan")] * size),
             (n + 24, 1, [float("-inf")] * size), (n + 26, 2, [0.0] * size), (10 * n, 2, [0.0] * size)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n", [(1, 300), (2, 60), (3, 500)])
def test_equals_brute_force(spark, seed, n, monkeypatch):
    if seed == 3:  # several packs and blocks
        for name, value in (("PACK", 16), ("BLOCK", 64), ("MEMBERS", 4), ("STEP", 8)):
            monkeypatch.setattr(module, name, value)
    rows = rows_of(seed, n)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)


def test_repeats_null_ids_and_clashing_columns(spark):
    rows = rows_of(7, 80)
    rows += [(20, 1, [0.5] * 6)] * 2 + [(None, 1, [0.4] * 6)] * 2 + [(None, 2, [0.3] * 6), (30, 3, [0.1] * 6), (33, 2, rows[3][2])]
    rows += [r for r in rows if r[0] == 40]
    frame = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], f"{SCHEMA}, a int, block string, score double")
    assert found(frame) == brute(rows)


def test_no_anchor_no_row_and_uneven_vectors(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, 1, [1.0]), (2, 2, [0.5])], SCHEMA)) == []
    with pytest.raises(ValueError):
        found(spark.createDataFrame([(1, 1, [1.0]), (2, 2, [0.5, 1.0])], SCHEMA))


def test_lists_end_early_on_gathered_rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = np.floor(256 * (np.repeat(centres, 250, axis=0) + 0.05 * rng.normal(size=(10_000, 16)))).astype(np.int64)
    units, norms = _units(rows.astype(np.float64))
    shared, best = SharedList(rows[:20], rows, units, norms), _Best(20, 5)
    for active, at, scores in shared.walk(np.arange(20), best.kth):
        i, j = np.nonzero(scores >= best.kth[active][:, None])
        best.add(active[i], scores[i, j], at[j], at[j])
    every = rows[:20] @ rows.T
    wanted = [sorted((-s, k) for k, s in enumerate(line))[:5] for line in every]
    assert [(-s, k) for s, k in zip(best.score.tolist(), best.id.tolist())] == [x for line in wanted for x in line]
    assert shared.walked < 0.2 * every.size


def test_large_products():
    a = np.array([[1 << 29, 3]])
    assert module._products(a, a).tolist() == [[(1 << 58) + 9]]
    with pytest.raises(ValueError):
        module._products(a << 3, a << 3)
    assert module.matrix(pa.array([], pa.list_(pa.int64()))).shape == (0, 0)
