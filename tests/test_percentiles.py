import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import order_stats
from furrow.functions.order_stats import percentiles, set_medians

WANTED = {"q1": 0.25, "median": 0.5, "top": 0.99, "least": 0.0, "most": 1.0}


def frame(spark, n=30_000):
    rng = np.random.default_rng(1)
    group = [None, "a", "a", "a", "b"]
    rows = [(group[k % 5], int(k % 4), float(x), None if k % 3 == 0 else float(int(y)), 7.0 if k % 2 else None)
            for k, (x, y) in enumerate(zip(rng.normal(0, 5, n), rng.exponential(3, n)))]
    rows += [("few", 0, 1.0, None, None), ("few", 1, 2.0, 5.0, None)]
    return spark.createDataFrame(rows, "g string, part int, x double, y double, z double").repartition(6)


def expected(rows, columns, sets):
    out = {}
    for name, member in sets.items():
        for c in columns:
            v = [r[c] for r in rows if member(r) and r[c] is not None]
            if v:
                out[name, c] = (len(v), *[float(np.quantile(v, p)) for p in WANTED.values()])
    return out


@pytest.mark.parametrize("limit", [500_000, 0])
def test_percentiles_are_exact(spark, monkeypatch, limit):
    monkeypatch.setattr(order_stats, "BROADCAST_CELLS", limit)  # 0: every side is shuffled, brackets are ranged
    df = frame(spark, 3_000 if not limit else 30_000)
    got = {(r["g"], r["column"]): (r["n_values"], *[r[w] for w in WANTED]) for r in percentiles(df, ["x", "y", "z"], ["g"], WANTED).collect()}
    rows = df.collect()
    want = expected(rows, ["x", "y", "z"], {g: (lambda r, g=g: r["g"] == g) for g in (None, "a", "b", "few")})
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-9)


def test_a_sketch_that_errs_costs_work_only(spark, monkeypatch):
    df = frame(spark)
    monkeypatch.setattr(order_stats, "RANK_SLACK", -0.2)
    got = {r["column"]: r["median"] for r in percentiles(df, ["x", "y"], [], {"median": 0.5}).collect()}
    values = {c: [r[c] for r in df.select(c).collect() if r[c] is not None] for c in ("x", "y")}
    assert got == pytest.approx({c: float(np.median(v)) for c, v in values.items()})
    sets = {0: [1, 2, 3], 1: [0]}
    medians = {(r["set"], r["column"]): r["median"] for r in set_medians(df, ["x"], "part", sets).collect()}
    by_part = {p: [r["x"] for r in df.where(F.col("part") == p).select("x").collect()] for p in range(4)}
    assert medians == pytest.approx({(s, "x"): float(np.median(sum((by_part[p] for p in ps), []))) for s, ps in sets.items()})


@pytest.mark.parametrize("limit", [500_000, 0])
def test_medians_of_sets(spark, monkeypatch, limit):
    monkeypatch.setattr(order_stats, "BROADCAST_CELLS", limit)
    df = frame(spark, 3_000 if not limit else 30_000)
    sets = {0: [1, 2, 3], 1: [0], 2: [0, 1, 2, 3], 3: [2], 4: []}
    got = {(r["set"], r["column"]): (r["n_values"], r["median"]) for r in set_medians(df, ["x", "y", "z"], "part", sets).collect()}
    rows = df.collect()
    want = expected(rows, ["x", "y", "z"], {s: (lambda r, ps=ps: r["part"] in ps) for s, ps in sets.items()})
    assert got == {key: pytest.approx((v[0], v[2])) for key, v in want.items()}


def test_nothing_to_count(spark):
    df = spark.createDataFrame([(None, None)], "g string, x double")
    assert percentiles(df, ["x"], ["g"], WANTED).collect() == []
    assert set_medians(df.withColumn("part", F.lit(0)), ["x"], "part", {0: [0]}).collect() == []


def test_only_brackets_are_kept(spark):
    df = frame(spark)
    before = order_stats.counted_cut
    kept = []

    def counting(frame, outlive=False):
        table, n = before(frame, outlive)
        kept.append(n)
        return table, n

    order_stats.counted_cut = counting
    try:
        percentiles(df, ["x"], [], {"median": 0.5}).collect()
    finally:
        order_stats.counted_cut = before
    assert max(kept) < 0.1 * df.count()
