import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import features
from furrow.operators.moments import grouped_moments

COLUMNS = ["a", "b", "c", "d"]


def rows_of(seed, n, gaps=0.25):
    rng = np.random.default_rng(seed)
    base = rng.normal(50, 10, n)
    x = np.stack([base + rng.normal(0, s, n) for s in (1, 3, 6, 9)], axis=1)
    hidden = rng.random(x.shape) < np.array([0.0, gaps, gaps / 2, gaps])
    return [(k, int(k % 3), *[None if h else float(v) for v, h in zip(line, gap)]) for k, (line, gap) in enumerate(zip(x, hidden))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, fold int, " + ", ".join(f"{c} double" for c in COLUMNS)).repartition(4)


def values(df):
    return np.array([[r[c] for c in COLUMNS] for r in df.orderBy("id").collect()], dtype=float)


def test_moments_add_up(spark):
    df = frame(spark, rows_of(1, 200))
    out = grouped_moments(df, F.col("fold"), [F.col(c) for c in COLUMNS])
    x = np.nan_to_num(values(df), nan=0.0)
    folds = np.array([r["fold"] for r in df.orderBy("id").collect()])
    for fold in range(3):
        z = np.column_stack([np.ones((folds == fold).sum()), x[folds == fold]])
        assert np.allclose(out[fold], z.T @ z)
    assert grouped_moments(df.limit(0), F.col("fold"), [F.col("a")]) == {}


@pytest.mark.parametrize("seed,rounds,tolerance", [(2, 10, 1e-3), (3, 2, 1e-3), (4, 10, 1e-9), (5, 10, 0.05)])
def test_patterns_give_what_scans_give(spark, seed, rounds, tolerance):
    train, other = frame(spark, rows_of(seed, 300)), frame(spark, rows_of(seed + 100, 80, 0.5))
    one, (two,) = features.iterative_impute(train, [other], COLUMNS, rounds, tolerance)
    same, (also,) = features.impute_by_scans(train, [other], COLUMNS, rounds, tolerance)
    assert np.allclose(values(one), values(same), atol=1e-9, rtol=0)
    assert np.allclose(values(two), values(also), atol=1e-9, rtol=0)


def test_folds_share_one_pass(spark):
    df = frame(spark, rows_of(6, 240))
    imputers = features.fit_imputers(df, COLUMNS, 3)
    for fold in range(3):
        inside, outside = df.where(F.col("fold") == fold), df.where(F.col("fold") != fold)
        train, (test,) = features.impute_by_scans(outside, [inside], COLUMNS)
        assert np.allclose(values(imputers[fold].transform(outside)), values(train), atol=1e-9, rtol=0)
        assert np.allclose(values(imputers[fold].transform(inside)), values(test), atol=1e-9, rtol=0)


def test_columns_without_values_or_gaps(spark):
    rows = [(k, 0, float(k), None, 2.0, None if k % 4 == 0 else float(3 * k)) for k in range(40)]
    train, _ = features.iterative_impute(frame(spark, rows), [], COLUMNS)
    same, _ = features.impute_by_scans(frame(spark, rows), [], COLUMNS)
    assert np.allclose(values(train), values(same), atol=1e-9) and (values(train)[:, 1] == 0.0).all()


def test_many_patterns_take_the_scans(spark, monkeypatch):
    monkeypatch.setattr(features, "MAX_PATTERNS", 2)
    train = frame(spark, rows_of(8, 60))
    assert features.fit_imputers(train, COLUMNS, 3) is None
    assert not np.isnan(values(features.iterative_impute(train, [], COLUMNS, 2)[0])).any()


def test_few_jobs(spark):
    df = frame(spark, rows_of(9, 120)).cache()
    df.count()
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("imputers", "")
    features.fit_imputers(df, COLUMNS, 3, tolerance=1e-12)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # thirty regressions for each of three folds would be ninety scans
    assert len(status.getJobIdsForGroup("imputers")) < 40
