import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators.models import ModelSpec, fit_model
from furrow.operators.features import full_statistics, preprocessor
from furrow.operators.ridge_folds import RidgeFolds, RidgeRun
from furrow.plans import experiments as ex

NUMERIC, CATEGORICAL = ["a", "b", "c"], ["e"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for k in range(400):
        a, b = rng.normal(10, 2), rng.normal(-5, 4)
        x = [None if rng.random() < 0.2 else float(v) for v in (a, b, a + b + rng.normal(0, 1))]
        e = [None, "p", "q", "r"][k % 4] if k % 5 else "only here" if k % 3 == 0 else "p"
        y = None if k % 50 == 0 else 2 * a - b + rng.normal(0, 1)
        out.append((k, k % 3, *x, e, y, sum(v is None for v in x) / 3))
    return spark.createDataFrame(out, "row_no long, fold int, a double, b double, c double, e string, y double, missing_frac double").cache()


def by_fitting(rows, run, fold):
    """The same fold by the preprocessor and the solver on the encoded rows."""
    train = rows.where((F.col("fold") != fold) & (F.col("missing_frac") <= run.threshold) & F.col("y").isNotNull())
    stats = full_statistics(train.drop("fold"), NUMERIC)
    stages = preprocessor("linear", NUMERIC, CATEGORICAL, stats, run.impute, run.indicators).fit(train)
    model = fit_model(ModelSpec("ridge", {"alpha": run.alpha}), stages.transform(train).withColumn("label", F.col("y")))
    out = model.predict(stages.transform(rows.where(F.col("fold") == fold)))
    return {r["row_no"]: r["y_pred"] for r in out.select("row_no", "y_pred").collect()}


def test_sums_give_what_fitting_gives(rows):
    runs = [RidgeRun(), RidgeRun(0.4, 3.0), RidgeRun(0.0, 0.5, "mean", False), RidgeRun(1.0, 100.0, "median", False)]
    fits = RidgeFolds(rows.where("y IS NOT NULL"), 3, "y", NUMERIC, CATEGORICAL)
    got = {(r["run"], r["row_no"]): r["y_pred"] for r in fits.predict(rows, runs).collect()}
    assert len(got) == 400 * len(runs)
    for i, run in enumerate(runs):
        for fold in (0, 2):
            want = by_fitting(rows, run, fold)
            assert {n: got[i, n] for n in want} == pytest.approx(want, abs=1e-6)


def test_no_training_rows_and_no_features(spark, rows):
    lone = rows.where("fold = 0")
    out = RidgeFolds(lone.where("y IS NOT NULL"), 2, "y", NUMERIC, CATEGORICAL).predict(lone, [RidgeRun()]).collect()
    assert out and all(r["y_pred"] is None for r in out)
    mean = RidgeFolds(rows.where("y IS NOT NULL"), 3, "y", [], []).predict(rows, [RidgeRun()])
    want = rows.where("fold <> 1").agg(F.avg("y")).first()[0]
    assert mean.where("fold = 1").first()["y_pred"] == pytest.approx(want)


def test_search_takes_one_table_of_sums(spark, rows, monkeypatch):
    made = []
    monkeypatch.setattr(ex, "RidgeFolds", lambda *a: made.append(a) or RidgeFolds(*a))
    data = rows.select("*", F.lit("NE").alias("env_label"), F.col("row_no").cast("string").alias("row_id"),
                       F.lit("complete").alias("missing_band"), F.col("row_no").cast("string").alias("name1"))
    roles = ex.Roles("y", "name1", "env_label", [], NUMERIC, CATEGORICAL)
    best, trials = ex.parameter_search(data, "ridge", {"alpha": ("log", 1e-3, 1e5)}, 20, 3, 1, roles)
    assert len(made) == 1 and len(trials) == 20
    one = ex.out_of_fold(data, [ModelSpec("ridge", best)], 3, roles).where("y_true IS NOT NULL")
    errors = one.groupBy("fold").agg(F.sqrt(F.avg(F.pow(F.col("y_true") - F.col("y_pred"), F.lit(2)))).alias("e"))
    assert errors.agg(F.avg("e")).first()[0] == pytest.approx(min(t[1] for t in trials), abs=1e-9)
