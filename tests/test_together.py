"""Fits of several settings on the same rows, and searches that keep all of their trials."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from furrow.operators import folds
from furrow.operators.models import ModelSpec, fit_model, fit_models
from furrow.plans import experiments as ex
from verification.registry import QUERIES


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 3))
    y = np.sin(x[:, 0]) + x[:, 1] * x[:, 2] + rng.normal(0, 0.1, 400)
    data = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "row_no long, x array<double>, label double")
    return data.select("row_no", "label", array_to_vector("x").alias("features")).cache()


SPECS = [ModelSpec("xgb", {"rounds": 4, "max_depth": 2, "learning_rate": 0.3}), ModelSpec("svr", {"n_components": 12}),
         ModelSpec("xgb", {"rounds": 2, "max_depth": 4, "learning_rate": 0.1, "subsample": 1.0, "gamma": 1.0}),
         ModelSpec("svr", {"n_components": 20, "C": 0.1, "huber_shape": 2.0, "gamma": 0.1}),
         ModelSpec("lgbm", {"rounds": 3, "max_depth": 3, "min_child_weight": 9})]


def test_models_fitted_together_are_those_fitted_alone(rows):
    for spec, model in zip(SPECS, fit_models(SPECS, rows), strict=True):
        mine, alone = ([r["y_pred"] for r in m.predict(rows).orderBy("row_no").collect()] for m in (model, fit_model(spec, rows)))
        assert mine == pytest.approx(alone, abs=1e-9)
        assert len({round(v, 6) for v in mine}) > 3


class _Asked(Exception):
    pass


def _search_of(spark, sf_dir, monkeypatch, name):
    asked = {}

    def nested(prepared, group, outer, inner, plain=folds.nested_folds):
        asked.update(outer=outer, inner=inner)
        return plain(prepared, group, outer, inner)

    def search(data, model, space, n_trials, k, seed, roles, policy, first, fixed):
        asked.update(space=space, n_trials=n_trials, k=k, first=first, fixed=fixed)
        raise _Asked

    monkeypatch.setattr(folds, "nested_folds", nested)
    monkeypatch.setattr(ex, "parameter_search", search)
    with pytest.raises(_Asked):
        QUERIES[name](spark, sf_dir)
    return asked


def test_production_training_searches_all_trials(spark, sf_dir, monkeypatch):
    assert _search_of(spark, sf_dir, monkeypatch, "E8_production_training") == {
        "space": ex.BOOSTER_SPACE, "n_trials": 40, "k": 5, "first": ex.BOOSTER_BASELINE, "fixed": None}


def test_nested_tuning_searches_all_trials_and_folds(spark, sf_dir, monkeypatch):
    assert _search_of(spark, sf_dir, monkeypatch, "E5_nested_tuning_kernel") == {
        "outer": 5, "inner": 3, "space": ex.KERNEL_SPACE, "n_trials": 20, "k": 3, "first": ex.KERNEL_BASELINE, "fixed": None}


def test_a_search_prepares_its_training_rows_once_for_all_trials(spark, rows, monkeypatch):
    data = rows.select("row_no", F.col("row_no").cast("string").alias("row_id"), F.col("label").alias("y"), (F.col("row_no") % 2).cast("int").alias("fold"),
                       *[F.element_at(F.expr("split(string(row_no), '')"), 1).alias("name1")], F.lit("NE").alias("env_label"), F.lit(0.0).alias("missing_frac"),
                       F.lit("complete").alias("missing_band"), (F.col("row_no") * 0.01).alias("a"), (F.col("row_no") % 7).cast("double").alias("b"))
    roles, made = ex.Roles(target="y", numeric=["a", "b"], categorical=[], keys=["row_no"], group="name1", env="env_label"), []
    plain = ex.preprocessor
    monkeypatch.setattr(ex, "preprocessor", lambda *a: made.append(a) or plain(*a))
    best, trials = ex.parameter_search(data, "xgb", {**ex.BOOSTER_SPACE, "rounds": ("int", 2, 4)}, 3, 2, 1, roles)
    assert len(made) == 2 and len(trials) == 3  # one for each fold
    assert best == min(trials, key=lambda t: t[1])[2] and all(0 < t[1] < 10 for t in trials)
