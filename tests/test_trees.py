"""Forests and boosted trees by passes of histograms."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from furrow.operators import trees
from furrow.operators.models import ModelSpec, fit_model


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=2000), rng.integers(0, 5, 2000), rng.integers(0, 2, 2000)])
    y = np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2] + rng.normal(0, 0.1, 2000) + 100
    data = [(i, Vectors.dense(v), float(t)) for i, (v, t) in enumerate(zip(x.tolist(), y))]
    return spark.createDataFrame(data, ["row_no", "features", "label"]).repartition(3, "row_no").localCheckpoint()


def scored(model, rows):
    out = model.predict(rows).select("row_no", "label", "y_pred").orderBy("row_no").toPandas()
    return out["label"].to_numpy(), out["y_pred"].to_numpy()


def test_deep_forest_takes_few_jobs(spark, rows):
    sc = spark.sparkContext
    sc.setJobGroup("deep forest", "")
    try:
        model = fit_model(ModelSpec("rf", {"n_estimators": 20, "max_depth": 15}), rows)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("deep forest")) < 15  # less than one for each level
    label, found = scored(model, rows)
    assert np.mean((found - label) ** 2) < 0.05 * label.var()


def test_wide_nodes_give_the_trees_of_dealt_nodes(rows, monkeypatch):
    spec = ModelSpec("rf", {"n_estimators": 3, "max_depth": 6})
    whole = scored(fit_model(spec, rows), rows)[1]
    monkeypatch.setattr(trees, "NODE_ROWS", 200)
    monkeypatch.setattr(trees, "DEALT_ROWS", 900)
    monkeypatch.setattr(trees, "PASS_BYTES", 1 << 11)
    assert scored(fit_model(spec, rows), rows)[1] == pytest.approx(whole, abs=1e-9)


def test_first_split_is_the_best_one(rows):
    model = fit_model(ModelSpec("xgb", {"rounds": 1, "max_depth": 1, "subsample": 1.0}), rows)
    x = np.array([r["features"].toArray() for r in rows.orderBy("row_no").collect()])
    label, found = scored(model, rows)
    cuts = [(s, c) for s, edges in enumerate(model.native.bins.edges) for c in edges]
    errors = [sum(label[side].var() * side.sum() for side in (x[:, s] <= c, x[:, s] > c)) for s, c in cuts]
    slot, cut = cuts[int(np.argmin(errors))]
    left = x[:, slot] <= cut
    assert found == pytest.approx(np.where(left, label[left].mean(), label[~left].mean()))


def test_rounds_explain_more_and_gamma_less(rows):
    def error(**params):
        label, found = scored(fit_model(ModelSpec("xgb", {"learning_rate": 0.2, "max_depth": 3, **params}), rows), rows)
        return np.mean((found - label) ** 2)

    assert error(rounds=8) < error(rounds=2) < error(rounds=2, gamma=1e9)
    assert error(rounds=2, min_child_weight=900) > error(rounds=2)
    assert error(rounds=2, column_share="onethird") > error(rounds=2)


def test_saved_trees_predict_the_same(rows, tmp_path):
    model = fit_model(ModelSpec("xgb", {"rounds": 3, "max_depth": 3}), rows)
    PipelineModel(stages=[model.native]).write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m")).transform(rows).orderBy("row_no").select("y_pred").toPandas()["y_pred"]
    assert loaded.to_numpy() == pytest.approx(scored(model, rows)[1], abs=0)


def test_constant_label_and_slots(spark):
    rows = spark.range(20).select(F.col("id").alias("row_no"), F.lit(4.0).alias("label"))
    from pyspark.ml.functions import array_to_vector
    rows = rows.withColumn("features", array_to_vector(F.array(F.lit(1.0), F.col("row_no") * 1.0)))
    for spec in (ModelSpec("rf", {"n_estimators": 2}), ModelSpec("xgb", {"rounds": 2})):
        assert scored(fit_model(spec, rows), rows)[1] == pytest.approx([4.0] * 20)


def test_trained_booster_is_saved_with_its_stages(spark, sf_dir, tmp_path):
    from furrow.plans import experiments as ex
    from furrow.sources.tables import load_model, save_model
    from verification.registry import mart

    prepared = ex.prepare(mart(spark, sf_dir))
    trained = ex.fit_all(prepared, ModelSpec("xgb", {"rounds": 2, "max_depth": 2}))
    save_model(trained, ex.Roles(), str(tmp_path / "booster"), 0, 5)
    own = {r["row_no"]: r["y_pred"] for r in trained.model.predict(trained.training).select("row_no", "y_pred").collect()}
    found = load_model(str(tmp_path / "booster")).transform(prepared).select("row_no", "y_pred").collect()
    assert len(found) == len(own) and all(own[r["row_no"]] == r["y_pred"] for r in found)
