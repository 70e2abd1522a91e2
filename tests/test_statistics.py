import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from furrow.functions.order_stats import average_rank, exact_percentiles, value_counts_long
from furrow.functions.stats import mean_std_se, regression_metrics
from furrow.operators import evaluation, features, folds, knn
from furrow.operators.models import ModelSpec, fit_model
from furrow.operators.variance import variance_components
from furrow.plans import experiments as ex
from verification.registry import mart


def _skewed(n=6000, seed=1):
    rng = np.random.default_rng(seed)
    values = np.where(rng.random(n) < 0.4, 7.0, rng.normal(50, 20, n).round(3))
    groups = np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 20, n).astype(str))
    return pd.DataFrame({"g": groups, "v": values, "i": np.arange(n)})


def test_percentiles_and_ranks_under_skew(spark):
    pdf = _skewed()
    df = spark.createDataFrame(pdf)
    got = exact_percentiles(value_counts_long(df, ["v"], ["g"]), ["g"], {"q1": 0.25, "q2": 0.5, "q3": 0.9}).toPandas().set_index("g")
    want = pdf.groupby("g")["v"].quantile([0.25, 0.5, 0.9]).unstack()
    for name, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.9)):
        assert np.allclose(got[name].sort_index(), want[p].sort_index())
    ranks = average_rank(df, "v", ["g"]).toPandas().sort_values("i")["rank"].to_numpy()
    assert np.allclose(ranks, pdf.groupby("g")["v"].rank().to_numpy())


def test_mean_std_se(spark):
    rows = [(1, 1.0), (1, 3.0), (1, float("nan")), (2, 2.0), (3, None)]
    out = spark.createDataFrame(rows, "k int, v double").groupBy("k").agg(*mean_std_se(F.col("v"), "v")).orderBy("k").collect()
    assert [tuple(r)[1:] for r in out] == [(2.0, pytest.approx(math.sqrt(2)), pytest.approx(1.0), 2), (2.0, 0.0, 0.0, 1),
                                           (None, None, None, 0)]


def test_metrics_on_flat_groups(spark):
    df = spark.createDataFrame([(1, 5.0, 5.0), (1, 5.0, 5.0), (2, 5.0, 4.0), (2, 5.0, 6.0), (3, 1.0, 1.0)], "k int, y double, p double")
    rows = df.groupBy("k").agg(*[m.alias(n) for n, m in regression_metrics(F.col("y"), F.col("p")).items()]).orderBy("k").collect()
    assert [(r["r2"], r["pearson_r"]) for r in rows] == [(1.0, None), (0.0, None), (None, None)]


def test_threshold_tie_takes_the_largest(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.9, 0.8), (1.0, 0.8)], "threshold double, rmse_all_mean_avg_models double")
    assert evaluation.select_threshold(df).collect()[0]["selected_threshold"] == 1.0


def _greedy(sizes, k):
    import hashlib

    loads, out = [0] * k, {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], hashlib.md5(x[0].encode()).hexdigest())):
        b = loads.index(min(loads))
        out[g], loads[b] = b, loads[b] + n
    return out


@pytest.mark.parametrize("k", [2, 3, 7])
def test_folds_equal_the_greedy_walk(spark, k):
    rng = np.random.default_rng(k)
    sizes = {f"g{i}": int(n) for i, n in enumerate(np.concatenate([rng.integers(1, 6, 400), rng.integers(1, 200, 40), [3000]]))}
    df = spark.createDataFrame(list(sizes.items()), "group string, size long")
    got = {r["group"]: r["fold"] for r in folds.assign_folds(df, k).collect()}
    assert got == _greedy(sizes, k)


def test_too_few_groups(spark):
    with pytest.raises(Exception, match="n_splits"):
        folds.group_kfold(spark.createDataFrame([("a",), ("b",)], "g string"), "g", 3).collect()


def test_leakage_is_an_error(spark):
    df = spark.createDataFrame([("a",), ("b",)], "g string")
    with pytest.raises(AssertionError, match="both the fitted and the tested"):
        folds.assert_no_leakage(df, df.where("g = 'a'"), "g")
    folds.assert_no_leakage(df.where("g = 'b'"), df.where("g = 'a'"), "g")


@pytest.mark.parametrize("width", [2, 6])
def test_knn_against_brute_force_with_a_hot_point(spark, width):
    rng = np.random.default_rng(width)
    points = rng.normal(0, 1, (900, width))
    points[:300] = points[0]  # a third of all rows are copies
    query = np.vstack([rng.normal(0, 1, (60, width)), points[:40]])
    train = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<double>")
    asked = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(query)], "id long, vector array<double>")
    got = knn.knn_join(train, asked, 4, block_rows=64).toPandas().sort_values(["query_id", "rank"])
    for i, q in enumerate(query):
        distance = np.sqrt(((points - q) ** 2).sum(axis=1))
        want = np.lexsort((np.arange(len(points)), distance.round(12)))[:4]
        assert got[got["query_id"] == i]["neighbour_id"].tolist() == want.tolist()


@pytest.mark.parametrize("k", [3, 130])
def test_leaks_of_all_folds_in_one_aggregate(spark, k):
    top = k - 1
    rows = [("apart", 0, "NE"), ("apart", 0, "MED"), ("leaks", 1, "NE"), ("leaks", top, "MED"), ("fitted only", 0, "NE"), ("fitted only", top, "NE"),
            ("tested only", 0, "MED"), ("tested only", 1, "MED"), (None, 1, "NE"), (None, 1, "MED"), ("mixed", top, "NE"), ("mixed", top, "MED"), ("mixed", 0, "MED")]
    data = spark.createDataFrame(rows, "g string, fold int, env string")
    train, test = F.col("env") == "NE", F.col("env") == "MED"
    want = {g for f in range(k) for g in {r[0] for r in rows if r[2] == "NE" and r[1] != f} & {r[0] for r in rows if r[2] == "MED" and r[1] == f}}
    assert {r["group"] for r in folds.leaking_groups(data, "g", train, test, k).collect()} == want == {"leaks", "mixed"}
    with pytest.raises(AssertionError, match="both the fitted and the tested"):
        folds.assert_folds_apart(data, "g", train, test, k)
    folds.assert_folds_apart(data.where("g = 'apart' OR g IS NULL"), "g", train, test, k)


def _gathered(spark, n=4_000, width=8):
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 20, (25, width))
    points = centres[rng.integers(0, 25, n)] + rng.normal(0, 1, (n, width))
    return points, spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<double>")


def test_knn_skips_cells_of_gathered_points(spark, monkeypatch):
    points, frame = _gathered(spark)
    work, inner = [], knn._candidates

    def counting(stored, visited, sizes, *rest):
        work.append(sum(int(sizes[r["cell"]]) for r in visited.select("cell").collect()))
        return inner(stored, visited, sizes, *rest)

    monkeypatch.setattr(knn, "_candidates", counting)
    asked = frame.where("id % 20 = 0")
    got = knn.knn_join(frame, asked, 5).toPandas().sort_values(["query_id", "rank"])
    for i in range(0, len(points), 20):
        distance = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        assert got[got["query_id"] == i]["neighbour_id"].tolist() == np.lexsort((np.arange(len(points)), distance.round(12)))[:5].tolist()
    assert sum(work) < 0.25 * asked.count() * len(points)


def test_probed_cells_find_most_neighbours(spark):
    points, frame = _gathered(spark)
    asked = frame.where("id % 20 = 0")
    exact = {(r["query_id"], r["neighbour_id"]) for r in knn.knn_join(frame, asked, 5).collect()}
    found = {(r["query_id"], r["neighbour_id"]) for r in knn.knn_join(frame, asked, 5, probes=3).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_knn_of_points_far_from_the_origin(spark):
    rng = np.random.default_rng(12)
    points = 1e6 + rng.normal(0, 1, (300, 3)).round(2)
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<double>")
    got = knn.knn_join(frame, frame, 3).toPandas().sort_values(["query_id", "rank"])
    for i, p in enumerate(points):
        distance = knn._distances(points[i:i + 1], points)[0]
        assert got[got["query_id"] == i]["neighbour_id"].tolist() == np.lexsort((np.arange(300), distance))[:3].tolist()


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, 2, (200, 3)), rng.normal(5, 3, 200)
    df = spark.createDataFrame([(i, Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y))],
                               ["row_no", "features", "label"])
    model = fit_model(ModelSpec("ridge", {"alpha": 5.0}), df).native
    centred = x - x.mean(axis=0)
    want = np.linalg.solve(centred.T @ centred + 5.0 * np.eye(3), centred.T @ (y - y.mean()))
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-8)


def test_encoding_ignores_unknown_and_imputes_from_training(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, None)], "x double, c string")
    stats = features.full_statistics(train, ["x"])
    fitted = features.preprocessor("linear", ["x"], ["c"], stats).fit(train)
    test = spark.createDataFrame([(None, "zzz"), (3.0, None)], "x double, c string")
    rows = [r[0] for r in fitted.transform(test).select(vector_to_array("features")).collect()]
    std = np.std([1.0, 3.0, 2.0])
    assert np.allclose(rows[0], [0.0, 1.0, 0.0, 0.0, 0.0]) and np.allclose(rows[1], [1.0 / std, 0.0, 1.0, 0.0, 0.0])


def test_iterative_imputation_recovers_a_linear_column(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(0, 1, 300)
    rows = [(float(x), None if i % 5 == 0 else float(2 * x + 1)) for i, x in enumerate(a)]
    filled, _ = features.iterative_impute(spark.createDataFrame(rows, "a double, b double"), [], ["a", "b"], 3)
    assert filled.where(F.abs(F.col("b") - (2 * F.col("a") + 1)) > 1e-4).count() == 0


def test_knn_imputation_uses_reachable_donors(spark):
    rows = spark.createDataFrame([(0, 0.0, 10.0), (1, 1.0, 20.0), (2, 5.0, 50.0), (3, 0.2, None), (4, None, None)],
                                 "id long, a double, b double")
    out = {r["id"]: (r["a"], r["b"]) for r in knn.knn_impute(rows, rows, ["a", "b"], 2).collect()}
    assert out[3] == (0.2, 15.0) and out[4][1] == pytest.approx(80 / 3)


def test_contributions_sum_to_the_prediction_gap(spark, sf_dir):
    trained = ex.fit_all(ex.prepare(mart(spark, sf_dir)), ModelSpec("ridge", {"alpha": 1.0}))
    gaps = trained.model.predict(trained.training).select("row_no", "y_pred")
    mean = gaps.agg(F.avg("y_pred")).collect()[0][0]
    total = ex.linear_contributions(trained).groupBy("row_no").agg(F.sum("value").alias("s"))
    assert gaps.join(total, "row_no").where(F.abs(F.col("y_pred") - F.lit(mean) - F.col("s")) > 1e-6).count() == 0


def test_out_of_fold_scores_every_row_once(spark, sf_dir):
    data = ex.with_folds(ex.prepare(mart(spark, sf_dir)), 3)
    predictions = ex.out_of_fold(data, [ModelSpec("baseline_mean"), ModelSpec("ridge"), ModelSpec("knn")], 3)
    counts = {r["model"]: (r["n"], r["p"]) for r in predictions.groupBy("model").agg(
        F.count("*").alias("n"), F.count("y_pred").alias("p")).collect()}
    assert set(counts.values()) == {(data.count(), data.count())} and len(counts) == 3


def test_conditional_parameters():
    rng = np.random.default_rng(0)
    draws = [ex.sample_params(ex.KERNEL_SPACE, rng) for _ in range(50)]
    assert all(("gamma" in d) == (d["gamma_mode"] == "float") for d in draws)
    assert ex.model_params({"C": 1.0, "gamma_mode": "auto"}) == {"C": 1.0, "gamma": "auto"}


def test_variance_components_of_a_balanced_layout(spark):
    rng = np.random.default_rng(9)
    g, e = rng.normal(0, 2, 30), rng.normal(0, 1, 20)
    rows = [(f"g{i}", f"e{j}", 1, float(g[i] + e[j] + rng.normal(0, 0.5))) for i in range(30) for j in range(20) for _ in range(2)]
    df = spark.createDataFrame(rows, "name1 string, location string, year int, o_a_score double")
    out = {r["component"]: r["variance"] for r in variance_components(df, ["location", "year"]).collect()}
    assert out["name1"] == pytest.approx(np.var(g, ddof=1), rel=0.1) and out["residual"] == pytest.approx(0.25, rel=0.1)


def test_registered_knn_imputation_fills_all_coordinates(spark, sf_dir):
    from verification.model_queries import knn_imputation

    stored = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    given = np.array([r.embedding for r in stored], dtype=float)
    ids = np.array([r.vec_id for r in stored])
    given[(ids[:, None] + np.arange(given.shape[1])) % 7 == 0] = np.nan
    has = ~np.isnan(given)
    want = given.copy()
    for q in range(len(ids)):
        both = has & has[q]
        gaps = np.where(both, given - given[q], 0.0)
        distance = np.sqrt((gaps * gaps).sum(axis=1) * given.shape[1] / both.sum(axis=1))
        for j in np.flatnonzero(~has[q]):
            donors = np.flatnonzero(has[:, j])
            want[q, j] = given[donors[np.lexsort((ids[donors], distance[donors]))[:15]], j].mean()
    got = {r.vec_id: r for r in knn_imputation(spark, sf_dir).collect()}
    assert len(got) == len(ids) and len(got[ids[0]]) == 65
    for i, row in zip(ids, want):
        assert np.allclose([got[i][f"x{j}"] for j in range(64)], row, atol=1e-6)


def test_registered_attribution_of_the_tuned_booster(spark, sf_dir, monkeypatch):
    from furrow.schema import FEATURE_LABELS
    from verification.registry import QUERIES

    fitted = []
    fit_all = ex.fit_all
    monkeypatch.setattr(ex, "fit_all", lambda df, spec, *rest: fitted.append(spec) or fit_all(df, spec, *rest))
    rows = QUERIES["E9_booster_attribution"](spark, sf_dir).collect()
    assert fitted == [ModelSpec("xgb", ex.TUNED_BOOSTER)]
    features = [*ex.Roles().numeric, *ex.Roles().categorical]
    assert {r.feature for r in rows if r.subset == "all"} == {FEATURE_LABELS.get(f, f.replace("_", " ")) for f in features}
    assert any(r.importance > 0 for r in rows)
