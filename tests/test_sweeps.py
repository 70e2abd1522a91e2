"""Sweeps score their runs without writing a row for each of them; the metrics are those of all rows at once."""

import pytest
from pyspark.sql import functions as F

from furrow.functions import order_stats
from furrow.functions.stats import regression_metrics
from furrow.operators import baselines, evaluation, folds
from furrow.operators.models import ModelSpec
from furrow.plans import experiments as ex
from furrow.schema import SUBSETS
from verification.registry import known

SF = "/root/testdata/sf0.001"
RUNS = [(name, t, name == "baseline_env_mean") for name in ("baseline_mean", "baseline_env_mean") for t in (0.0, 0.2, 1.0)]


@pytest.fixture(scope="module")
def data(spark):
    return ex.with_folds(ex.prepare(known(spark, SF)), 5)


def test_metrics_of_pooled_parts_are_those_of_the_rows(spark):
    rows = [("m", i % 2, ["NE", "MED", None, "OTHER"][i % 4], ["complete", "medium", "incomplete"][i % 3],
             None if i % 7 == 0 else 1e6 + i % 5 + i % 4, None if i % 11 == 0 else 1e6 + i % 3) for i in range(400)]
    rows += [("flat", 0, "NE", "complete", 2.0, 2.0), ("flat", 0, "NE", "complete", 2.0, 2.0), ("flat", 1, "MED", "medium", 2.0, 3.0),
             ("flat", 1, "NE", "medium", 2.0, 2.0), ("none", 0, "NE", "complete", None, 1.0), ("none", 1, "NE", "complete", 1.0, None)]
    df = spark.createDataFrame(rows, "model string, fold int, env_type string, missing_band string, y_true double, y_pred double")
    labels = F.filter(F.array_distinct(F.array(F.lit("all"), F.lower("env_type"), F.col("missing_band"))), lambda s: s.isin(*SUBSETS))
    expected = df.where("y_true IS NOT NULL").select("*", F.explode(labels).alias("subset")).groupBy("model", "fold", "subset").agg(
        *[m.alias(n) for n, m in regression_metrics(F.col("y_true"), F.col("y_pred")).items()])
    expected = {(r["model"], r["fold"], r["subset"]): r.asDict() for r in expected.collect()}
    found = evaluation.subset_metrics(df, ["model", "fold"]).collect()
    assert len(found) == 6 * len(SUBSETS)
    for r in found:
        other = expected.get((r["model"], r["fold"], r["subset"]), {"n": 0})
        for name in ("n", "rmse", "mae", "pearson_r", "r2"):
            assert r[name] == (None if other.get(name) is None else pytest.approx(other[name], rel=1e-9, abs=1e-9)), (r, other)


def test_means_of_all_thresholds_are_those_one_by_one(data):
    found = baselines.predict_means(data, 5, "o_a_score", "env_label", "missing_frac", RUNS).select("model", "threshold", "row_no", "y_pred")
    for model, threshold, by_env in RUNS:
        flagged = data.withColumn("kept", F.coalesce((F.col("missing_frac") <= threshold) & F.col("o_a_score").isNotNull(), F.lit(False)))
        one = (baselines.predict_env_mean(flagged, 5, "o_a_score", "env_label") if by_env
               else baselines.predict_mean(flagged, 5, "o_a_score")).select("row_no", F.col("y_pred").alias("expected"))
        both = found.where((F.col("model") == model) & (F.col("threshold") == threshold)).join(one, "row_no", "full")
        same = F.coalesce(F.abs(F.col("y_pred") - F.col("expected")) < 1e-9, F.col("y_pred").isNull() & F.col("expected").isNull())
        assert both.where(~same).isEmpty() and both.count() == data.count()


def _written(monkeypatch, run) -> int:
    """The most rows that are written at once."""
    seen, cut = [], evaluation.cut_lineage

    def counted(df, *more):
        out = cut(df, *more)
        seen.append(out.count())
        return out

    for module in (ex, evaluation, baselines, folds):
        monkeypatch.setattr(module, "cut_lineage", counted)
    run()
    return max(seen)


def test_no_sweep_writes_a_row_for_each_run(spark, data, monkeypatch):
    rows = data.count()
    specs = [ModelSpec("baseline_mean"), ModelSpec("baseline_env_mean"), ModelSpec("ridge", {"alpha": 1.0})]
    assert _written(monkeypatch, lambda: ex.threshold_sweep(known(spark, SF), specs, [0.5, 1.0])["results"].collect()) == rows
    assert _written(monkeypatch, lambda: ex.parameter_search(data, "ridge", {"alpha": ("log", 0.1, 10.0)}, 3, 5, 1)) < rows


def test_folds_are_sent_to_the_rows_and_not_dealt_with_them(spark, data, capsys):
    capsys.readouterr()
    folds.group_kfold(data.drop("fold"), "name1", 5).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_medians_of_sets_take_no_row_for_each_column(spark, data, capsys, monkeypatch):
    plans, cut = [], order_stats.cut_lineage

    def seen(df, *more):
        capsys.readouterr()
        df.explain()
        plans.append(capsys.readouterr().out)
        return cut(df, *more)

    monkeypatch.setattr(order_stats, "cut_lineage", seen)
    found = order_stats.set_medians(data, ["yield", "appearance"], "fold", {0: [1, 2, 3, 4], 1: [0]})
    got = {(r["set"], r["column"]): r["median"] for r in found.collect()}
    assert not any("Expand" in p for p in plans)
    for s, rows in ((0, data.where("fold <> 0")), (1, data.where("fold = 0"))):
        for c in ("yield", "appearance"):
            assert got[s, c] == pytest.approx(rows.agg(F.percentile(c, 0.5)).first()[0], abs=1e-9)


def test_transfers_share_the_folds_of_their_rows(spark, monkeypatch):
    made, given = [], ex.with_folds
    monkeypatch.setattr(ex, "with_folds", lambda *a: made.append(a) or given(*a))
    ex.environment_transfer(known(spark, SF), ModelSpec("baseline_mean"))
    assert len(made) == 4
