"""Metrics, summaries, rankings, attribution tables, variance components and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow import fixtures
from furrow.functions.stats import mean_std_se, nan_mean, regression_metrics
from furrow.operators import attribution, evaluation, folds, variance
from furrow.operators.profile import with_missing_band
from furrow.schema import CATEGORICAL, FEATURE_LABELS, NUMERIC, SUBSETS
from furrow.sources.tables import read_results, write_result
from verification.profile_queries import corr_sql
from verification.registry import assemble, known, mart, predictions, query, scratch

METRICS_SQL = ("count(y_true) AS n, sqrt(avg((y_true - y_pred) ** 2)) AS rmse, avg(abs(y_true - y_pred)) AS mae, "
               + corr_sql("y_true", "y_pred") + " AS pearson_r, CASE WHEN count(y_true) < 2 THEN NULL "
               "WHEN min(y_true) < max(y_true) THEN 1 - sum((y_true - y_pred) ** 2) / nullif(var_pop(y_true) * count(y_true), 0) "
               "WHEN sum((y_true - y_pred) ** 2) = 0 THEN 1 ELSE 0 END AS r2")
METRIC_DOUBLES = ["rmse", "mae", "pearson_r", "r2"]


def subset_ctes(source: str, keys: str = "model, fold", subsets=SUBSETS) -> dict[str, str]:
    """Rows by subset and their metrics over the full domain."""
    listed = ", ".join(f"('{s}')" for s in subsets)
    joined = " AND ".join(f"d.{k} = m.{k}" for k in keys.split(", "))
    return {
        "labels": f"SELECT * FROM (VALUES {listed}) v(subset)",
        "sub": f"SELECT p.*, subset FROM {source} p JOIN labels ON subset = 'all' OR subset = lower(env_type) "
               "OR subset = missing_band WHERE y_true IS NOT NULL",
        "met0": f"SELECT {keys}, subset, {METRICS_SQL} FROM sub GROUP BY {keys}, subset",
        "met": f"SELECT d.*, coalesce(m.n, 0) AS n, rmse, mae, pearson_r, r2 FROM (SELECT * FROM (SELECT DISTINCT {keys} "
               f"FROM {source}) CROSS JOIN labels) d LEFT JOIN met0 m ON {joined} AND d.subset = m.subset",
    }


def spearman_ctes(source: str, keys: str = "model, fold") -> dict[str, str]:
    joined = " AND ".join(f"d.{k} = m.{k}" for k in keys.split(", "))
    labels = "(SELECT * FROM (VALUES ('all'), ('ne'), ('med')) v(subset))"
    return {
        "gm": f"SELECT {keys}, subset, name1, round(avg(y_true), 12) AS t, round(avg(y_pred), 12) AS p FROM {source} "
              f"JOIN {labels} ON subset = 'all' OR subset = lower(env_type) WHERE y_true IS NOT NULL AND y_pred IS NOT NULL "
              f"GROUP BY {keys}, subset, name1",
        "rk": f"SELECT *, rank() OVER (PARTITION BY {keys}, subset ORDER BY t) + (count(*) OVER (PARTITION BY {keys}, subset, t) "
              f"- 1) / 2.0::DOUBLE AS rt, rank() OVER (PARTITION BY {keys}, subset ORDER BY p) + (count(*) OVER "
              f"(PARTITION BY {keys}, subset, p) - 1) / 2.0::DOUBLE AS rp FROM gm",
        "spm0": f"SELECT {keys}, subset, {corr_sql('rt', 'rp')} AS spearman, count(*) AS n_groups FROM rk GROUP BY {keys}, subset",
        "spm": f"SELECT d.*, spearman, coalesce(n_groups, 0) AS n_groups FROM (SELECT * FROM (SELECT DISTINCT {keys} "
               f"FROM {source}) CROSS JOIN {labels}) d LEFT JOIN spm0 m ON {joined} AND d.subset = m.subset",
    }


@query("A23_regression_metrics",
       assemble(f"SELECT model, fold, {METRICS_SQL} FROM predictions WHERE y_true IS NOT NULL GROUP BY model, fold",
                ["predictions"], METRIC_DOUBLES))
def regression(spark, sf_dir):
    metrics = regression_metrics(F.col("y_true"), F.col("y_pred"))
    return (predictions(spark, sf_dir).where("y_true is not null").groupBy("model", "fold")
            .agg(*[m.alias(n) for n, m in metrics.items()]))


@query("A23_constant_prediction",
       assemble(f"SELECT fold, {METRICS_SQL} FROM (SELECT fold, y_true, 4.5::DOUBLE AS y_pred FROM predictions "
                "WHERE y_true IS NOT NULL) GROUP BY fold", ["predictions"], METRIC_DOUBLES))
def constant_prediction(spark, sf_dir):
    metrics = regression_metrics(F.col("y_true"), F.lit(4.5))
    return (predictions(spark, sf_dir).where("y_true is not null").groupBy("fold")
            .agg(*[m.alias(n) for n, m in metrics.items()]))


@query("A24_metrics_by_subset", assemble("SELECT * FROM met", ["predictions"], METRIC_DOUBLES, subset_ctes("predictions")))
def metrics_by_subset(spark, sf_dir):
    return evaluation.subset_metrics(predictions(spark, sf_dir), ["model", "fold"])


@query("A25_mean_std_se",
       assemble("SELECT subset, avg(rmse) AS rmse_mean, CASE WHEN count(rmse) > 0 THEN coalesce(stddev_samp(rmse), 0) END AS rmse_std, "
                "CASE WHEN count(rmse) > 0 THEN coalesce(stddev_samp(rmse), 0) END / nullif(sqrt(count(rmse)), 0) AS rmse_se, "
                "count(rmse) AS rmse_n FROM met GROUP BY subset", ["predictions"], ["rmse_mean", "rmse_std", "rmse_se"],
                subset_ctes("predictions")))
def mean_std(spark, sf_dir):
    metrics = evaluation.subset_metrics(predictions(spark, sf_dir), ["model", "fold"])
    return metrics.groupBy("subset").agg(*mean_std_se(F.col("rmse"), "rmse"))


@query("A26_fold_means",
       assemble("SELECT subset, avg(mae) AS mae, avg(pearson_r) AS pearson_r, avg(r2) AS r2 FROM met GROUP BY subset",
                ["predictions"], ["mae", "pearson_r", "r2"], subset_ctes("predictions")))
def fold_means(spark, sf_dir):
    metrics = evaluation.subset_metrics(predictions(spark, sf_dir), ["model", "fold"])
    return metrics.groupBy("subset").agg(*[nan_mean(F.col(m)).alias(m) for m in ("mae", "pearson_r", "r2")])


@query("A27_group_spearman", assemble("SELECT * FROM spm", ["predictions"], ["spearman"], spearman_ctes("predictions")))
def group_spearman(spark, sf_dir):
    return evaluation.group_spearman(predictions(spark, sf_dir), ["model", "fold"])


@query("A28_fold_bookkeeping",
       assemble("SELECT o.fold, (SELECT count(*) FROM b) - count(*) AS train_total_n, "
                "(SELECT count(*) FROM b WHERE kept) - count(*) FILTER (WHERE kept) AS train_kept_n, "
                "((SELECT count(*) FROM b WHERE kept) - count(*) FILTER (WHERE kept)) / ((SELECT count(*) FROM b) - count(*))::DOUBLE "
                "AS train_kept_frac, count(*) AS test_total_n, count(o_a_score) AS test_scored_n FROM b o GROUP BY o.fold",
                ["banded"], ["train_kept_frac"],
                {"b": "SELECT CAST(year % 5 AS INT) AS fold, o_a_score, f <= 0.3 AND o_a_score IS NOT NULL AS kept FROM banded"}))
def fold_bookkeeping(spark, sf_dir):
    rows = with_missing_band(known(spark, sf_dir)).withColumn("fold", (F.col("year") % 5).cast("int"))
    return evaluation.fold_bookkeeping(rows, "o_a_score", "missing_frac", 0.3)


# Results of two one-trait predictors under every missingness threshold.
RESULTS = {"res": "SELECT model, threshold, sqrt(avg((o_a_score - p) ** 2)) AS rmse_all_mean FROM ("
                  "SELECT 'appearance' AS model, f, o_a_score, appearance AS p FROM banded UNION ALL "
                  "SELECT 'tubersize', f, o_a_score, tubersize FROM banded) JOIN (SELECT i / 10::DOUBLE AS threshold FROM range(1, 11) r(i)) "
                  "ON f <= threshold WHERE o_a_score IS NOT NULL AND p IS NOT NULL GROUP BY model, threshold",
           "thr": "SELECT threshold, avg(rmse_all_mean) AS rmse_all_mean_avg_models, min(rmse_all_mean) AS rmse_all_mean_best_model, "
                  "min_by(model, rmse_all_mean) AS best_model_at_threshold FROM res GROUP BY threshold"}
THRESHOLD_DOUBLES = ["threshold", "rmse_all_mean_avg_models", "rmse_all_mean_best_model"]


def results(spark, sf_dir):
    rows = with_missing_band(known(spark, sf_dir))
    long = rows.select("missing_frac", "o_a_score", "appearance", "tubersize").unpivot(
        ["missing_frac", "o_a_score"], ["appearance", "tubersize"], "model", "p")
    steps = F.explode(F.array(*[F.lit(i / 10) for i in range(1, 11)]))
    return (long.withColumn("threshold", steps).where("missing_frac <= threshold AND o_a_score IS NOT NULL AND p IS NOT NULL")
            .groupBy("model", "threshold").agg(F.sqrt(F.avg(F.pow(F.col("o_a_score") - F.col("p"), F.lit(2)))).alias("rmse_all_mean")))


@query("A29_threshold_summary", assemble("SELECT * FROM thr", ["banded"], THRESHOLD_DOUBLES, RESULTS))
def threshold_summary(spark, sf_dir):
    return evaluation.threshold_summary(results(spark, sf_dir))


@query("A30_threshold_selection",
       assemble("SELECT threshold AS selected_threshold, s AS best_score FROM (SELECT threshold, round(rmse_all_mean_avg_models, 9) AS s "
                "FROM thr ORDER BY s, threshold DESC LIMIT 1)", ["banded"], ["selected_threshold", "best_score"], RESULTS))
def threshold_selection(spark, sf_dir):
    summary = evaluation.threshold_summary(results(spark, sf_dir))
    fixed = summary.withColumn("rmse_all_mean_avg_models", F.round("rmse_all_mean_avg_models", 9))
    return evaluation.select_threshold(fixed)


@query("O1_rank_models",
       assemble("SELECT * FROM (SELECT location AS model, round(avg(o_a_score), 6) AS rmse, round(avg(appearance), 6) AS spearman FROM mart "
                "GROUP BY location ORDER BY rmse ASC, spearman DESC, model LIMIT 10)", ["mart"], ["rmse", "spearman"]))
def rank_models(spark, sf_dir):
    table = mart(spark, sf_dir).groupBy(F.col("location").alias("model")).agg(
        F.round(F.avg("o_a_score"), 6).alias("rmse"), F.round(F.avg("appearance"), 6).alias("spearman"))
    return evaluation.rank_models(table, 10, "rmse", "spearman")


@query("O2_result_curves", assemble("SELECT model, threshold, rmse_all_mean FROM res ORDER BY model, threshold", ["banded"],
                                    ["threshold", "rmse_all_mean"], RESULTS))
def result_curves(spark, sf_dir):
    return evaluation.result_curves(results(spark, sf_dir))


@query("E10_threshold_curves",
       assemble("SELECT model, threshold, rmse_all_mean FROM res", ["banded"], ["threshold", "rmse_all_mean"], RESULTS))
def threshold_curves(spark, sf_dir):
    """Child runs stored with text parameters, read back as numeric curves; runs without a threshold are dropped."""
    table = results(spark, sf_dir).withColumn("threshold", F.col("threshold").cast("string"))
    broken = table.limit(1).withColumn("threshold", F.lit("n/a"))
    root = f"{scratch(spark)}/results"
    write_result(table, root, "missing_threshold", "parent-1", "good", "runs")
    write_result(broken, root, "missing_threshold", "parent-1", "broken", "runs")
    return evaluation.result_curves(read_results(spark, root, "missing_threshold", "runs", "parent-1"), "parent-1")


@query("O3_arg_min_label",
       assemble("SELECT threshold, best_model_at_threshold FROM thr", ["banded"], ["threshold"], RESULTS))
def arg_min_label(spark, sf_dir):
    return evaluation.threshold_summary(results(spark, sf_dir)).select("threshold", "best_model_at_threshold")


@query("U1_union_of_folds",
       assemble("SELECT fold, y_true, y_pred, missing_band FROM predictions", ["predictions"], ["y_true", "y_pred"]))
def union_of_folds(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("fold", "y_true", "y_pred", "missing_band")
    return evaluation.union_folds([rows.where(F.col("fold") == f) for f in range(5)])


# ---- attribution: contributions of simple linear weights on the traits and one-hot columns

WEIGHTS = {c: (i % 4 - 1.5) / 2 for i, c in enumerate(NUMERIC)}
LABELS_SQL = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{label}'" for f, label in FEATURE_LABELS.items()) + " ELSE replace(feature, '_', ' ') END"
CONTRIBUTIONS = {
    "con": " UNION ALL ".join(f"SELECT env_type, 'num_values__{c}' AS encoded, {w}::DOUBLE * coalesce({c}, 0) AS value FROM mart"
                              for c, w in WEIGHTS.items())
           + "".join(f" UNION ALL SELECT env_type, concat('cat__{c}_', v), CASE WHEN {c} = v THEN 0.25::DOUBLE ELSE 0 END FROM mart, "
                     f"(SELECT DISTINCT {c} AS v FROM mart)" for c in CATEGORICAL),
    "orig": "SELECT env_type, encoded, abs(value) AS a, CASE "
            + " ".join(f"WHEN split_part(encoded, '__', 2) = '{f}' OR starts_with(split_part(encoded, '__', 2), '{f}_') THEN '{f}'"
                       for f in [*NUMERIC, *CATEGORICAL]) + " END AS feature FROM con",
    "imp": f"SELECT subset, {LABELS_SQL} AS feature, sum(m) AS importance FROM (SELECT subset, encoded, feature, avg(a) AS m FROM orig "
           "JOIN (VALUES ('all'), ('ne'), ('med')) v(subset) ON subset = 'all' OR subset = lower(env_type) GROUP BY subset, encoded, feature) "
           "GROUP BY ALL",
}


def contributions(spark, sf_dir):
    rows = mart(spark, sf_dir)
    items = [F.struct(F.lit(f"num_values__{c}").alias("encoded"), (F.lit(w) * F.coalesce(F.col(c), F.lit(0.0))).alias("value"))
             for c, w in WEIGHTS.items()]
    for c, values in (("env_type", ["MED", "NE"]), ("trial_type", ["PROCESS", "UNKNOWN", "WARE"]),
                      ("soil_type", ["CLAY", "SAND", "UNKNOWN"])):
        items += [F.struct(F.lit(f"cat__{c}_{v}").alias("encoded"),
                           F.when(F.col(c) == v, F.lit(0.25)).otherwise(F.lit(0.0)).alias("value")) for v in values]
    return rows.select("env_type", F.inline(F.array(*items)))


@query("V21_original_feature_names",
       assemble(f"SELECT DISTINCT encoded, feature, {LABELS_SQL} AS label FROM orig", ["mart"], extra=CONTRIBUTIONS))
def original_names(spark, sf_dir):
    feature = attribution.original_feature(F.col("encoded"))
    return (contributions(spark, sf_dir).select("encoded", feature.alias("feature"), attribution.feature_label(feature).alias("label"))
            .distinct())


@query("A31_importance_by_feature", assemble("SELECT * FROM imp", ["mart"], ["importance"], CONTRIBUTIONS))
def importance_by_feature(spark, sf_dir):
    return attribution.importance(contributions(spark, sf_dir))


@query("J5_aligned_comparison",
       assemble('SELECT feature, coalesce(max(importance) FILTER (WHERE subset = \'ne\'), 0) AS "NE", '
                'coalesce(max(importance) FILTER (WHERE subset = \'med\'), 0) AS "MED" FROM imp GROUP BY feature', ["mart"],
                ["NE", "MED"], CONTRIBUTIONS))
def aligned_comparison(spark, sf_dir):
    return attribution.compare_environments(attribution.importance(contributions(spark, sf_dir)))


@query("A32_rank_agreement",
       assemble(f"SELECT {corr_sql('n', 'm')} AS rank_agreement FROM (SELECT rank() OVER (ORDER BY ne) + (count(*) OVER (PARTITION BY ne) - 1) "
                "/ 2.0::DOUBLE AS n, rank() OVER (ORDER BY med) + (count(*) OVER (PARTITION BY med) - 1) / 2.0::DOUBLE AS m FROM (SELECT feature, "
                "round(max(importance) FILTER (WHERE subset = 'ne'), 12) AS ne, round(max(importance) FILTER (WHERE subset = 'med'), 12) AS med "
                "FROM imp GROUP BY feature))", ["mart"], ["rank_agreement"], CONTRIBUTIONS))
def rank_agreement(spark, sf_dir):
    return attribution.rank_agreement(attribution.importance(contributions(spark, sf_dir)))


# ---- variance components

def _det(m) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a}*({e}*{i}-{f}*{h})-{b}*({d}*{i}-{f}*{g})+{c}*({d}*{h}-{e}*{g}))"


def _variance_sql(parts: list[str]) -> tuple[str, dict[str, str]]:
    env = "concat_ws('_', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    left = [["(N-k1)", "(k3-k2)", "(k3-k12)"], ["(k4-k1)", "(N-k2)", "(k4-k12)"], ["(k1-k4)", "(k2-k3)", "(N-k3-k4+k12)"]]
    right = ["(Tg-Tm-(a-1)*r)", "(Te-Tm-(b-1)*r)", "(Tge-Tg-Te+Tm-(s-a-b+1)*r)"]
    solved = [f"greatest({_det([[right[x] if y == j else left[x][y] for y in range(3)] for x in range(3)])}/{_det(left)}, 0)"
              for j in range(3)]
    ctes = {
        "cells": f"SELECT name1 AS g, {env} AS e, count(*)::DOUBLE AS n, sum(o_a_score) AS s, var_pop(o_a_score) AS v FROM mart GROUP BY 1, 2",
        "gm": "SELECT g, sum(n) AS m, sum(s) AS t, sum(n*n) AS q FROM cells GROUP BY g",
        "em": "SELECT e, sum(n) AS m, sum(s) AS t, sum(n*n) AS q FROM cells GROUP BY e",
        "one": "SELECT c.*, g.*, h.*, Sy*Sy/N AS Tm, W/(N-s) AS r, gmm/N AS k1, emm/N AS k2, nn/N AS k12 FROM "
               "(SELECT sum(n) AS N, sum(s) AS Sy, count(*)::DOUBLE AS s, sum(n*v) AS W, sum(n*n) AS nn, sum(s*s/n) AS Tge FROM cells) c, "
               "(SELECT sum(t*t/m) AS Tg, sum(m*m) AS gmm, sum(q/m) AS k3, count(*)::DOUBLE AS a FROM gm) g, "
               "(SELECT sum(t*t/m) AS Te, sum(m*m) AS emm, sum(q/m) AS k4, count(*)::DOUBLE AS b FROM em) h",
        "vc": f"SELECT {solved[0]} AS v0, {solved[1]} AS v1, {solved[2]} AS v2, greatest(r, 0) AS v3 FROM one",
    }
    rows = " UNION ALL ".join(f"SELECT '{name}' AS component, v{i} AS variance, 100*v{i}/(v0+v1+v2+v3) AS pct FROM vc" for i, name in
                              enumerate(["name1", "environment", "name1:environment", "residual"]))
    return rows, ctes


for _name, _parts in variance.ENV_DEFINITIONS.items():
    _body, _extra = _variance_sql(_parts)

    @query(f"A33_variance_components_{_name}", assemble(_body, ["mart"], ["variance", "pct"], _extra))
    def variance_components(spark, sf_dir, parts=tuple(_parts)):
        return variance.variance_components(mart(spark, sf_dir), list(parts))


@query("A34_environment_effect",
       assemble("SELECT *, mean_med - mean_ne AS difference, (mean_med - mean_ne) / sqrt(var_ne/n_envs_ne + var_med/n_envs_med) AS welch_t, "
                "(var_ne/n_envs_ne + var_med/n_envs_med) ** 2 / ((var_ne/n_envs_ne) ** 2 / (n_envs_ne - 1) + (var_med/n_envs_med) ** 2 "
                "/ (n_envs_med - 1)) AS welch_df FROM (SELECT "
                + ", ".join(f"count(m) FILTER (WHERE env_type = '{e}') AS n_envs_{e.lower()}, avg(m) FILTER (WHERE env_type = '{e}') AS "
                            f"mean_{e.lower()}, var_samp(m) FILTER (WHERE env_type = '{e}') AS var_{e.lower()}" for e in ("NE", "MED"))
                + " FROM (SELECT env_type, concat_ws('_', location, CAST(year AS VARCHAR)) AS e, avg(o_a_score) AS m FROM mart GROUP BY 1, 2))",
                ["mart"], ["mean_ne", "var_ne", "mean_med", "var_med", "difference", "welch_t", "welch_df"]))
def environment_effect(spark, sf_dir):
    return variance.environment_effect(mart(spark, sf_dir))


# ---- folds

def fold_ctes(source: str, k: int) -> dict[str, str]:
    zeros = ", ".join(["0"] * k)
    return {
        "gs": f"SELECT g, n, row_number() OVER (ORDER BY n DESC, md5(g)) AS rn FROM (SELECT coalesce(name1, '<NA>') AS g, "
              f"count(*) AS n FROM {source} GROUP BY 1)",
        "asg": f"SELECT CAST(0 AS BIGINT) AS rn, CAST([{zeros}] AS BIGINT[]) AS loads, CAST(-1 AS BIGINT) AS fold UNION ALL SELECT gs.rn, "
               "list_transform(asg.loads, lambda x, i: CASE WHEN i = list_position(asg.loads, list_min(asg.loads)) THEN x + gs.n ELSE x END), "
               "list_position(asg.loads, list_min(asg.loads)) - 1 FROM asg JOIN gs ON gs.rn = asg.rn + 1",
        "fmap": "SELECT g, CAST(fold AS INT) AS fold FROM asg JOIN gs ON gs.rn = asg.rn",
        "folded": f"SELECT x.*, fmap.fold FROM {source} x JOIN fmap ON coalesce(x.name1, '<NA>') = fmap.g",
    }


@query("M1_grouped_folds",
       assemble("SELECT name1, fold, count(*) AS n FROM folded GROUP BY ALL", ["known"], extra=fold_ctes("known", 5), recursive=True))
def grouped_folds(spark, sf_dir):
    return folds.group_kfold(known(spark, sf_dir), "name1", 5).groupBy("name1", "fold").agg(F.count("*").alias("n"))


@query("M1_folds_of_orders",
       assemble("SELECT name1, fold FROM (SELECT g AS name1, fold FROM fmap)", [],
                extra={"src": "SELECT CAST(o_custkey AS VARCHAR) AS name1 FROM orders", **fold_ctes("src", 7)}, recursive=True))
def folds_of_orders(spark, sf_dir):
    """Many groups of few sizes, so most choices are ties."""
    rows = fixtures.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("name1"))
    return folds.group_kfold(rows, "name1", 7).select("name1", "fold").distinct()


_NESTED = {
    **fold_ctes("known", 5),
    "gs2": "SELECT h.held_out, gs.g, gs.n, fmap.fold AS outer_fold, row_number() OVER (PARTITION BY held_out ORDER BY gs.n DESC, md5(gs.g)) AS rn "
           "FROM gs JOIN fmap ON gs.g = fmap.g JOIN (SELECT CAST(unnest(range(5)) AS INT) AS held_out) h ON fmap.fold <> h.held_out",
    "asg2": "SELECT CAST(unnest(range(5)) AS INT) AS held_out, CAST(0 AS BIGINT) AS rn, CAST([0, 0, 0] AS BIGINT[]) AS loads, CAST(-1 AS BIGINT) AS fold "
            "UNION ALL SELECT gs2.held_out, gs2.rn, list_transform(asg2.loads, lambda x, i: CASE WHEN i = list_position(asg2.loads, "
            "list_min(asg2.loads)) THEN x + gs2.n ELSE x END), list_position(asg2.loads, list_min(asg2.loads)) - 1 FROM asg2 JOIN gs2 "
            "ON gs2.rn = asg2.rn + 1 AND gs2.held_out = asg2.held_out",
}


@query("M2_nested_folds",
       assemble('SELECT gs2.g AS "group", gs2.outer_fold, gs2.held_out, CAST(asg2.fold AS INT) AS inner_fold FROM asg2 JOIN gs2 '
                "ON gs2.rn = asg2.rn AND gs2.held_out = asg2.held_out", ["known"], extra=_NESTED, recursive=True))
def nested_folds(spark, sf_dir):
    return folds.nested_folds(known(spark, sf_dir), "name1", 5, 3)


@query("J3_group_overlap",
       assemble("SELECT name1 FROM (SELECT DISTINCT name1 FROM known WHERE env_type = 'NE') JOIN (SELECT DISTINCT name1 FROM known "
                "WHERE env_type = 'MED') USING (name1)", ["known"]))
def group_overlap(spark, sf_dir):
    rows = known(spark, sf_dir)
    return folds.leaked_groups(rows.where("env_type = 'NE'"), rows.where("env_type = 'MED'"), "name1")
