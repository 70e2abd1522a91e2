"""End-to-end experiments. The baseline forms have a SQL counterpart; some learned ones have one for what any seed must give."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from furrow.operators.models import ModelSpec
from furrow.plans import experiments as ex
from furrow.sources.tables import load_model, save_model
from verification.evaluation_queries import fold_ctes, spearman_ctes, subset_ctes
from verification.model_queries import FIT_SQL, fit_summary
from verification.registry import assemble, known, mart, query, scratch

BASELINES = [ModelSpec("baseline_mean"), ModelSpec("baseline_env_mean")]
RIDGE = ModelSpec("ridge", {"alpha": 1.0})
SMALL_FOREST = ModelSpec("rf", {"n_estimators": 8, "max_depth": 5})
SMALL_BOOSTER = ModelSpec("xgb", {"rounds": 5, "learning_rate": 0.3, "max_depth": 4})


def _baseline_ctes(thresholds: str) -> dict[str, str]:
    return {
        **fold_ctes("banded", 5), "held": "SELECT CAST(unnest(range(5)) AS INT) AS held_out",
        "ths": f"SELECT unnest({thresholds})::DOUBLE AS threshold",
        "gmean": "SELECT threshold, held_out, avg(o_a_score) AS m FROM folded JOIN held ON fold <> held_out JOIN ths ON f <= threshold "
                 "WHERE o_a_score IS NOT NULL GROUP BY ALL",
        "emean": "SELECT threshold, held_out, env_type AS e, avg(o_a_score) AS m FROM folded JOIN held ON fold <> held_out JOIN ths "
                 "ON f <= threshold WHERE o_a_score IS NOT NULL GROUP BY ALL",
        "rows_in": "SELECT *, concat_ws('|', name1, CAST(year AS VARCHAR), location, experiment_name, CAST(plot AS VARCHAR)) AS row_id FROM folded",
        "pred": "SELECT 'baseline_mean' AS model, threshold, fold, row_id, name1, env_type, band AS missing_band, o_a_score AS y_true, m AS y_pred "
                "FROM rows_in JOIN gmean ON fold = held_out UNION ALL SELECT 'baseline_env_mean', g.threshold, fold, row_id, name1, env_type, band, "
                "o_a_score, coalesce(e.m, g.m) FROM rows_in JOIN gmean g ON fold = g.held_out LEFT JOIN emean e ON fold = e.held_out "
                "AND env_type = e.e AND e.threshold = g.threshold",
    }


@query("E1_out_of_fold_predictions",
       assemble("SELECT model, fold, name1, env_type, missing_band, y_true, y_pred, y_true IS NOT NULL AS y_observed, row_id FROM pred",
                ["banded"], ["y_true", "y_pred"],
                _baseline_ctes("[1.0]"), True))
def out_of_fold(spark, sf_dir):
    data = ex.with_folds(ex.prepare(known(spark, sf_dir)), 5)
    return ex.out_of_fold(data, BASELINES, 5).drop("x_missing_frac")


@query("E1_ridge_predictions")
def ridge_predictions(spark, sf_dir):
    data = ex.with_folds(ex.prepare(known(spark, sf_dir)), 5)
    return ex.out_of_fold(data, [RIDGE], 5)


_MEANS = ", ".join(f"avg({m}) FILTER (WHERE subset = '{s}') AS {m}_{s}_mean" for m, s in
                   (("rmse", "ne"), ("rmse", "med"), ("mae", "all"), ("mae", "complete"), ("r2", "all"), ("r2", "incomplete"),
                    ("pearson_r", "med")))
_MEAN_NAMES = ["rmse_ne_mean", "rmse_med_mean", "mae_all_mean", "mae_complete_mean", "r2_all_mean", "r2_incomplete_mean", "pearson_r_med_mean"]
_RMSE = ("avg(rmse) FILTER (WHERE subset = 'all') AS rmse_all_mean, stddev_samp(rmse) FILTER (WHERE subset = 'all') AS rmse_all_std, "
         "stddev_samp(rmse) FILTER (WHERE subset = 'all') / sqrt(count(rmse) FILTER (WHERE subset = 'all')) AS rmse_all_se, "
         "count(rmse) FILTER (WHERE subset = 'all') AS rmse_all_n")


@query("E3_baseline_selection",
       assemble(f"SELECT s.*, k.spearman_variety_all_mean FROM (SELECT model, {_RMSE}, {_MEANS} FROM met GROUP BY model) s JOIN "
                "(SELECT model, avg(spearman) FILTER (WHERE subset = 'all') AS spearman_variety_all_mean FROM spm GROUP BY model) k "
                "USING (model)", ["banded"],
                ["rmse_all_mean", "rmse_all_std", "rmse_all_se", *_MEAN_NAMES, "spearman_variety_all_mean"],
                {**_baseline_ctes("[1.0]"), **subset_ctes("pred"), **spearman_ctes("pred")}, True))
def baseline_selection(spark, sf_dir):
    summary = ex.model_selection(known(spark, sf_dir), BASELINES)["ranking"]
    return summary.select("model", "rmse_all_mean", "rmse_all_std", "rmse_all_se", "rmse_all_n", *_MEAN_NAMES, "spearman_variety_all_mean")


@query("E3_model_selection")
def model_selection(spark, sf_dir):
    """Baselines and every distributed family, reduced tree counts."""
    specs = [*BASELINES, RIDGE, SMALL_FOREST, SMALL_BOOSTER, ModelSpec("svr", {"n_components": 32, "max_iter": 10})]
    return ex.model_selection(mart(spark, sf_dir), specs)["ranking"]


_THRESHOLDS = [i / 10 for i in range(1, 11)]


@query("E2_baseline_threshold_sweep",
       assemble("SELECT threshold, avg(r) AS rmse_all_mean_avg_models, min(r) AS rmse_all_mean_best_model FROM (SELECT model, threshold, "
                "avg(rmse) AS r FROM met WHERE subset = 'all' GROUP BY ALL) GROUP BY threshold", ["banded"],
                ["threshold", "rmse_all_mean_avg_models", "rmse_all_mean_best_model"],
                {**_baseline_ctes(str(_THRESHOLDS)), **subset_ctes("pred", "model, threshold, fold")}, True))
def baseline_threshold_sweep(spark, sf_dir):
    sweep = ex.threshold_sweep(known(spark, sf_dir), BASELINES, _THRESHOLDS)
    return sweep["summary"].drop("best_model_at_threshold")


@query("E2_threshold_sweep")
def threshold_sweep(spark, sf_dir):
    """Ridge on all features under all thresholds."""
    return ex.threshold_sweep(mart(spark, sf_dir), [RIDGE])["summary"]


# Ridge on two features, solved by Cramer's rule in SQL for every training set, way of filling and penalty.

PAIR = ex.Roles(numeric=["appearance", "tubersize"], categorical=[])
PLAIN = ex.Policy(indicators=False)
_SETS = "threshold, held_out"
_SINGLE = ("SELECT threshold, held_out, '{how}' AS strategy, {agg_a} AS fa, {agg_t} AS ft FROM tr GROUP BY threshold, held_out")
_FILLS = {
    "fm": _SINGLE.format(how="median", agg_a="quantile_cont(a, 0.5)", agg_t="quantile_cont(t, 0.5)"),
    "fa": _SINGLE.format(how="mean", agg_a="avg(a)", agg_t="avg(t)"),
}
# one round: appearance on the filled size, then size on the filled appearance
_CHAIN = {
    "c1": "SELECT threshold, held_out, regr_slope(a, coalesce(t, ft)) AS s1, regr_intercept(a, coalesce(t, ft)) AS i1 "
          "FROM tr JOIN fm USING (threshold, held_out) GROUP BY threshold, held_out",
    "c2": "SELECT threshold, held_out, regr_slope(t, coalesce(a, i1 + s1 * coalesce(t, ft))) AS s2, "
          "regr_intercept(t, coalesce(a, i1 + s1 * coalesce(t, ft))) AS i2 "
          "FROM tr JOIN fm USING (threshold, held_out) JOIN c1 USING (threshold, held_out) GROUP BY threshold, held_out",
}


def _filled(rows: str, chain: bool) -> str:
    """The rows of a (threshold, held_out) relation, once for each way of filling them."""
    plain = f"SELECT {_SETS}, strategy, row_id, fold, y, coalesce(a, fa) AS x1, coalesce(t, ft) AS x2 FROM {rows} JOIN "
    both = f"{plain} fm USING (threshold, held_out)"
    if chain:
        both += (f" UNION ALL {plain} fa USING (threshold, held_out) UNION ALL SELECT {_SETS}, 'iterative', row_id, fold, y, x1, coalesce(t, i2 + s2 * x1) "
                 f"FROM (SELECT {_SETS}, row_id, fold, y, t, i2, s2, coalesce(a, i1 + s1 * coalesce(t, ft)) AS x1 FROM {rows} "
                 "JOIN fm USING (threshold, held_out) JOIN c1 USING (threshold, held_out) JOIN c2 USING (threshold, held_out))")
    return both


def _pair_ctes(thresholds: str, alphas: str = "[1.0]", chain: bool = False) -> dict[str, str]:
    return {
        **fold_ctes("mart_rows", 5),
        "held": "SELECT CAST(unnest(range(5)) AS INT) AS held_out", "ths": f"SELECT unnest({thresholds})::DOUBLE AS threshold",
        "als": f"SELECT unnest({alphas})::DOUBLE AS alpha, unnest(range(len({alphas}))) AS trial",
        "pairs": "SELECT *, concat_ws('|', name1, CAST(year AS VARCHAR), location, experiment_name, CAST(plot AS VARCHAR)) AS row_id, o_a_score AS y, "
                 "appearance AS a, tubersize AS t, ((appearance IS NULL)::INT + (tubersize IS NULL)::INT) / 2.0::DOUBLE AS f2 FROM folded",
        "tr": "SELECT threshold, held_out, row_id, fold, a, t, y FROM pairs JOIN held ON fold <> held_out JOIN ths ON f2 <= threshold WHERE y IS NOT NULL",
        "te": "SELECT threshold, held_out, row_id, fold, a, t, y FROM pairs JOIN held ON fold = held_out, ths",
        **_FILLS, **(_CHAIN if chain else {}),
        "ftr": _filled("tr", chain), "fte": _filled("te", chain),
        "st": f"SELECT {_SETS}, strategy, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS d1, stddev_pop(x2) AS d2, "
              "covar_pop(x1, x2) AS v12, covar_pop(x1, y) AS v1, covar_pop(x2, y) AS v2 FROM ftr GROUP BY threshold, held_out, strategy",
        "ws": f"SELECT {_SETS}, strategy, trial, m1, m2, my, (k1 * s - k2 * s12) / (s * s - s12 * s12) / d1 AS b1, "
              "(k2 * s - k1 * s12) / (s * s - s12 * s12) / d2 AS b2 FROM (SELECT *, n + alpha AS s, n * v12 / (d1 * d2) AS s12, "
              "n * v1 / d1 AS k1, n * v2 / d2 AS k2 FROM st, als)",
        "rp": f"SELECT {_SETS}, strategy, trial, fold, row_id, y, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS y_pred "
              "FROM fte JOIN ws USING (threshold, held_out, strategy)",
        "re": "SELECT threshold, strategy, trial, fold, sqrt(avg((y - y_pred) ** 2)) AS rmse FROM rp WHERE y IS NOT NULL GROUP BY ALL",
    }


def _mart_rows(ctes: dict[str, str]) -> dict[str, str]:
    return {"mart_rows": "SELECT * FROM mart", **ctes}


@query("E1_ridge_two_columns",
       assemble("SELECT fold, row_id, y AS y_true, y_pred FROM rp", ["mart"], ["y_true", "y_pred"], _mart_rows(_pair_ctes("[1.0]")), True))
def ridge_two_columns(spark, sf_dir):
    data = ex.with_folds(ex.prepare(mart(spark, sf_dir), PAIR), 5, PAIR)
    return ex.out_of_fold(data, [RIDGE], 5, PAIR, PLAIN).select("fold", "row_id", "y_true", "y_pred")


@query("E2_ridge_sweep_two_columns",
       assemble("SELECT threshold, avg(rmse) AS rmse_all_mean, stddev_samp(rmse) AS rmse_all_std FROM re GROUP BY threshold", ["mart"],
                ["threshold", "rmse_all_mean", "rmse_all_std"], _mart_rows(_pair_ctes(str(_THRESHOLDS))), True))
def ridge_sweep(spark, sf_dir):
    """Ten thresholds from one table of sums."""
    sweep = ex.threshold_sweep(mart(spark, sf_dir), [RIDGE], _THRESHOLDS, roles=PAIR, policy=PLAIN)
    return sweep["results"].select("threshold", "rmse_all_mean", "rmse_all_std")


_ALPHA_SPACE = {"alpha": ("log", 1e-3, 1e3)}
_RNG = np.random.default_rng(42)
_ALPHAS = [ex.sample_params(_ALPHA_SPACE, _RNG)["alpha"] for _ in range(20)]


@query("E6_ridge_search_two_columns",
       assemble("SELECT CAST(trial AS INT) AS trial, avg(rmse) AS rmse FROM re GROUP BY trial", ["mart"], ["rmse"],
                _mart_rows(_pair_ctes("[1.0]", str(_ALPHAS))), True))
def ridge_search(spark, sf_dir):
    """Twenty penalties from one table of sums."""
    data = ex.with_folds(ex.prepare(mart(spark, sf_dir), PAIR), 5, PAIR)
    trials = ex.parameter_search(data, "ridge", _ALPHA_SPACE, 20, 5, 42, PAIR, PLAIN)[1]
    return ex.trials_frame(spark, trials).select("trial", "rmse")


@query("E4_imputation_two_columns",
       assemble("SELECT strategy, avg(rmse) AS rmse_all_mean, stddev_samp(rmse) AS rmse_all_std FROM re GROUP BY strategy", ["mart"],
                ["rmse_all_mean", "rmse_all_std"], _mart_rows(_pair_ctes("[1.0]", chain=True)), True))
def imputation_two_columns(spark, sf_dir):
    """Median, mean and one round of regressions before the same ridge."""
    ways = [("median", False), ("mean", False), ("iterative", False)]
    out = ex.imputation_comparison(mart(spark, sf_dir), [RIDGE], ways, roles=PAIR, native_reference=None, rounds=1)
    return out.select("strategy", "rmse_all_mean", "rmse_all_std")


@query("E4_imputation_comparison")
def imputation_comparison(spark, sf_dir):
    return ex.imputation_comparison(mart(spark, sf_dir), [RIDGE],
                                    [w for w in ex.IMPUTE_STRATEGIES if w[0] != "knn"], native_reference=SMALL_BOOSTER)


@query("E5_nested_tuning_kernel")
def nested_tuning_kernel(spark, sf_dir):
    """Twenty trials on three inner folds of each of five outer training sets: the operator's defaults."""
    return ex.nested_tuning(mart(spark, sf_dir), "svr", ex.KERNEL_SPACE, first=ex.KERNEL_BASELINE)["fold_metrics"]


@query("E6_parameter_search")
def parameter_search(spark, sf_dir):
    """Twenty penalties on all features."""
    data = ex.with_folds(ex.prepare(mart(spark, sf_dir)), 3)
    return ex.trials_frame(spark, ex.parameter_search(data, "ridge", _ALPHA_SPACE, 20, 3, 42)[1])


def _folds_named(prefix: str, source: str) -> dict[str, str]:
    names = fold_ctes(source, 5)
    return {f"{prefix}_{n}": re.sub(r"\b(gs|asg|fmap|folded)\b", rf"{prefix}_\1", text) for n, text in names.items()}


def _side(run: str, relation: str, where: str = "TRUE") -> str:
    return f"SELECT '{run}' AS run, fold, env_type, o_a_score FROM {relation}_folded WHERE {where}"


_RUNS = [("A_global_cv1", "every", "TRUE", "TRUE"), ("B_ne_only_cv1", "ne", "TRUE", "TRUE"), ("B_med_only_cv1", "med", "TRUE", "TRUE"),
         ("C_transfer_ne_to_med_unseen", "every", "env_type = 'NE'", "env_type = 'MED'"),
         ("C_transfer_med_to_ne_unseen", "every", "env_type = 'MED'", "env_type = 'NE'")]


@query("E7_baseline_transfer",
       assemble("SELECT run, avg(r) AS rmse_all_mean, avg(a) AS mae_all_mean, avg(ne) AS rmse_ne_mean, avg(med) AS rmse_med_mean FROM (SELECT run, fold, "
                "sqrt(avg((o_a_score - m) ** 2)) AS r, avg(abs(o_a_score - m)) AS a, sqrt(avg((o_a_score - m) ** 2) FILTER (WHERE env_type = 'NE')) AS ne, "
                "sqrt(avg((o_a_score - m) ** 2) FILTER (WHERE env_type = 'MED')) AS med FROM pr GROUP BY run, fold) GROUP BY run", ["mart"],
                ["rmse_all_mean", "mae_all_mean", "rmse_ne_mean", "rmse_med_mean"],
                {"ne_rows": "SELECT * FROM mart WHERE env_type = 'NE'", "med_rows": "SELECT * FROM mart WHERE env_type = 'MED'",
                 **_folds_named("every", "mart"), **_folds_named("ne", "ne_rows"), **_folds_named("med", "med_rows"),
                 "held": "SELECT CAST(unnest(range(5)) AS INT) AS held_out",
                 "tr": " UNION ALL ".join(_side(run, rows, train) for run, rows, train, _ in _RUNS),
                 "te": " UNION ALL ".join(_side(run, rows, test) for run, rows, _, test in _RUNS),
                 "mm": "SELECT run, held_out, avg(o_a_score) AS m FROM tr JOIN held ON fold <> held_out GROUP BY run, held_out",
                 "pr": "SELECT te.*, m FROM te JOIN mm ON te.run = mm.run AND fold = held_out WHERE o_a_score IS NOT NULL"}, True))
def baseline_transfer(spark, sf_dir):
    out = ex.environment_transfer(mart(spark, sf_dir), BASELINES[0])
    return out.select("run", "rmse_all_mean", "mae_all_mean", "rmse_ne_mean", "rmse_med_mean")


@query("E7_environment_transfer")
def environment_transfer(spark, sf_dir):
    return ex.environment_transfer(mart(spark, sf_dir), RIDGE)


@query("E8_production_training", FIT_SQL)
def production_training(spark, sf_dir):
    """Search of forty trials on five folds, refit, persist, load and score the mart with the loaded model."""
    folder = scratch(spark)
    rows = mart(spark, sf_dir)
    ex.production_training(rows, folder=folder)
    return fit_summary(load_model(folder).transform(rows).withColumnRenamed("o_a_score", "y_true"))


@query("E9_feature_attribution")
def feature_attribution(spark, sf_dir):
    return ex.feature_attribution(mart(spark, sf_dir), RIDGE)["comparison"]


@query("E9_permutation_importance")
def permutation_importance(spark, sf_dir):
    return ex.feature_attribution(mart(spark, sf_dir), SMALL_FOREST)["importance"]


@query("E9_booster_attribution")
def booster_attribution(spark, sf_dir):
    """The operator's default, the tuned booster."""
    return ex.feature_attribution(mart(spark, sf_dir))["importance"]


@query("S18_model_persistence", assemble("SELECT count(*) AS n_scored, TRUE AS same_predictions, TRUE AS beats_constant FROM mart", ["mart"]))
def model_persistence(spark, sf_dir):
    """The loaded model predicts what the model in memory predicts."""
    folder, rows = scratch(spark), ex.prepare(mart(spark, sf_dir))
    trained = ex.fit_all(rows, RIDGE)
    save_model(trained, ex.Roles(), folder, 0, ex.SAMPLE_ROWS)
    own = trained.model.predict(trained.training).select("row_no", "o_a_score", F.col("y_pred").alias("own"))
    both = load_model(folder).transform(rows).select("row_no", "y_pred").join(own, "row_no")
    error = F.avg(F.pow(F.col("y_pred") - F.col("o_a_score"), F.lit(2)))
    return both.agg(F.count("*").alias("n_scored"), (F.max(F.abs(F.col("y_pred") - F.col("own"))) < 1e-9).alias("same_predictions"),
                    (error < F.var_pop("o_a_score")).alias("beats_constant"))
