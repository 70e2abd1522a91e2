"""Model evaluation on one long predictions table: metrics by fold and subset, summaries, rankings, thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.cleaning import coerce_numeric
from furrow.functions.order_stats import average_rank
from furrow.functions.stats import mean_std_se, nan_mean, pooled_means, pooled_metrics, regression_moments, safe_corr
from furrow.schema import GROUP_SUBSETS, SUBSETS
from furrow.session import cut_lineage

MEAN_DIGITS = 12
METRICS = ["n", "rmse", "mae", "pearson_r", "r2"]


def _subset_labels(subsets: list[str], env: Column | None, band: Column | None) -> Column:
    labels = [F.lit("all")] + [F.lower(env) if env is not None else None, band]
    return F.filter(F.array_distinct(F.array(*[x for x in labels if x is not None])),
                    lambda s: s.isin(*subsets))


def subset_metrics(predictions: DataFrame, by: list[str], subsets: list[str] = SUBSETS) -> DataFrame:
    """Regression metrics per ``by`` and subset over rows with an observed target; empty subsets show n = 0.

    ``predictions`` has env_type (upper case), missing_band, y_true and y_pred. It is read once, here: its moments by environment and
    band are written, and subsets are made of those, so the predictions themselves need not be written for this.
    """
    parts = ["env_type", *(["missing_band"] if "missing_band" in predictions.columns else [])]
    labels = _subset_labels(subsets, F.col("env_type"), F.col("missing_band") if len(parts) > 1 else None)
    moments = regression_moments(F.col("y_true"), F.col("y_pred"))
    cells = cut_lineage(predictions.groupBy(*dict.fromkeys([*by, *parts])).agg(*[m.alias(name) for name, m in moments.items()]))
    scored = cells.select(*by, *moments, F.explode(labels).alias("subset"))
    means = scored.groupBy(*by, "subset").agg(*[m.alias(name) for name, m in pooled_means().items()])
    metrics = scored.join(means, [*by, "subset"]).groupBy(*by, "subset").agg(*[m.alias(name) for name, m in pooled_metrics().items()])
    domain = (cells.select(*by).distinct()
              .withColumn("subset", F.explode(F.array(*[F.lit(s) for s in subsets]))))
    return domain.join(metrics, [*by, "subset"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def group_spearman(predictions: DataFrame, by: list[str], group: str = "name1",
                   subsets: list[str] = GROUP_SUBSETS) -> DataFrame:
    """Rank correlation of the group means of truth and prediction, per ``by`` and subset, with the group count."""
    observed = predictions.where("y_true IS NOT NULL AND y_pred IS NOT NULL").where(F.col(group).isNotNull())
    partial = observed.groupBy(*by, "env_type", group).agg(
        F.sum("y_true").alias("t"), F.sum("y_pred").alias("p"), F.count("*").alias("n"))
    labels = _subset_labels(subsets, F.col("env_type"), None)
    means = (partial.select(*by, group, "t", "p", "n", F.explode(labels).alias("subset"))
             .groupBy(*by, "subset", group)
             .agg(*[F.round(F.sum(c) / F.sum("n"), MEAN_DIGITS).alias(c) for c in ("t", "p")]))
    # Means are float sums: rounding keeps equal means tied, and writing them once lets the rank lookup meet the same bits.
    stacked = cut_lineage(means.unpivot([*by, "subset", group], ["t", "p"], "side", "value"))
    ranked = average_rank(stacked, "value", [*by, "subset", "side"])
    sides = ranked.groupBy(*by, "subset", group).agg(
        *[F.max(F.when(F.col("side") == s, F.col("rank"))).alias(s) for s in ("t", "p")])
    measured = sides.groupBy(*by, "subset").agg(
        safe_corr(F.col("t"), F.col("p")).alias("spearman"), F.count("*").alias("n_groups"))
    domain = (predictions.select(*by).distinct()
              .withColumn("subset", F.explode(F.array(*[F.lit(s) for s in subsets]))))
    return domain.join(measured, [*by, "subset"], "left").withColumn("n_groups", F.coalesce("n_groups", F.lit(0)))


def fold_bookkeeping(df: DataFrame, target: str, missing_frac: str, threshold: float = 1.0) -> DataFrame:
    """Rows trained on, kept and scored per fold."""
    kept = (F.col(missing_frac) <= threshold) & F.col(target).isNotNull()
    own = df.groupBy("fold").agg(
        F.count("*").alias("test_total_n"), F.count(target).alias("test_scored_n"), F.count_if(kept).alias("__kept"))
    totals = own.agg(F.sum("test_total_n").alias("n"), F.sum("__kept").alias("kept"))
    n, all_kept = totals.select("n").scalar(), totals.select("kept").scalar()
    return own.select(
        "fold", (n - F.col("test_total_n")).alias("train_total_n"), (all_kept - F.col("__kept")).alias("train_kept_n"),
        ((all_kept - F.col("__kept")) / F.nullif((n - F.col("test_total_n")).cast("double"), F.lit(0.0)))
        .alias("train_kept_frac"),
        "test_total_n", "test_scored_n")


def long_metrics(metrics: DataFrame, by: list[str]) -> DataFrame:
    """(by..., subset, metric, value) form of a metrics frame."""
    return (metrics.select(*by, "subset", *[F.col(m).cast("double").alias(m) for m in METRICS])
            .unpivot([*by, "subset"], METRICS, "metric", "value"))


def summarise(metrics: DataFrame, by: list[str], spearman: DataFrame | None = None,
              subsets: list[str] = SUBSETS) -> DataFrame:
    """Means over folds of every metric and subset; RMSE over all rows also with std, standard error and count."""
    def of(metric: str, subset: str) -> Column:
        return F.when(F.col("subset") == subset, F.col(metric))

    means = [nan_mean(of(m, s)).alias(f"{m}_{s}_mean") for m in METRICS[1:] for s in subsets
             if (m, s) != ("rmse", "all")]
    summary = metrics.groupBy(*by).agg(*mean_std_se(of("rmse", "all"), "rmse_all"), *means)
    if spearman is None:
        return summary
    ranks = spearman.groupBy(*by).agg(
        *[nan_mean(of("spearman", s)).alias(f"spearman_variety_{s}_mean") for s in GROUP_SUBSETS])
    return summary.join(ranks, by, "left")


def rank_models(summary: DataFrame, n: int = 10, rmse: str = "rmse_all_mean",
                spearman: str = "spearman_variety_all_mean") -> DataFrame:
    """Best models first: lowest RMSE, then highest group rank correlation."""
    return summary.orderBy(F.asc_nulls_last(rmse), F.desc_nulls_last(spearman)).limit(n)


def threshold_summary(results: DataFrame) -> DataFrame:
    """Per threshold the mean and best RMSE over the models and the name of the best model."""
    rmse = F.col("rmse_all_mean")
    return results.groupBy("threshold").agg(
        nan_mean(rmse).alias("rmse_all_mean_avg_models"), F.min(rmse).alias("rmse_all_mean_best_model"),
        F.min_by("model", F.when(rmse.isNotNull(), F.struct(rmse, F.col("model")))).alias("best_model_at_threshold"))


SCORE_COLUMNS = {"avg_models_rmse": "rmse_all_mean_avg_models", "best_model_rmse": "rmse_all_mean_best_model"}


def select_threshold(summary: DataFrame, strategy: str = "avg_models_rmse") -> DataFrame:
    """The threshold with the lowest score; the largest one among ties."""
    if strategy not in SCORE_COLUMNS:
        raise ValueError(f"Unknown threshold selection strategy: {strategy}")
    score = SCORE_COLUMNS[strategy]
    return (summary.where(F.col(score).isNotNull()).orderBy(score, F.desc("threshold")).limit(1)
            .select(F.col("threshold").alias("selected_threshold"), F.col(score).alias("best_score")))


def union_folds(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def result_curves(runs: DataFrame, parent_run: str | None = None) -> DataFrame:
    """Threshold curves of the child runs: numeric threshold, incomplete runs dropped, sorted by model and threshold."""
    if parent_run is not None:
        runs = runs.where(F.col("parent_run") == parent_run)
    metrics = [c for c in ("rmse_all_mean", "mae_all_mean", "r2_all_mean") if c in runs.columns]
    return (coerce_numeric(runs, ["threshold", *metrics]).select("model", "threshold", *metrics)
            .na.drop(subset=["threshold", "model"]).orderBy("model", "threshold"))
