"""Aggregates that stay defined on degenerate groups (ANSI mode raises on a zero denominator)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of the complete pairs; NULL for fewer than two pairs or no spread."""
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    varied = (F.min(xs) < F.max(xs)) & (F.min(ys) < F.max(ys))
    return F.when(varied, F.covar_pop(xs, ys) / F.nullif(F.stddev_pop(xs) * F.stddev_pop(ys), F.lit(0.0)))


def regression_metrics(truth: Column, predicted: Column) -> dict[str, Column]:
    """Aggregates n, rmse, mae, pearson_r, r2 over rows with both values.

    R2 follows the usual convention on a constant truth: 1 for a perfect fit, else 0; NULL below two rows.
    """
    both = truth.isNotNull() & predicted.isNotNull()
    y, p = F.when(both, truth), F.when(both, predicted)
    error = y - p
    squares = F.sum(error * error)
    spread = F.var_pop(y) * F.count(y)
    r2 = (F.when(F.count(y) < 2, F.lit(None).cast("double"))
          .when(F.min(y) < F.max(y), 1 - squares / F.nullif(spread, F.lit(0.0)))
          .when(squares == 0, F.lit(1.0))
          .otherwise(F.lit(0.0)))
    return {
        "n": F.count(y),
        "rmse": F.sqrt(F.avg(error * error)),
        "mae": F.avg(F.abs(error)),
        "pearson_r": safe_corr(y, p),
        "r2": r2,
    }


def regression_moments(truth: Column, predicted: Column) -> dict[str, Column]:
    """Aggregates of one part of the rows, from which ``pooled_metrics`` makes the metrics of any union of parts."""
    both = truth.isNotNull() & predicted.isNotNull()
    y, p = F.when(both, truth), F.when(both, predicted)
    error = y - p
    return {"count": F.count(y), "squares": F.sum(error * error), "sizes": F.sum(F.abs(error)),
            "mean_y": F.avg(y), "mean_p": F.avg(p), "var_y": F.var_pop(y), "var_p": F.var_pop(p), "covar": F.covar_pop(y, p),
            "min_y": F.min(y), "max_y": F.max(y), "min_p": F.min(p), "max_p": F.max(p)}


def pooled_means() -> dict[str, Column]:
    """Aggregates over parts: the means of truth and prediction over the rows of all parts."""
    total = F.nullif(F.sum("count").cast("double"), F.lit(0.0))
    return {f"pooled_{s}": F.sum(F.col("count") * F.col(f"mean_{s}")) / total for s in ("y", "p")}


def pooled_metrics() -> dict[str, Column]:
    """Aggregates over parts with their pooled means: the metrics of ``regression_metrics`` over the rows of all parts."""
    n, squares = F.sum("count"), F.sum("squares")
    total = F.nullif(n.cast("double"), F.lit(0.0))
    off = {s: F.col(f"mean_{s}") - F.col(f"pooled_{s}") for s in ("y", "p")}
    spread = {s: F.sum(F.col("count") * (F.col(f"var_{s}") + off[s] * off[s])) for s in ("y", "p")}
    common = F.sum(F.col("count") * (F.col("covar") + off["y"] * off["p"]))
    varied = {s: F.min(f"min_{s}") < F.max(f"max_{s}") for s in ("y", "p")}
    r2 = (F.when(n < 2, F.lit(None).cast("double"))
          .when(varied["y"], 1 - squares / F.nullif(spread["y"], F.lit(0.0)))
          .when(squares == 0, F.lit(1.0))
          .otherwise(F.when(n >= 2, F.lit(0.0))))
    corr = F.when(varied["y"] & varied["p"], common / F.nullif(F.sqrt(spread["y"]) * F.sqrt(spread["p"]), F.lit(0.0)))
    return {"n": n, "rmse": F.sqrt(squares / total), "mae": F.sum("sizes") / total, "pearson_r": corr, "r2": r2}


def mean_std_se(value: Column, prefix: str) -> list[Column]:
    """Mean, sample std (0 for one value), standard error and count, missing values skipped."""
    v = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    n = F.count(v)
    std = F.when(n > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0)))
    return [
        F.avg(v).alias(f"{prefix}_mean"),
        std.alias(f"{prefix}_std"),
        (std / F.nullif(F.sqrt(n.cast("double")), F.lit(0.0))).alias(f"{prefix}_se"),
        n.alias(f"{prefix}_n"),
    ]


def nan_mean(value: Column) -> Column:
    return F.avg(F.nanvl(value.cast("double"), F.lit(None).cast("double")))
