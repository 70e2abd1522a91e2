"""Profiling aggregates of the mart: one wide pass where possible, exact quantiles from value counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.cleaning import environment_id, missing_band, missing_fraction
from furrow.functions.order_stats import exact_percentiles, percentiles, values_long
from furrow.functions.stats import safe_corr
from furrow.schema import BANDS, CATEGORICAL, ENV, GROUP, NUMERIC, TARGET

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _stack(aggregated: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """Turn the columns of a one-row frame into rows."""
    structs = [F.struct(*[value.alias(name) for name, value in row.items()]) for row in rows]
    return aggregated.select(F.inline(F.array(*structs)))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, std, min, quartiles and max per numeric column."""
    parts = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in columns for n, f in parts.items()])
    basics = _stack(wide, [{"column": F.lit(c), **{n: F.col(f"{c}__{n}") for n in parts}} for c in columns])
    quartiles = percentiles(df, columns, [], QUARTILES).drop("n_values")
    return basics.join(quartiles, "column", "left")


def value_counts(df: DataFrame, columns: list[str] = CATEGORICAL) -> DataFrame:
    """Rows per value of each categorical column, most frequent first."""
    return (df.select(*[F.col(c).cast("string").alias(c) for c in columns])
            .unpivot([], columns, "column", "value").where("value is not null")
            .groupBy("column", "value").agg(F.count("*").alias("n"))
            .orderBy("column", F.desc("n"), "value"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed; empty bins are kept."""
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    limits = values.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    low, high = limits.select("low").scalar(), limits.select("high").scalar()
    width = (high - low) / F.lit(float(bins))
    index = F.when(high == low, F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - low) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    filled = values.groupBy(index.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    domain = limits.select("low", "high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("high") - F.col("low")) / F.lit(float(bins))
    return (domain.join(filled, "bin", "left")
            .select("bin", (F.col("low") + step * F.col("bin")).alias("bin_low"),
                    (F.col("low") + step * (F.col("bin") + 1)).alias("bin_high"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n"))
            .orderBy("bin"))


def _fences() -> tuple[Column, Column]:
    spread = F.col("q3") - F.col("q1")
    return F.col("q1") - 1.5 * spread, F.col("q3") + 1.5 * spread


def box_summary(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Quartiles and whiskers (extreme values inside 1.5 IQR) per group; one row per (by..., column)."""
    keys = [*by, "column"]
    quartiles = percentiles(df, columns, by, QUARTILES)
    low, high = _fences()
    inside = F.col("value").between(low, high)
    same = reduce(lambda a, b: a & b, [F.col(f"v.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys])
    whiskers = (values_long(df, columns, by).alias("v").join(quartiles.alias("q"), same)
                .select(*[f"v.{k}" for k in keys], "value", *QUARTILES, "n_values"))
    return whiskers.groupBy(*keys).agg(
        F.max("n_values").alias("n"),
        *[F.max(q).alias(q) for q in QUARTILES],
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"))


def iqr_outliers(df: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """Values outside the 1.5 IQR fences per column, as a count and a percentage of the non-null values."""
    low, high = _fences()
    flagged = values_long(df, columns).join(percentiles(df, columns, [], {"q1": 0.25, "q3": 0.75}), "column")
    n_out = F.count_if((F.col("value") < low) | (F.col("value") > high))
    return (flagged.groupBy("column")
            .agg(n_out.alias("n_outliers"),
                 F.round(100 * n_out / F.max("n_values"), 2).alias("pct"))
            .orderBy(F.desc("pct"), "column"))


def group_stats(df: DataFrame, by: str, value: str = TARGET) -> DataFrame:
    return (df.where(F.col(by).isNotNull()).groupBy(by)
            .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count")))


def environment_std_ratio(df: DataFrame, value: str = TARGET) -> DataFrame:
    """Standard deviation of NE over that of MED."""
    ne, med = (F.stddev_samp(F.when(F.col(ENV) == e, F.col(value))) for e in ("NE", "MED"))
    return df.agg(ne.alias("std_ne"), med.alias("std_med")).withColumn(
        "std_ratio", F.col("std_ne") / F.nullif("std_med", F.lit(0.0)))


def missing_percentages(df: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """Percentage of missing values per column, highest first."""
    wide = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in columns])
    return (_stack(wide, [{"column": F.lit(c), "missing_pct": F.col(c)} for c in columns])
            .orderBy(F.desc("missing_pct"), "column"))


def with_missing_band(df: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    return (df.withColumn("missing_frac", missing_fraction(columns))
            .withColumn("band", missing_band(F.col("missing_frac"))))


def band_counts(df: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """Rows per completeness band, empty bands included, with the percentage of all rows."""
    banded = with_missing_band(df, columns)
    wide = banded.agg(F.count("*").alias("rows"), *[F.count_if(F.col("band") == b).alias(b) for b in BANDS])
    return _stack(wide, [{"band": F.lit(b), "n": F.col(b),
                          "pct": 100 * F.col(b) / F.nullif(F.col("rows").cast("double"), F.lit(0.0))}
                         for b in BANDS])


def informative_missingness(df: DataFrame, columns: list[str] = NUMERIC, target: str = TARGET) -> DataFrame:
    """Target statistics per completeness band."""
    return group_stats(with_missing_band(df, columns), "band", target)


def threshold_counts(df: DataFrame, columns: list[str] = NUMERIC, above: float = 9.0) -> DataFrame:
    """Per column: rows above a limit and rows that are exactly zero."""
    wide = df.agg(*[F.count_if(F.col(c) > above).alias(f"{c}__above") for c in columns],
                  *[F.count_if(F.col(c) == 0).alias(f"{c}__zero") for c in columns])
    return _stack(wide, [{"column": F.lit(c), "n_above": F.col(f"{c}__above"), "n_zero": F.col(f"{c}__zero")}
                         for c in columns])


def _cross_products(columns: list[str], centres: list[float]):
    """Per task: for every pair of columns the sums over the rows that have both, as masked matrix products."""
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, width, width))  # rows, x, x*x, x*y
        low, high = np.full((width, width), np.inf), np.full((width, width), -np.inf)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - centres
            there = ~np.isnan(x)
            filled, mask = np.where(there, x, 0.0), there.astype(float)
            total += [mask.T @ mask, filled.T @ mask, (filled * filled).T @ mask, filled.T @ filled]
            for j in range(width):
                rows = there[:, j]
                if rows.any():
                    low[:, j] = np.fmin(low[:, j], np.fmin.reduce(np.where(there, x, np.inf)[rows]))
                    high[:, j] = np.fmax(high[:, j], np.fmax.reduce(np.where(there, x, -np.inf)[rows]))
        i, j = (g.ravel() for g in np.indices((width, width)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(t.ravel()) for t in (
                *total, total[1].T, total[2].T, low, high, low.T, high.T))],
            ["i", "j", "n", "sx", "sxx", "sxy", "sy", "syy", "low_x", "high_x", "low_y", "high_y"])

    return run


def correlation_matrix(df: DataFrame, columns: list[str] = NUMERIC + [TARGET]) -> DataFrame:
    """Pairwise-complete Pearson correlations; both triangles and the diagonal.

    One pass for the means, which only keep the sums small, and one for masked matrix products: a task gives one row for each
    pair of columns, whatever its size.
    """
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    means = numbers.agg(*[F.avg(c).alias(c) for c in columns]).first()
    sums = ["n", "sx", "sxx", "sxy", "sy", "syy"]
    kinds = ", ".join(f"{c} double" for c in (*sums, "low_x", "high_x", "low_y", "high_y"))
    parts = numbers.mapInArrow(_cross_products(columns, [0.0 if m is None else m for m in means]), f"i int, j int, {kinds}")
    cells = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in ("low_x", "low_y")],
                                        *[F.max(c).alias(c) for c in ("high_x", "high_y")])
    n = F.nullif("n", F.lit(0.0))
    spread = F.sqrt(F.col("sxx") - F.col("sx") * F.col("sx") / n) * F.sqrt(F.col("syy") - F.col("sy") * F.col("sy") / n)
    varied = (F.col("low_x") < F.col("high_x")) & (F.col("low_y") < F.col("high_y"))
    r = F.when(varied & (F.col("i") == F.col("j")), F.lit(1.0)).when(
        varied, (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.nullif(spread, F.lit(0.0)))
    names = F.array(*map(F.lit, columns))
    return cells.select(names[F.col("i")].alias("x"), names[F.col("j")].alias("y"), r.alias("r"))


def target_correlations(df: DataFrame, columns: list[str] = NUMERIC, target: str = TARGET) -> DataFrame:
    """Absolute correlation of each column with the target, strongest first."""
    wide = df.agg(*[F.abs(safe_corr(F.col(c), F.col(target))).alias(c) for c in columns])
    return (_stack(wide, [{"column": F.lit(c), "abs_r": F.col(c)} for c in columns])
            .orderBy(F.desc("abs_r"), "column"))


def group_sizes(df: DataFrame, by: str = GROUP) -> DataFrame:
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("size"))


def size_distribution(sizes: DataFrame, at_least: int = 5, size: str = "size") -> DataFrame:
    """Minimum, median, maximum of the group sizes and how many groups reach a size."""
    by_size = sizes.groupBy(F.col(size).cast("double").alias("value")).agg(F.count("*").alias("n"))
    median = exact_percentiles(by_size, [], {"median": 0.5}).select("median").scalar()
    total = F.sum("n")
    reached = F.coalesce(F.sum(F.when(F.col("value") >= at_least, F.col("n"))), F.lit(0))
    return by_size.agg(
        total.alias("n_groups"), F.min("value").cast("long").alias("min_size"),
        F.max(median).alias("median_size"), F.max("value").cast("long").alias("max_size"),
        reached.alias("n_reached"), (reached / F.nullif(total.cast("double"), F.lit(0.0))).alias("share_reached"))


def environment_coverage(df: DataFrame, by: str = GROUP) -> DataFrame:
    """Groups seen in NE only, in MED only and in both."""
    pivot = (df.where(F.col(by).isNotNull()).groupBy(by).pivot(ENV, ["NE", "MED"]).count().fillna(0))
    ne, med = F.col("NE") > 0, F.col("MED") > 0
    wide = pivot.agg(F.count_if(ne & ~med).alias("a"), F.count_if(~ne & med).alias("b"), F.count_if(ne & med).alias("c"))
    return _stack(wide, [{"coverage": F.lit("NE only"), "n_groups": F.col("a")},
                         {"coverage": F.lit("MED only"), "n_groups": F.col("b")},
                         {"coverage": F.lit("both"), "n_groups": F.col("c")}])


def environments_per_group(df: DataFrame, by: str = GROUP) -> DataFrame:
    """Distinct location-year environments per group."""
    return (df.where(F.col(by).isNotNull())
            .select(by, environment_id("location", "year").alias("env_id")).distinct()
            .groupBy(by).agg(F.count("*").alias("n_envs")))


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, distinct groups, locations and environments, and the year span."""
    return df.agg(
        F.count("*").alias("n_rows"), F.count_distinct(GROUP).alias("n_groups"),
        F.count_distinct("location").alias("n_locations"),
        F.min("year").alias("min_year"), F.max("year").alias("max_year"),
        F.count_distinct(environment_id("location", "year")).alias("n_env_loc_year"),
        F.count_distinct(environment_id("location", "year", "experiment_name")).alias("n_env_loc_year_exp"))


def quality_summary(df: DataFrame) -> DataFrame:
    """The data-quality summary as (metric, value) text rows."""
    banded = with_missing_band(df)
    rows = banded.agg(
        F.count("*").alias("rows"), F.count_distinct(GROUP).alias("groups"),
        F.count_distinct("location").alias("sites"), F.min("year").alias("y0"), F.max("year").alias("y1"),
        *[F.count_if(F.col(ENV) == e).alias(e) for e in ("NE", "MED")],
        *[F.count_if(F.col("band") == b).alias(b) for b in BANDS],
        F.avg("missing_frac").alias("frac"), F.count_if(F.col(TARGET).isNull()).alias("no_target"),
        F.count_if(F.col(TARGET) == 0).alias("zero_target"))
    groups = (df.where(F.col(GROUP).isNotNull()).groupBy(GROUP)
              .agg(F.count("*").alias("n"), *[F.count_if(F.col(ENV) == e).alias(f"in_{e}") for e in ("NE", "MED")])
              .agg(F.count_if(F.col("n") >= 5).alias("large"),
                   F.count_if((F.col("in_NE") > 0) & (F.col("in_MED") > 0)).alias("both")))
    wide = rows.select("*", groups.select("large").scalar().alias("large"), groups.select("both").scalar().alias("both"))

    def number(name: str) -> Column:
        return F.format_number(F.col(name), 0)

    year = F.concat(F.col("y0").cast("string"), F.lit("–"), F.col("y1").cast("string"))
    # Names and texts of the summary.
    metrics = {
        "total rows": number("rows"), "varieties": number("groups"), "sites": F.col("sites").cast("string"),
        "year span": year, "NE rows": number("NE"), "MED rows": number("MED"),
        "complete rows": number("complete"), "medium-missing rows": number("medium"),
        "incomplete rows": number("incomplete"),
        "mean missing-fraction (numeric)": F.format_number(F.col("frac"), 3),
        "target missing": number("no_target"), "target exact-zeros": number("zero_target"),
        "varieties >=5 obs": number("large"), "varieties in both envs": number("both"),
    }
    return _stack(wide, [{"metric": F.lit(m), "value": v} for m, v in metrics.items()])
