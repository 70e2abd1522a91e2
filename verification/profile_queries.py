"""Profiling aggregates of the mart."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from furrow.functions.order_stats import average_rank
from furrow.operators import profile
from furrow.schema import CATEGORICAL, NUMERIC, TARGET
from verification.registry import assemble, current, known, mart, query

ALL = [*NUMERIC, TARGET]


def _union(template: str, columns: list[str]) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


@query("A7_describe",
       assemble(_union("SELECT '{c}' AS \"column\", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
                       "min({c}) AS min, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, "
                       "quantile_cont({c}, 0.75) AS q3, max({c}) AS max FROM known", ALL), ["known"],
                ["mean", "std", "min", "q1", "median", "q3", "max"]))
def describe(spark, sf_dir):
    return profile.describe(known(spark, sf_dir), ALL)


@query("A8_value_counts",
       assemble(_union("SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM current WHERE {c} IS NOT NULL GROUP BY {c}",
                       CATEGORICAL), ["current"]))
def value_counts(spark, sf_dir):
    return profile.value_counts(current(spark, sf_dir))


def _histogram_sql(column: str, bins: int) -> str:
    return (f"SELECT CAST(b.bin AS INT) AS bin, lo + (hi - lo) / {bins}::DOUBLE * b.bin AS bin_low, "
            f"lo + (hi - lo) / {bins}::DOUBLE * (b.bin + 1) AS bin_high, coalesce(n, 0) AS n "
            f"FROM (SELECT unnest(range({bins})) AS bin) b, (SELECT min({column}) AS lo, max({column}) AS hi FROM known) l "
            f"LEFT JOIN (SELECT least(CAST(floor((v - lo) / ((hi - lo) / {bins}::DOUBLE)) AS INT), {bins - 1}) AS bin, "
            f"count(*) AS n FROM (SELECT {column} AS v FROM known WHERE {column} IS NOT NULL), "
            f"(SELECT min({column}) AS lo, max({column}) AS hi FROM known) GROUP BY 1) h ON h.bin = b.bin")


@query("A9_histogram_target", assemble(_histogram_sql(TARGET, 19), ["known"], ["bin_low", "bin_high"]))
def histogram_target(spark, sf_dir):
    return profile.histogram(known(spark, sf_dir), TARGET, 19)


@query("A9_histogram_yield", assemble(_histogram_sql("yield", 50), ["known"], ["bin_low", "bin_high"]))
def histogram_yield(spark, sf_dir):
    return profile.histogram(known(spark, sf_dir), "yield", 50)


def _box_sql(relation: str, column: str, by: str) -> str:
    return (f"SELECT d.{by}, '{column}' AS \"column\", count(v) AS n, any_value(q1) AS q1, any_value(median) AS median, "
            f"any_value(q3) AS q3, min(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low, "
            f"max(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high "
            f"FROM (SELECT {by}, {column} AS v FROM {relation} WHERE {column} IS NOT NULL) d JOIN (SELECT {by}, "
            f"quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.5) AS median, quantile_cont({column}, 0.75) AS q3 "
            f"FROM {relation} GROUP BY {by}) q ON d.{by} = q.{by} GROUP BY d.{by}")


BOX = ["q1", "median", "q3", "whisker_low", "whisker_high"]


@query("A10_box_by_environment", assemble(_box_sql("known", "yield", "env_type"), ["known"], BOX))
def box_by_environment(spark, sf_dir):
    return profile.box_summary(known(spark, sf_dir), ["yield"], ["env_type"])


@query("A10_box_by_band", assemble(_box_sql("banded", TARGET, "band"), ["banded"], BOX))
def box_by_band(spark, sf_dir):
    return profile.box_summary(profile.with_missing_band(known(spark, sf_dir)), [TARGET], ["band"])


def _stats_sql(relation: str, by: str) -> str:
    return (f"SELECT {by}, avg(o_a_score) AS mean, stddev_samp(o_a_score) AS std, count(o_a_score) AS count "
            f"FROM {relation} GROUP BY {by}")


@query("A11_environment_stats", assemble(_stats_sql("known", "env_type"), ["known"], ["mean", "std"]))
def environment_stats(spark, sf_dir):
    return profile.group_stats(known(spark, sf_dir), "env_type")


@query("A11_environment_std_ratio",
       assemble("SELECT std_ne, std_med, std_ne / nullif(std_med, 0) AS std_ratio FROM (SELECT "
                "stddev_samp(o_a_score) FILTER (WHERE env_type = 'NE') AS std_ne, "
                "stddev_samp(o_a_score) FILTER (WHERE env_type = 'MED') AS std_med FROM known)", ["known"],
                ["std_ne", "std_med", "std_ratio"]))
def environment_std_ratio(spark, sf_dir):
    return profile.environment_std_ratio(known(spark, sf_dir))


@query("A12_missing_percentages",
       assemble(_union("SELECT '{c}' AS \"column\", 100 * avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS missing_pct "
                       "FROM known", NUMERIC), ["known"], ["missing_pct"]))
def missing_percentages(spark, sf_dir):
    return profile.missing_percentages(known(spark, sf_dir))


@query("A13_band_counts",
       assemble("SELECT b.band, count(k.band) AS n, 100 * count(k.band) / (SELECT count(*) FROM banded)::DOUBLE AS pct "
                "FROM (VALUES ('complete'), ('medium'), ('incomplete')) b(band) LEFT JOIN banded k ON k.band = b.band "
                "GROUP BY b.band", ["banded"], ["pct"]))
def band_counts(spark, sf_dir):
    return profile.band_counts(known(spark, sf_dir))


@query("A14_informative_missingness", assemble(_stats_sql("banded", "band"), ["banded"], ["mean", "std"]))
def informative_missingness(spark, sf_dir):
    return profile.informative_missingness(known(spark, sf_dir))


@query("A15_threshold_counts",
       assemble(_union("SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} > 9) AS n_above, "
                       "count(*) FILTER (WHERE {c} = 0) AS n_zero FROM known", ALL), ["known"]))
def threshold_counts(spark, sf_dir):
    return profile.threshold_counts(known(spark, sf_dir), ALL)


@query("A16_iqr_outliers",
       assemble(_union("SELECT '{c}' AS \"column\", count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) "
                       "AS n_outliers, round(100 * count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) "
                       "/ count(*)::DOUBLE, 2) AS pct FROM (SELECT {c} AS v FROM known WHERE {c} IS NOT NULL), "
                       "(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM known)", NUMERIC),
                ["known"], ["pct"]))
def iqr_outliers(spark, sf_dir):
    return profile.iqr_outliers(known(spark, sf_dir))


def corr_sql(x: str, y: str) -> str:
    return (f"CASE WHEN min({x}) FILTER (WHERE {y} IS NOT NULL) < max({x}) FILTER (WHERE {y} IS NOT NULL) AND "
            f"min({y}) FILTER (WHERE {x} IS NOT NULL) < max({y}) FILTER (WHERE {x} IS NOT NULL) "
            f"THEN covar_pop({x}, {y}) / nullif(stddev_pop({x}) FILTER (WHERE {y} IS NOT NULL) * "
            f"stddev_pop({y}) FILTER (WHERE {x} IS NOT NULL), 0) END")


def _matrix_sql() -> str:
    cells = [f"SELECT '{a}' AS x, '{b}' AS y, {corr_sql(a, b)} AS r FROM known" for a, b in combinations(ALL, 2)]
    half = " UNION ALL ".join(cells)
    own = " UNION ALL ".join(f"SELECT '{c}', '{c}', CASE WHEN min({c}) < max({c}) THEN 1.0::DOUBLE END FROM known" for c in ALL)
    return f"SELECT * FROM half UNION ALL SELECT y, x, r FROM half UNION ALL {own}", {"half": half}


@query("A17_correlation_matrix", assemble(_matrix_sql()[0], ["known"], ["r"], _matrix_sql()[1]))
def correlation_matrix(spark, sf_dir):
    return profile.correlation_matrix(known(spark, sf_dir), ALL)


@query("A17_target_correlations",
       assemble(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", abs({corr_sql(c, TARGET)}) AS abs_r FROM known" for c in NUMERIC),
                ["known"], ["abs_r"]))
def target_correlations(spark, sf_dir):
    return profile.target_correlations(known(spark, sf_dir))


_SIZE_STATS = ("SELECT count(*) AS n_groups, CAST(min(s) AS BIGINT) AS min_size, quantile_cont(s, 0.5) AS median_size, "
               "CAST(max(s) AS BIGINT) AS max_size, count(*) FILTER (WHERE s >= 5) AS n_reached, "
               "count(*) FILTER (WHERE s >= 5) / count(*)::DOUBLE AS share_reached FROM ")


@query("A18_group_size_distribution",
       assemble(_SIZE_STATS + "(SELECT count(*)::DOUBLE AS s FROM known GROUP BY name1)", ["known"],
                ["median_size", "share_reached"]))
def group_size_distribution(spark, sf_dir):
    return profile.size_distribution(profile.group_sizes(known(spark, sf_dir)))


@query("A19_environment_coverage",
       assemble("SELECT coverage, count(*) FILTER (WHERE coverage = c) AS n_groups FROM (VALUES ('NE only'), ('MED only'), "
                "('both')) v(coverage), (SELECT CASE WHEN ne > 0 AND med > 0 THEN 'both' WHEN ne > 0 THEN 'NE only' "
                "WHEN med > 0 THEN 'MED only' END AS c FROM (SELECT location, count(*) FILTER (WHERE env_type = 'NE') AS ne, "
                "count(*) FILTER (WHERE env_type = 'MED') AS med FROM known GROUP BY location UNION ALL "
                "SELECT name1, count(*) FILTER (WHERE env_type = 'NE') AS ne, "
                "count(*) FILTER (WHERE env_type = 'MED') AS med FROM known GROUP BY name1)) "
                "GROUP BY coverage", ["known"]))
def environment_coverage(spark, sf_dir):
    """Coverage of varieties and of locations together, so that every class occurs."""
    rows = known(spark, sf_dir)
    by_location = rows.select(F.col("location").alias("name1"), "env_type")
    return profile.environment_coverage(rows.select("name1", "env_type").unionByName(by_location))


@query("A20_environments_per_group",
       assemble(_SIZE_STATS + "(SELECT count(DISTINCT concat_ws('_', location, CAST(year AS VARCHAR)))::DOUBLE AS s "
                "FROM known GROUP BY name1)", ["known"], ["median_size", "share_reached"]))
def environments_per_group(spark, sf_dir):
    return profile.size_distribution(profile.environments_per_group(known(spark, sf_dir)), size="n_envs")


def _count(where: str) -> str:
    return f"format('{{:,}}', (SELECT count(*) FROM banded WHERE {where}))"


_GROUPS = ("SELECT name1, count(*) AS n, count(*) FILTER (WHERE env_type = 'NE') AS ne, "
           "count(*) FILTER (WHERE env_type = 'MED') AS med FROM banded GROUP BY name1")


@query("A21_quality_summary", assemble(
    " UNION ALL ".join(f"SELECT '{m}' AS metric, {v} AS value" for m, v in {
        "total rows": _count("TRUE"),
        "varieties": "format('{:,}', (SELECT count(DISTINCT name1) FROM banded))",
        "sites": "CAST((SELECT count(DISTINCT location) FROM banded) AS VARCHAR)",
        "year span": "(SELECT concat(min(year), '–', max(year)) FROM banded)",
        "NE rows": _count("env_type = 'NE'"), "MED rows": _count("env_type = 'MED'"),
        "complete rows": _count("band = 'complete'"), "medium-missing rows": _count("band = 'medium'"),
        "incomplete rows": _count("band = 'incomplete'"),
        "mean missing-fraction (numeric)": "format('{:.3f}', (SELECT avg(f) FROM banded))",
        "target missing": _count("o_a_score IS NULL"), "target exact-zeros": _count("o_a_score = 0"),
        "varieties >=5 obs": "format('{:,}', (SELECT count(*) FROM g WHERE n >= 5))",
        "varieties in both envs": "format('{:,}', (SELECT count(*) FROM g WHERE ne > 0 AND med > 0))",
    }.items()), ["banded"], extra={"g": _GROUPS}))
def quality_summary(spark, sf_dir):
    return profile.quality_summary(known(spark, sf_dir))


@query("A22_dataset_summary",
       assemble("SELECT count(*) AS n_rows, count(DISTINCT name1) AS n_groups, count(DISTINCT location) AS n_locations, "
                "min(year) AS min_year, max(year) AS max_year, "
                "count(DISTINCT concat_ws('_', location, CAST(year AS VARCHAR))) AS n_env_loc_year, "
                "count(DISTINCT concat_ws('_', location, CAST(year AS VARCHAR), experiment_name)) AS n_env_loc_year_exp "
                "FROM mart", ["mart"]))
def dataset_summary(spark, sf_dir):
    return profile.dataset_summary(mart(spark, sf_dir))


@query("W1_average_rank",
       assemble("SELECT env_type, plot, yield, CASE WHEN yield IS NOT NULL THEN rank() OVER (PARTITION BY env_type ORDER BY yield) "
                "+ (count(*) OVER (PARTITION BY env_type, yield) - 1) / 2.0::DOUBLE END AS rank FROM known", ["known"],
                ["yield", "rank"]))
def average_ranks(spark, sf_dir):
    return average_rank(known(spark, sf_dir).select("env_type", "plot", "yield"), "yield", ["env_type"])
