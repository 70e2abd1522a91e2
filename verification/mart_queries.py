"""Staging, enrichment, mart, lookups and data checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from furrow import fixtures
from furrow.functions.cleaning import classify, within
from furrow.operators import checks, enrich
from furrow.plans import medallion
from furrow.schema import MART_COLS, MERGE_KEY, NUMERIC, SCORES, SOIL_TYPE_RULES, TRIAL_TYPE_RULES
from furrow.sources import tables
from verification.registry import assemble, current, mart, query, scratch

_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


@query("E11_mart_end_to_end", assemble("SELECT * FROM mart", ["mart"], ["o_a_score", *NUMERIC]))
def mart_rows(spark, sf_dir):
    return mart(spark, sf_dir)


@query("P7_mart_projection", assemble("SELECT * FROM mart", ["mart"], ["o_a_score", *NUMERIC]))
def mart_projection(spark, sf_dir):
    return enrich.analysis_mart(current(spark, sf_dir)).select(*MART_COLS)


@query("P5_staging_rename",
       assemble("SELECT name1, CAST(plot AS BIGINT) AS plot, load_id, record_id AS business_key, "
                f"source_file AS source_file_name, {_TS.format('valid_from')}, {_TS.format('valid_to')} FROM history",
                ["history"]))
def staging_rename(spark, sf_dir):
    staged = enrich.stage_trials(fixtures.history(spark, sf_dir))
    return staged.select("name1", "plot", "load_id", "business_key", "source_file_name",
                         *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("valid_from", "valid_to")])


@query("P6_integer_casts",
       assemble("SELECT CAST(plot AS BIGINT) AS plot, CAST(year AS BIGINT) AS year, "
                "CAST(source_row AS BIGINT) AS source_row_number FROM history", ["history"]))
def integer_casts(spark, sf_dir):
    return enrich.stage_trials(fixtures.history(spark, sf_dir)).select("plot", "year", "source_row_number")


@query("V4_current_versions", assemble("SELECT name1, plot, record_id AS business_key FROM history WHERE valid_to IS NULL",
                                       ["history"]))
def current_versions(spark, sf_dir):
    staged = enrich.stage_trials(fixtures.history(spark, sf_dir))
    return enrich.current_versions(staged).select("name1", "plot", "business_key")


@query("V5_range_to_null",
       assemble("SELECT plot, " + ", ".join(f"CASE WHEN {c} < 0 OR {c} > 9 THEN NULL ELSE {c} END AS {c}" for c in SCORES)
                + " FROM trials", ["trials"], SCORES))
def range_to_null(spark, sf_dir):
    return fixtures.trials(spark, sf_dir).select("plot", *[within(F.col(c), 0.0, 9.0).alias(c) for c in SCORES])


@query("V6_coalesced_yield", assemble("SELECT plot, yield FROM current", ["current"], ["yield"]))
def coalesced_yield(spark, sf_dir):
    return current(spark, sf_dir).select("plot", "yield")


@query("V7_trial_type",
       assemble("SELECT experiment_name, CASE WHEN lower(experiment_name) LIKE '%process%' THEN 'PROCESS' "
                "WHEN lower(experiment_name) LIKE '%ware%' THEN 'WARE' ELSE 'UNKNOWN' END AS trial_type, count(*) AS n "
                "FROM dirty GROUP BY ALL", ["dirty"]))
def trial_type(spark, sf_dir):
    return (fixtures.dirty(spark, sf_dir)
            .select("experiment_name", classify(F.col("experiment_name"), TRIAL_TYPE_RULES).alias("trial_type"))
            .groupBy("experiment_name", "trial_type").agg(F.count("*").alias("n")))


@query("V8_soil_type",
       assemble("SELECT experiment_name, CASE WHEN lower(experiment_name) LIKE '%clay%' THEN 'CLAY' "
                "WHEN lower(experiment_name) LIKE '%sand%' THEN 'SAND' ELSE 'UNKNOWN' END AS soil_type, count(*) AS n "
                "FROM dirty GROUP BY ALL", ["dirty"]))
def soil_type(spark, sf_dir):
    return (fixtures.dirty(spark, sf_dir)
            .select("experiment_name", classify(F.col("experiment_name"), SOIL_TYPE_RULES).alias("soil_type"))
            .groupBy("experiment_name", "soil_type").agg(F.count("*").alias("n")))


@query("V9_default_environment",
       assemble("SELECT location, env_type, count(*) AS n FROM current GROUP BY ALL", ["current"]))
def default_environment(spark, sf_dir):
    return current(spark, sf_dir).groupBy("location", "env_type").agg(F.count("*").alias("n"))


@query("V10_mart_predicate", assemble("SELECT plot, env_type, o_a_score FROM mart", ["mart"], ["o_a_score"]))
def mart_predicate(spark, sf_dir):
    return mart(spark, sf_dir).select("plot", "env_type", "o_a_score")


@query("J1_lookup_join",
       assemble("SELECT t.plot, t.location, coalesce(e.env_type, 'UNKNOWN') AS env_type FROM trials t "
                "LEFT JOIN env e ON lower(trim(t.location)) = lower(trim(e.location))", ["trials", "env"]))
def lookup_join(spark, sf_dir):
    joined = enrich.with_environment(fixtures.trials(spark, sf_dir), fixtures.env_lookup(spark, sf_dir))
    return joined.select("plot", "location", "env_type")


@query("S10_seed_lookup", "SELECT env_type, count(*) AS n_locations, count(DISTINCT lower(trim(n_name))) AS n_keys FROM "
                          "(SELECT n_name, CASE WHEN n_regionkey < 2 THEN 'MED' ELSE 'NE' END AS env_type FROM nation "
                          "WHERE n_regionkey < 4) GROUP BY env_type")
def seed_lookup(spark, sf_dir):
    """The lookup written as CSV and read back by its declared schema."""
    path = f"{scratch(spark)}/lookup"
    fixtures.env_lookup(spark, sf_dir).write.option("header", True).csv(path)
    return (enrich.location_env_type(spark, path).groupBy("env_type")
            .agg(F.count("*").alias("n_locations"), F.count_distinct(F.lower(F.trim("location"))).alias("n_keys")))


@query("S11_projected_scan",
       assemble("SELECT name1, location, year, experiment_name, plot, env_type, o_a_score FROM mart", ["mart"],
                ["o_a_score"]))
def projected_scan(spark, sf_dir):
    return tables.scan_scored_rows(mart(spark, sf_dir))


@query("S12_snapshot_source", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def snapshot_source(spark, sf_dir):
    return tables.load_snapshot(spark, f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity")


@query("S15_view_and_table", assemble("SELECT env_type, count(*) AS n FROM mart GROUP BY env_type", ["mart"]))
def view_and_table(spark, sf_dir):
    tables.materialise_view(current(spark, sf_dir), "int_trials_current")
    return spark.sql("SELECT env_type, count(*) AS n FROM int_trials_current "
                     "WHERE o_a_score IS NOT NULL AND env_type IN ('MED', 'NE') GROUP BY env_type")


@query("S15_materialised_table", assemble("SELECT plot, year, env_type, o_a_score, yield FROM mart", ["mart"], ["o_a_score", "yield"]))
def materialised_table(spark, sf_dir):
    """The mart as a managed table, written twice, read by name."""
    for _ in range(2):
        name = tables.materialise_table(mart(spark, sf_dir), "mart_" + uuid.uuid4().hex[:8])
    return spark.table(name).select("plot", "year", "env_type", "o_a_score", "yield")


# ---- data checks

@query("A1_distinct_key_reconciliation",
       assemble("SELECT (SELECT count(*) FROM current) AS current_rows, (SELECT count(*) FROM (SELECT DISTINCT "
                f"{', '.join(MERGE_KEY)} FROM history WHERE valid_to IS NULL)) AS distinct_keys, "
                f"(SELECT count(*) FROM current) = (SELECT count(*) FROM (SELECT DISTINCT {', '.join(MERGE_KEY)} "
                "FROM history WHERE valid_to IS NULL)) AS equal", ["current"]))
def distinct_keys(spark, sf_dir):
    return checks.reconcile_keys(current(spark, sf_dir), fixtures.history(spark, sf_dir))


def _row_checks_sql(relation: str, suite: checks.Suite) -> str:
    parts = [f"SELECT 'not_null' AS \"check\", '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS failures "
             f"FROM {relation}" for c in suite.not_null]
    for c, values in suite.accepted.items():
        listed = ", ".join(f"'{v}'" for v in values)
        parts.append(f"SELECT 'accepted_values', '{c}', count(*) FILTER (WHERE {c} NOT IN ({listed})) FROM {relation}")
    parts += [f"SELECT 'accepted_range', '{c}', count(*) FILTER (WHERE {c} < {low} OR {c} > {high}) FROM {relation}"
              for c, (low, high) in suite.ranges.items()]
    parts += [f"SELECT 'unique', '{','.join(k)}', count(*) FROM (SELECT {', '.join(k)} FROM {relation} "
              f"GROUP BY {', '.join(k)} HAVING count(*) > 1)" for k in suite.unique]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) t(\"check\", \"column\", failures)"


NOT_NULL = checks.Suite(not_null=["name1", "year", "location", "experiment_name", "plot", "o_a_score"])


@query("A2_not_null", assemble(_row_checks_sql("dirty", NOT_NULL), ["dirty"]))
def not_null(spark, sf_dir):
    return checks.run_suite(fixtures.dirty(spark, sf_dir), NOT_NULL)


@query("A3_unique_keys",
       assemble(f"SELECT {', '.join(MERGE_KEY)}, count(*) AS n FROM current GROUP BY ALL HAVING count(*) > 1", ["current"]))
def unique_keys(spark, sf_dir):
    return checks.repeated_keys(current(spark, sf_dir), MERGE_KEY)


ACCEPTED = checks.Suite(accepted={"env_type": ["MED", "NE"], "trial_type": ["PROCESS", "UNKNOWN"]})


@query("A4_accepted_values", assemble(_row_checks_sql("current", ACCEPTED), ["current"]))
def accepted_values(spark, sf_dir):
    return checks.run_suite(current(spark, sf_dir), ACCEPTED)


RANGES = checks.Suite(ranges={**{c: (0.0, 9.0) for c in SCORES}, "finalyield": (0.0, 250.0)})


@query("A5_accepted_range", assemble(_row_checks_sql("trials", RANGES), ["trials"]))
def accepted_range(spark, sf_dir):
    return checks.run_suite(fixtures.trials(spark, sf_dir), RANGES)


@query("A6_unmapped_locations",
       assemble("SELECT location, count(*) AS n_rows FROM current WHERE env_type = 'UNKNOWN' GROUP BY location", ["current"]))
def unmapped_locations(spark, sf_dir):
    return checks.unmapped_locations(current(spark, sf_dir))


@query("A_full_check_suite", assemble(
    " UNION ALL ".join(f"SELECT *, '{label}' AS relation FROM ({_row_checks_sql(rel, suite)})" for label, rel, suite in (
        ("int_trials_current", "current", checks.CURRENT_SUITE), ("mart_overall_analysis", "mart", checks.MART_SUITE),
        ("stg_trials", "staged", checks.STAGING_SUITE), ("location_env_type", "env", checks.LOOKUP_SUITE))),
    ["mart"], extra={"staged": "SELECT *, record_id AS business_key, source_file AS source_file_name, "
                               "source_row AS source_row_number FROM history"}))
def full_check_suite(spark, sf_dir):
    lookup = fixtures.env_lookup(spark, sf_dir)
    staged = enrich.stage_trials(fixtures.history(spark, sf_dir))
    built, gold = medallion.build(fixtures.history(spark, sf_dir), lookup)
    return medallion.all_checks(staged, built, gold, lookup)
