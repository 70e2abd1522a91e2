"""Headers, cleaning, validation, sources, versioned sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow import fixtures
from furrow.functions.cleaning import (
    coerce_numeric, environment_id, missing_band, missing_fraction, normalise_missing, row_id, text_to_double,
    upper_label,
)
from furrow.operators import headers, scd2
from furrow.operators.validate import validate
from furrow.schema import MERGE_KEY, NUMERIC, drop_columns
from furrow.session import cut_lineage
from furrow.sources import tables
from furrow.sources.drops import scan_drop
from furrow.sources.files import archive, discover, rename
from furrow.sources.versioned import (
    SchemaContractError, VersionedStore, fit_contract, schema_change_report, schema_changes,
)
from furrow.streaming.folder import stream_folder
from verification.registry import ORACLES, assemble, current, known, mart, query, scratch

# ---- headers

CLEAN_SQL = ("CASE WHEN c = '' THEN 'col' WHEN regexp_matches(c, '^[a-z]') THEN c ELSE concat('col_', c) END")
CLEANED = ("SELECT raw, " + CLEAN_SQL + " AS clean FROM (SELECT raw, trim(regexp_replace(replace(replace(replace(replace("
           "replace(replace(lower(raw), '>=', 'gte'), '<=', 'lte'), '>', 'gt'), '<', 'lt'), '%', 'percent'), '#', 'hash'), "
           "'[^a-z0-9]+', '_', 'g'), '_') AS c FROM raw_names)")


@query("P1_clean_column_name", assemble(CLEANED, ["raw_names"]))
def clean_names(spark, sf_dir):
    return headers.standardised_names(fixtures.raw_names(spark, sf_dir), "raw")


@query("P3_duplicate_headers",
       assemble(f"SELECT clean, count(*) AS n FROM ({CLEANED}) GROUP BY clean HAVING count(*) > 1", ["raw_names"]))
def duplicate_headers(spark, sf_dir):
    return headers.duplicate_names(fixtures.raw_names(spark, sf_dir), "raw")


@query("P2_alias_and_rename",
       "SELECT l_orderkey AS order_key, l_quantity AS qty_gte0, l_extendedprice AS col_2_price_percent FROM lineitem")
def alias_and_rename(spark, sf_dir):
    messy = fixtures.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias(" Order  Key "), F.col("l_quantity").alias("Quantity >=0"),
        F.col("l_extendedprice").alias("2 price_%"))
    return headers.standardise_header(messy, aliases={"quantity_gte0": "qty_gte0"}).data


@query("P4_drop_listed_columns", "SELECT l_partkey AS part, l_tax AS tax FROM lineitem")
def drop_listed(spark, sf_dir):
    messy = fixtures.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("Part"), F.col("l_tax").alias("Tax"), F.col("l_quantity").alias("Total #"),
        F.col("l_linenumber").alias("Block"), F.col("l_suppkey").alias("75-80 #"))
    return headers.standardise_header(messy, drop_columns()).data


@query("P8_required_columns", assemble("SELECT env_type, location, name1, o_a_score, year FROM mart", ["mart"],
                                       ["o_a_score"]))
def required_columns(spark, sf_dir):
    return headers.require_columns(mart(spark, sf_dir), ["year", "name1", "o_a_score", "env_type", "location", "name1"])


# ---- cleaning

NUMBER_SQL = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"


def _bare(c: str) -> str:
    return f"trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"


def _clean_text(c: str) -> str:
    b = _bare(c)
    return (f"CASE WHEN {b} = '' THEN NULL WHEN regexp_matches({b}, '{NUMBER_SQL}') AND "
            f"TRY_CAST(CASE WHEN regexp_matches({b}, '{NUMBER_SQL}') THEN {b} END AS DOUBLE) < 0 THEN NULL ELSE {b} END")


TEXTS = ["name1", "year", "location", "experiment_name", "plot", "o_a_score"]


@query("V1_missing_values_text",
       assemble("SELECT " + ", ".join(f"{_clean_text(c)} AS {c}" for c in TEXTS)
                + ", CAST(source_row AS DOUBLE) AS source_row FROM dirty", ["dirty"], ["source_row"]))
def missing_values_text(spark, sf_dir):
    return normalise_missing(fixtures.dirty(spark, sf_dir)).select(*TEXTS, "source_row")


@query("V1_missing_values_typed",
       assemble("SELECT year, plot, CASE WHEN o_a_score >= 0 THEN o_a_score END AS o_a_score, "
                "CASE WHEN ffdefects >= 0 THEN ffdefects END AS ffdefects, l_number FROM "
                "(SELECT t.*, CAST(plot % 7 AS DOUBLE) AS l_number FROM trials t)", ["trials"],
                ["o_a_score", "ffdefects", "l_number"]))
def missing_values_typed(spark, sf_dir):
    rows = fixtures.trials(spark, sf_dir).withColumn("l_number", (F.col("plot") % 7).cast("int"))
    return normalise_missing(rows).select("year", "plot", "o_a_score", "ffdefects", "l_number")


CLEAN_DIRTY = ("SELECT " + ", ".join(f"{_clean_text(c)} AS {c}" for c in TEXTS)
               + ", source_file, source_row, name1 AS raw_name1, plot AS raw_plot, year AS raw_year FROM dirty")
WHOLE_SQL = r"^[+-]?\d+(\.0*)?$"


def _text_error(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '{c}: Input should be a valid string, (None)' END"


def _integer_error(c: str, positive: bool) -> str:
    whole = f"regexp_matches({c}, '{WHOLE_SQL}')"
    more = (f" WHEN CAST(split_part({c}, '.', 1) AS BIGINT) <= 0 THEN "
            f"concat('{c}: Input should be greater than 0, (''', {c}, ''')')" if positive else "")
    return (f"CASE WHEN {c} IS NULL THEN '{c}: Input should be a valid integer, (None)' WHEN NOT {whole} THEN "
            f"concat('{c}: Input should be a valid integer, unable to parse string as an integer, (''', {c}, ''')'){more} END")


ERRORS = ("concat_ws(' | ', " + ", ".join(
    [_text_error(c) for c in ("experiment_name", "location", "name1")] + [_integer_error("plot", True),
                                                                          _integer_error("year", False)]
    + ["CASE WHEN source_row <= 0 THEN concat('source_row: Input should be greater than 0, (', source_row, '.0)') END"])
    + ")")
CHECKED = {"cleaned": CLEAN_DIRTY, "checked": f"SELECT *, {ERRORS} AS error_message FROM cleaned"}


@query("V2_valid_rows",
       assemble("SELECT name1, CAST(split_part(year, '.', 1) AS BIGINT) AS year, location, experiment_name, "
                "CAST(split_part(plot, '.', 1) AS BIGINT) AS plot, o_a_score, CAST(source_row AS BIGINT) AS source_row "
                "FROM checked WHERE error_message = ''", ["dirty"], extra=CHECKED))
def valid_rows(spark, sf_dir):
    return validate(fixtures.dirty(spark, sf_dir)).valid.select(*TEXTS, "source_row")


@query("V3_reject_messages",
       assemble("SELECT raw_name1 AS name1, raw_plot AS plot, raw_year AS year, CAST(source_row AS BIGINT) AS source_row, "
                "error_message FROM checked WHERE error_message <> ''", ["dirty"], extra=CHECKED))
def reject_messages(spark, sf_dir):
    return validate(fixtures.dirty(spark, sf_dir)).rejects.select("name1", "plot", "year", "source_row", "error_message")


@query("V11_lenient_numbers",
       assemble(f"SELECT plot, TRY_CAST(CASE WHEN regexp_matches({_bare('o_a_score')}, '{NUMBER_SQL}') THEN "
                f"{_bare('o_a_score')} END AS DOUBLE) AS o_a_score FROM dirty", ["dirty"], ["o_a_score"]))
def lenient_numbers(spark, sf_dir):
    return coerce_numeric(fixtures.dirty(spark, sf_dir), ["o_a_score"]).select("plot", "o_a_score")


@query("V12_upper_label", assemble("SELECT plot, upper(trim(location)) AS label FROM trials", ["trials"]))
def upper_labels(spark, sf_dir):
    return fixtures.trials(spark, sf_dir).select("plot", upper_label(F.col("location")).alias("label"))


@query("V13_row_id",
       assemble("SELECT concat_ws('|', coalesce(name1, '<NA>'), coalesce(year, '<NA>'), coalesce(location, '<NA>'), "
                "coalesce(experiment_name, '<NA>'), coalesce(plot, '<NA>')) AS row_id FROM dirty", ["dirty"]))
def row_ids(spark, sf_dir):
    return fixtures.dirty(spark, sf_dir).select(
        row_id(["name1", "year", "location", "experiment_name", "plot"]).alias("row_id"))


@query("V14_missing_fraction", assemble("SELECT plot, f AS missing_frac FROM banded", ["banded"], ["missing_frac"]))
def missing_fractions(spark, sf_dir):
    return known(spark, sf_dir).select("plot", missing_fraction(NUMERIC).alias("missing_frac"))


@query("V15_missing_band", assemble("SELECT plot, band FROM banded", ["banded"]))
def missing_bands(spark, sf_dir):
    return known(spark, sf_dir).select("plot", missing_band(missing_fraction(NUMERIC)).alias("band"))


@query("V16_training_rows",
       assemble("SELECT count(*) AS n_rows, count(*) FILTER (WHERE f <= 0.3 AND o_a_score IS NOT NULL) AS n_kept, "
                "count(*) FILTER (WHERE f <= 0.3 AND o_a_score IS NOT NULL) / count(*)::DOUBLE AS kept_frac FROM banded",
                ["banded"], ["kept_frac"]))
def training_rows(spark, sf_dir):
    kept = (missing_fraction(NUMERIC) <= 0.3) & F.col("o_a_score").isNotNull()
    return known(spark, sf_dir).agg(
        F.count("*").alias("n_rows"), F.count_if(kept).alias("n_kept"),
        (F.count_if(kept) / F.count("*").cast("double")).alias("kept_frac"))


@query("V17_environment_subset",
       assemble("SELECT plot, env_type FROM current WHERE upper(trim(env_type)) IN ('NE', 'UNKNOWN')", ["current"]))
def environment_subset(spark, sf_dir):
    return current(spark, sf_dir).where(upper_label(F.col("env_type")).isin("NE", "UNKNOWN")).select("plot", "env_type")


@query("V18_environment_ids",
       assemble("SELECT plot, concat_ws('_', location, CAST(year AS VARCHAR)) AS loc_year, "
                "concat_ws('_', location, CAST(year AS VARCHAR), experiment_name) AS loc_year_exp FROM mart", ["mart"]))
def environment_ids(spark, sf_dir):
    return mart(spark, sf_dir).select(
        "plot", environment_id("location", "year").alias("loc_year"),
        environment_id("location", "year", "experiment_name").alias("loc_year_exp"))


@query("V19_year_range",
       assemble("SELECT name1, location, year, experiment_name, plot, env_type, o_a_score FROM known "
                "WHERE o_a_score IS NOT NULL AND year >= 1994 AND year <= 1996", ["known"], ["o_a_score"]))
def year_range(spark, sf_dir):
    return tables.scan_scored_rows(known(spark, sf_dir), 1994, 1996)


@query("V20_drop_missing", assemble("SELECT plot, yield, ff_irs FROM known WHERE yield IS NOT NULL AND ff_irs IS NOT NULL",
                                    ["known"], ["yield", "ff_irs"]))
def drop_missing(spark, sf_dir):
    return known(spark, sf_dir).select("plot", "yield", "ff_irs").na.drop(subset=["yield", "ff_irs"])


@query("C_scalar_functions",
       assemble("SELECT plot, lower(location) AS c1_lower, upper(trim(location)) AS c1_upper, "
                "lower(experiment_name) LIKE '%ware%' AS c2_contains, replace(experiment_name, ' ', '_') AS c3_replace, "
                "regexp_replace(lower(experiment_name), '[^a-z]+', '-', 'g') AS c3_regex, "
                "concat_ws('_', location, CAST(year AS VARCHAR)) AS c4_concat, coalesce(o_a_score, -1) AS c5_coalesce, "
                "CASE WHEN o_a_score IN (1, 2, 3) THEN 'low' WHEN o_a_score >= 4 THEN 'high' END AS c5_case, "
                "CAST(plot AS VARCHAR) AS c6_text, TRY_CAST(experiment_name AS DOUBLE) AS c6_lenient, "
                "abs(o_a_score) AS c7_abs, o_a_score * o_a_score AS c7_square, sqrt(abs(o_a_score)) AS c7_sqrt, "
                "100 * o_a_score / nullif(tubersize, 0) AS c7_percent, round(o_a_score / 7, 3) AS c7_round FROM trials",
                ["trials"], ["c5_coalesce", "c6_lenient", "c7_abs", "c7_square", "c7_sqrt", "c7_percent", "c7_round"]))
def scalar_functions(spark, sf_dir):
    score, experiment = F.col("o_a_score"), F.col("experiment_name")
    return fixtures.trials(spark, sf_dir).select(
        "plot", F.lower("location").alias("c1_lower"), F.upper(F.btrim("location")).alias("c1_upper"),
        F.lower(experiment).contains("ware").alias("c2_contains"),
        F.replace(experiment, F.lit(" "), F.lit("_")).alias("c3_replace"),
        F.regexp_replace(F.lower(experiment), "[^a-z]+", "-").alias("c3_regex"),
        environment_id("location", "year").alias("c4_concat"), F.coalesce(score, F.lit(-1.0)).alias("c5_coalesce"),
        F.when(score.isin(1, 2, 3), "low").when(score >= 4, "high").alias("c5_case"),
        F.col("plot").cast("string").alias("c6_text"), text_to_double(experiment).alias("c6_lenient"),
        F.abs(score).alias("c7_abs"), (score * score).alias("c7_square"), F.sqrt(F.abs(score)).alias("c7_sqrt"),
        (100 * score / F.nullif("tubersize", F.lit(0.0))).alias("c7_percent"),
        F.round(score / 7, 3).alias("c7_round"))


# ---- sources

@query("S1_discover_files",
       " UNION ALL ".join(f"SELECT '{t}.parquet' AS file, count(*) AS n_rows FROM {t}" for t in sorted(fixtures.TABLES)))
def discover_files(spark, sf_dir):
    paths = discover(spark, sf_dir, [".PARQUET"])
    counted = [spark.read.parquet(p).agg(F.count("*").alias("n_rows"))
               .select(F.lit(p.rsplit("/", 1)[-1]).alias("file"), "n_rows") for p in paths]
    out = counted[0]
    for frame in counted[1:]:
        out = out.unionByName(frame)
    return out


@query("S2_scan_drop", "SELECT o_orderkey, o_totalprice, CAST(o_orderkey AS BIGINT) IS NOT NULL AS has_key FROM orders")
def scan_one_drop(spark, sf_dir):
    scanned = scan_drop(spark, f"{sf_dir}/orders.parquet").data
    return scanned.select("o_orderkey", "o_totalprice", F.col("o_orderkey").isNotNull().alias("has_key"))


def _as_drops(spark, rows, names: list[str]) -> str:
    """Rows as CSV drop files with the given names, in a new folder."""
    work = scratch(spark)
    rows.repartition(len(names)).write.option("header", True).option("escape", '"').csv(f"{work}/written")
    for part, name in zip(discover(spark, f"{work}/written", [".csv"]), names):
        rename(spark, part, f"{work}/incoming/{name}")
    return work


@query("S2_scan_csv_with_line_breaks",
       "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN concat('first', chr(10), 'a \"b\" ', o_orderkey) "
       "ELSE concat('plain ', o_orderkey) END AS note FROM orders")
def scan_csv(spark, sf_dir):
    """Every third cell has a quoted line break."""
    key = F.col("o_orderkey")
    rows = fixtures.table(spark, sf_dir, "orders").select(key, F.when(key % 3 == 0, F.concat(F.lit('first\na "b" '), key)).otherwise(
        F.concat(F.lit("plain "), key)).alias("note"))
    work = _as_drops(spark, rows, ["a.csv", "b.Csv", "c.CSV"])
    parts = [scan_drop(spark, path).data.select("o_orderkey", "note") for path in discover(spark, f"{work}/incoming", [".csv"])]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("S3_row_lineage",
       "SELECT 'lineitem.parquet' AS source_file, count(*) AS n_rows, CAST(2 AS BIGINT) AS first_row, "
       "count(*) + 1 AS last_row, count(*) AS distinct_rows FROM lineitem")
def row_lineage(spark, sf_dir):
    return (scan_drop(spark, f"{sf_dir}/lineitem.parquet", infer=False).data.groupBy("source_file")
            .agg(F.count("*").alias("n_rows"), F.min("source_row").alias("first_row"),
                 F.max("source_row").alias("last_row"), F.count_distinct("source_row").alias("distinct_rows")))


@query("S4_folder_ingest",
       assemble("SELECT count(DISTINCT concat_ws('|', name1, year, location, experiment_name, split_part(plot, '.', 1), "
                "coalesce(o_a_score, '~'))) FILTER (WHERE error_message = '') AS n_valid, "
                "count(*) FILTER (WHERE error_message <> '') AS n_rejected FROM checked", ["dirty"],
                extra={**CHECKED, "checked": CHECKED["checked"].replace(
                    ERRORS, ERRORS.replace("CASE WHEN source_row <= 0 THEN", "CASE WHEN FALSE THEN"))}))
def folder_ingest(spark, sf_dir):
    """Rows written as drop files, then loaded file by file through the stream."""
    work = scratch(spark)
    rows = fixtures.dirty(spark, sf_dir).drop("source_file", "source_row")
    rows.repartition(3).write.option("header", True).csv(f"{work}/incoming")
    store = VersionedStore(spark, f"{work}/store")
    outcomes = stream_folder(store, f"{work}/incoming", f"{work}/archive", f"{work}/stream", "2024-03-01 00:00:00")
    failed = [o.error for o in outcomes if o.status != "loaded"]
    if failed:
        raise RuntimeError(failed[0])
    history = store.history().agg(F.count("*").alias("n_valid"))
    return history.select("n_valid", store.quarantine().agg(F.count("*").alias("n")).scalar().alias("n_rejected"))


@query("S4_lookalike_names", ORACLES["S4_folder_ingest"])
def lookalike_names(spark, sf_dir):
    """Names that differ in punctuation and case of the suffix only: every file is a load of its own."""
    rows = fixtures.dirty(spark, sf_dir).drop("source_file", "source_row")
    work = _as_drops(spark, rows, ["trial 1.csv", "trial_1.csv", "trial-1.CSV"])
    store = VersionedStore(spark, f"{work}/store")
    outcomes = stream_folder(store, f"{work}/incoming", f"{work}/archive", f"{work}/stream", "2024-03-01 00:00:00")
    failed = [o.error for o in outcomes if o.status != "loaded"]
    if failed:
        raise RuntimeError(failed[0])
    history = store.history().agg(F.count("*").alias("n_valid"))
    return history.select("n_valid", store.quarantine().agg(F.count("*").alias("n")).scalar().alias("n_rejected"))


@query("S5_archive_clash", "SELECT 1 AS n_named, count(*) AS n_rows FROM orders UNION ALL SELECT 0, count(*) FROM supplier")
def archive_clash(spark, sf_dir):
    """Two files of one name: the second gets a suffix, nothing is overwritten."""
    work, out = scratch(spark), []
    for name in ("orders", "supplier"):
        fixtures.table(spark, sf_dir, name).coalesce(1).write.parquet(f"{work}/{name}")
        part = discover(spark, f"{work}/{name}", [".parquet"])[0]
        rename(spark, part, f"{work}/incoming/drop.parquet")
        path = archive(spark, f"{work}/incoming/drop.parquet", f"{work}/archive")
        out.append(spark.read.parquet(path).agg(F.count("*").alias("n_rows")).select(
            F.lit(int(path.endswith("/drop.parquet"))).alias("n_named"), "n_rows"))
    return out[0].unionByName(out[1])


@query("C8_utc_text_and_suffix",
       "SELECT e_id, strftime(moment, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS utc_text, strftime(moment, '%Y%m%d_%H%M%S') AS suffix FROM "
       "(SELECT o_orderkey AS e_id, CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400) AS moment FROM orders)")
def utc_text(spark, sf_dir):
    at = F.expr("CAST(o_orderdate AS TIMESTAMP) + make_dt_interval(0, 0, 0, o_orderkey % 86400)")
    return fixtures.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("e_id"), tables.utc_text(at).alias("utc_text"), F.date_format(at, tables.SUFFIX).alias("suffix"))


@query("S6_quarantine_append",
       assemble("SELECT raw_plot AS plot, CAST(source_row AS BIGINT) AS source_row, source_file, error_message, "
                "'load-1' AS load_id FROM checked WHERE error_message <> ''", ["dirty"], extra=CHECKED))
def quarantine_append(spark, sf_dir):
    store = VersionedStore(spark, f"{scratch(spark)}/store")
    checked = validate(fixtures.dirty(spark, sf_dir))
    store.load(checked.valid, checked.rejects, "load-1", "2024-01-01 00:00:00")
    return store.quarantine().select("plot", "source_row", "source_file", "error_message", "load_id")


# ---- row versions

_KEY = ", ".join(MERGE_KEY)
_CONTENT = ("md5(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in fixtures.BUSINESS) + "))")
SCD2 = {
    "act": f"SELECT *, {_CONTENT} AS h FROM history WHERE valid_to IS NULL",
    "inc": f"SELECT DISTINCT {', '.join(fixtures.BUSINESS)}, {_CONTENT} AS h FROM snapshot",
    "ret": f"SELECT a.record_id, {', '.join(f'a.{k}' for k in MERGE_KEY)}, a.h FROM act a "
           f"WHERE EXISTS (SELECT 1 FROM inc i WHERE {' AND '.join(f'a.{k} = i.{k}' for k in MERGE_KEY)}) "
           f"AND NOT EXISTS (SELECT 1 FROM inc i WHERE {' AND '.join(f'a.{k} = i.{k}' for k in MERGE_KEY)} AND a.h = i.h)",
    "opn": f"SELECT i.* FROM inc i WHERE NOT EXISTS (SELECT 1 FROM act a WHERE "
           f"{' AND '.join(f'a.{k} = i.{k}' for k in MERGE_KEY)} AND a.h = i.h)",
}
_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"
MERGED = (f"SELECT {_KEY}, o_a_score, finalyield, {_TS.format('valid_from')} AS valid_from, "
          f"CASE WHEN concat(record_id, {_CONTENT}) IN (SELECT concat(record_id, h) FROM ret) AND valid_to IS NULL THEN '2025-01-01 00:00:00' "
          f"ELSE {_TS.format('valid_to')} END AS valid_to FROM history "
          f"UNION ALL SELECT {_KEY}, o_a_score, finalyield, '2025-01-01 00:00:00', NULL FROM opn")


def _versions(df):
    return df.select(*MERGE_KEY, "o_a_score", "finalyield",
                     *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("valid_from", "valid_to")])


@query("S7_scd2_merge", assemble(MERGED, ["history", "snapshot"], ["o_a_score", "finalyield"], SCD2))
def scd2_merge(spark, sf_dir):
    history = fixtures.history(spark, sf_dir)
    history = history.withColumn("row_hash", scd2.row_hash(history))
    batch = cut_lineage(fixtures.snapshot(spark, sf_dir))
    # Duplicate plots share a record id in the fixture, so the version id must tell them apart.
    history = history.withColumn("record_id", F.sha2(F.concat_ws("|", "record_id", "row_hash"), 256))
    return _versions(scd2.merge(history, batch, F.lit("2025-01-01 00:00:00").cast("timestamp"), "load-3"))


@query("J2_key_and_hash_matching",
       assemble(f"SELECT 'closed' AS side, {_KEY} FROM ret UNION ALL SELECT 'opened', {_KEY} FROM opn",
                ["history", "snapshot"], extra=SCD2))
def key_and_hash_matching(spark, sf_dir):
    history = fixtures.history(spark, sf_dir)
    active = history.where("valid_to is null").select(*MERGE_KEY, scd2.row_hash(history).alias("row_hash"))
    change = scd2.delta(active, cut_lineage(fixtures.snapshot(spark, sf_dir)), F.lit("2025-01-01 00:00:00").cast("timestamp"), "load-3")
    return (change.closed.select(F.lit("closed").alias("side"), *MERGE_KEY)
            .unionByName(change.opened.select(F.lit("opened").alias("side"), *MERGE_KEY)))


FIRST = {"h1": f"SELECT DISTINCT {', '.join(fixtures.BUSINESS)}, {_CONTENT} AS h FROM trials",
         "h2": f"SELECT DISTINCT {', '.join(fixtures.BUSINESS)}, {_CONTENT} AS h FROM snapshot"}
_SAME_KEY = " AND ".join(f"a.{k} = b.{k}" for k in MERGE_KEY)


@query("S7_versioned_store",
       assemble(f"SELECT {_KEY}, o_a_score, finalyield, '2024-01-01 00:00:00' AS valid_from, "
                f"CASE WHEN EXISTS (SELECT 1 FROM h2 b WHERE {_SAME_KEY}) AND NOT EXISTS "
                f"(SELECT 1 FROM h2 b WHERE {_SAME_KEY} AND a.h = b.h) THEN '2025-01-01 00:00:00' END AS valid_to FROM h1 a "
                f"UNION ALL SELECT {_KEY}, o_a_score, finalyield, '2025-01-01 00:00:00', NULL FROM h2 a "
                f"WHERE NOT EXISTS (SELECT 1 FROM h1 b WHERE {_SAME_KEY} AND a.h = b.h)",
                ["trials", "snapshot"], ["o_a_score", "finalyield"], FIRST))
def versioned_store(spark, sf_dir):
    """Two deliveries and a replay of the second, through the append-only store."""
    store = VersionedStore(spark, f"{scratch(spark)}/store")
    first = fixtures.trials(spark, sf_dir).withColumns(
        {"source_file": F.lit("first.csv"), "source_row": (F.col("plot") % 1000 + 2).cast("long")})
    nothing = first.where(F.lit(False)).select("source_file", "source_row", F.lit("").alias("error_message"))
    store.load(first, nothing, "load-1", "2024-01-01 00:00:00")
    second = fixtures.snapshot(spark, sf_dir)
    for load_id, boundary in (("load-2", "2025-01-01 00:00:00"), ("load-3", "2025-02-01 00:00:00")):
        store.load(second, nothing, load_id, boundary)
    return _versions(store.history())


@query("S7_compacted_store", ORACLES["S7_versioned_store"])
def compacted_store(spark, sf_dir):
    """The same deliveries with a compaction after each and a clean-up at the end: the history is the same."""
    store = VersionedStore(spark, f"{scratch(spark)}/store", rows_per_slot=100_000)
    first = fixtures.trials(spark, sf_dir).withColumns(
        {"source_file": F.lit("first.csv"), "source_row": (F.col("plot") % 1000 + 2).cast("long")})
    nothing = first.where(F.lit(False)).select("source_file", "source_row", F.lit("").alias("error_message"))
    store.load(first, nothing, "load-1", "2024-01-01 00:00:00")
    store.compact("compaction-1")
    store.load(fixtures.snapshot(spark, sf_dir), nothing, "load-2", "2025-01-01 00:00:00")
    store.compact("compaction-2")
    store.load(fixtures.snapshot(spark, sf_dir), nothing, "load-3", "2025-02-01 00:00:00")
    store.vacuum(older_than_hours=0)
    return _versions(store.history())


@query("S7_many_deliveries", ORACLES["S7_versioned_store"].replace("2025-01-01 00:00:00", "2024-01-01 00:00:00.000001"))
def many_deliveries(spark, sf_dir):
    """Two deliveries and a replay of the second, merged at once; each counts a microsecond after the one before."""
    store = VersionedStore(spark, f"{scratch(spark)}/store")
    lineage = {"source_row": (F.col("plot") % 1000 + 2).cast("long")}
    rows = fixtures.trials(spark, sf_dir).withColumns({"source_file": F.lit("0.csv"), **lineage})
    for k in (1, 2):
        rows = rows.unionByName(fixtures.snapshot(spark, sf_dir).withColumns({"source_file": F.lit(f"{k}.csv"), **lineage}), allowMissingColumns=True)
    nothing = rows.where(F.lit(False)).select("source_file", "source_row", F.lit("").alias("error_message"))
    store.load_many(rows, nothing, [(f"load-{k}", f"{k}.csv") for k in range(3)], "2024-01-01 00:00:00", "together")
    return store.history().select(*MERGE_KEY, "o_a_score", "finalyield", *[F.col(c).cast("string").alias(c) for c in ("valid_from", "valid_to")])


@query("S7_value_returns",
       assemble(f"SELECT {_KEY}, o_a_score FROM (SELECT DISTINCT {', '.join(fixtures.BUSINESS)} FROM trials WHERE o_a_score IS NOT NULL)",
                ["trials"], ["o_a_score"]))
def value_returns(spark, sf_dir):
    """Three deliveries under one boundary, the third like the first: its rows are the active ones."""
    store = VersionedStore(spark, f"{scratch(spark)}/store")
    rows = fixtures.trials(spark, sf_dir).where("o_a_score IS NOT NULL").withColumns(
        {"source_file": F.lit("a.csv"), "source_row": (F.col("plot") % 1000 + 2).cast("long")})
    nothing = rows.where(F.lit(False)).select("source_file", "source_row", F.lit("").alias("error_message"))
    for k, shift in enumerate((0, 100, 0)):
        store.load(rows.withColumn("o_a_score", F.col("o_a_score") + shift), nothing, f"load-{k}", "2024-01-01 00:00:00")
    return store.history().where("valid_to IS NULL").select(*MERGE_KEY, "o_a_score")


@query("S8_schema_contract",
       assemble("SELECT plot, finalyield, o_a_score, NULL::DOUBLE AS extra_trait FROM trials "
                "UNION ALL SELECT plot, finalyield, NULL::DOUBLE, ffscab + 1 AS extra_trait FROM snapshot", ["trials", "snapshot"],
                ["finalyield", "o_a_score", "extra_trait"]))
def schema_contract(spark, sf_dir):
    """The second delivery adds a column, has one that is empty throughout, and one that is empty and unknown."""
    first = fixtures.trials(spark, sf_dir).select("plot", "finalyield", "o_a_score")
    second = fixtures.snapshot(spark, sf_dir).select("plot", "finalyield", F.lit(None).alias("o_a_score"),
                                                     (F.col("ffscab") + 1).alias("extra_trait"), F.lit(None).alias("never_filled"))
    return first.unionByName(fit_contract(second, first.schema), allowMissingColumns=True)


@query("S8_type_conflict",
       "SELECT 'l_quantity: string -> double' AS conflict, count(*) AS n_rows FROM lineitem")
def type_conflict(spark, sf_dir):
    """A delivery whose known column has another type is refused, with the reason."""
    rows = fixtures.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("double").alias("l_quantity"))
    known_schema = rows.withColumn("l_quantity", F.col("l_quantity").cast("string")).schema
    try:
        fit_contract(rows, known_schema)
        reason = None
    except SchemaContractError as refused:
        reason = str(refused)
    return rows.agg(F.lit(reason).alias("conflict"), F.count("*").alias("n_rows")).select("conflict", "n_rows")


@query("S9_schema_changes",
       "SELECT 'l_quantity' AS \"column\", 'type' AS change, 'string' AS old_type, 'double' AS new_type, count(l_quantity) AS n_filled FROM lineitem "
       "UNION ALL SELECT 'l_tax', 'added', NULL, 'double', count(l_tax) FROM lineitem")
def schema_change_rows(spark, sf_dir):
    """A type change, an added column, a column that left and one without any value."""
    items = fixtures.table(spark, sf_dir, "lineitem")
    old = items.select("l_orderkey", F.col("l_quantity").cast("string").alias("l_quantity"), "l_shipdate")
    new = items.select("l_orderkey", F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_tax").cast("double").alias("l_tax"),
                       F.lit(None).alias("l_empty"))
    changes = schema_changes(old.schema, new.schema)
    filled = new.agg(*[F.count(c).alias(c) for c, *_ in changes]).unpivot([], [c for c, *_ in changes], "column", "n_filled")
    return schema_change_report(spark, changes).join(filled, "column")


# ---- snapshots and results

PROFILE = ("SELECT count(*) AS n_rows, min(year) AS min_year, max(year) AS max_year, "
           "count(DISTINCT location) AS n_locations, count(DISTINCT name1) AS n_clones FROM mart")


@query("S14_snapshot_profile", assemble(PROFILE, ["mart"]))
def snapshot_profile(spark, sf_dir):
    return tables.snapshot_profile(mart(spark, sf_dir)).drop("columns")


@query("S13_snapshot_round_trip", assemble("SELECT * FROM mart", ["mart"],
                                           ["o_a_score", *[c for c in NUMERIC]]))
def snapshot_round_trip(spark, sf_dir):
    folder = scratch(spark)
    meta = tables.export_snapshot(mart(spark, sf_dir), "analytics_gold.mart_overall_analysis", folder)
    return tables.load_snapshot(spark, meta["parquet_path"])


@query("S17_child_runs",
       assemble("SELECT band AS run, count(*) AS n, avg(o_a_score) AS mean_score FROM banded GROUP BY band", ["banded"],
                ["mean_score"]))
def child_runs(spark, sf_dir):
    """Results written per run and read back by their parent run."""
    root = f"{scratch(spark)}/results"
    rows = cut_lineage(known(spark, sf_dir).select(missing_band(missing_fraction(NUMERIC)).alias("run"), "o_a_score"))  # every run reads it
    for band in ("complete", "medium", "incomplete"):
        result = rows.where(F.col("run") == band).agg(F.count("*").alias("n"), F.avg("o_a_score").alias("mean_score"))
        tables.write_result(result, root, "bands", "parent-1", band, "summary")
        tables.write_result(result, root, "bands", "parent-2", band, "summary")
    return tables.read_results(spark, root, "bands", "summary", "parent-1").select("run", "n", "mean_score").where("n > 0")


@query("S16_result_sinks",
       assemble("SELECT env_type, count(*) AS n, form FROM mart, (SELECT unnest(['csv', 'json']) AS form) GROUP BY env_type, form", ["mart"]))
def result_sinks(spark, sf_dir):
    """The same result as CSV and JSON, read back."""
    root = f"{scratch(spark)}/results"
    result = mart(spark, sf_dir).groupBy("env_type").agg(F.count("*").alias("n"))
    csv = tables.write_result(result, root, "sinks", "p", "r", "frame", "csv")
    js = tables.write_result(result, root, "sinks", "p", "r", "dict", "json")
    return (spark.read.schema("env_type string, n long").option("header", True).csv(csv).withColumn("form", F.lit("csv"))
            .unionByName(spark.read.schema("env_type string, n long").json(js).withColumn("form", F.lit("json"))))
