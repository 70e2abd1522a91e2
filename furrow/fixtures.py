"""Trials relations derived from the driver tables; the same SQL text runs on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

TRIALS = """
SELECT concat('C', l.l_partkey % 211) AS name1, CAST(year(o.o_orderdate) AS BIGINT) AS year,
 concat(CASE WHEN l.l_orderkey % 3 = 0 THEN ' ' ELSE '' END,
        CASE WHEN l.l_orderkey % 2 = 0 THEN upper(n.n_name) ELSE lower(n.n_name) END) AS location,
 concat(CASE l.l_suppkey % 4 WHEN 0 THEN 'Process ' WHEN 1 THEN 'WARE ' WHEN 2 THEN 'Ware process ' ELSE 'Seed ' END,
        CASE l.l_partkey % 3 WHEN 0 THEN 'Clay' WHEN 1 THEN 'sand' ELSE 'loam' END) AS experiment_name,
 CAST(l.l_orderkey * 10 + l.l_linenumber AS BIGINT) AS plot,
 CASE WHEN l.l_partkey % 13 = 0 THEN NULL WHEN l.l_partkey % 29 = 0 THEN CAST(-9 AS DOUBLE)
      ELSE CAST(l.l_quantity % 12 AS DOUBLE) END AS o_a_score,
 CASE WHEN l.l_suppkey % 5 = 0 THEN NULL ELSE CAST((l.l_quantity + l.l_linenumber) % 11 AS DOUBLE) END AS tubersize,
 CASE WHEN l.l_partkey % 6 = 0 OR l.l_orderkey % 11 = 0 THEN NULL
      ELSE CAST((l.l_quantity * 3 + l.l_suppkey) % 10 AS DOUBLE) END AS eveness,
 CASE WHEN l.l_orderkey % 11 = 0 THEN NULL
      ELSE CAST(l.l_quantity % 12 AS DOUBLE) / 2 + CAST(l.l_linenumber AS DOUBLE) / 4 END AS appearance,
 CASE WHEN l.l_suppkey % 7 = 0 OR l.l_orderkey % 11 = 0 THEN NULL
      ELSE CAST((l.l_partkey + l.l_linenumber) % 10 AS DOUBLE) END AS tubnumbers,
 CASE WHEN l.l_orderkey % 11 = 0 THEN NULL ELSE CAST((l.l_quantity * 7 + l.l_partkey) % 10 AS DOUBLE) END AS eyedepth,
 CASE WHEN l.l_orderkey % 11 = 0 THEN NULL ELSE l.l_tax * 100 END AS uniformity,
 CASE WHEN l.l_orderkey % 11 = 0 THEN NULL ELSE l.l_discount * 100 END AS ffscab,
 CASE WHEN l.l_orderkey % 3 = 0 OR l.l_orderkey % 11 = 0 THEN NULL ELSE l.l_quantity / 5 - 1 END AS ffdefects,
 CASE WHEN l.l_orderkey % 4 < 2 THEN NULL ELSE CAST(l.l_suppkey % 12 AS DOUBLE) END AS ffhollowh,
 CASE WHEN l.l_orderkey % 5 < 2 THEN NULL ELSE CAST((l.l_suppkey + l.l_partkey) % 11 AS DOUBLE) END AS ff_irs,
 CASE WHEN l.l_orderkey % 7 = 0 THEN NULL ELSE l.l_extendedprice / 300 END AS finalyield,
 CASE WHEN l.l_orderkey % 77 = 0 THEN NULL ELSE l.l_extendedprice / 400 END AS yield_total_t_ha
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
 JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""
# The same rows with the orders' nation joined first: lineitem, by far the largest table, is dealt once instead of for each join.
TRIALS_ONCE = TRIALS.split("FROM {lineitem}")[0] + """FROM {lineitem} l JOIN ({orders} o
 JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey) ON l.l_orderkey = o.o_orderkey
"""

ENV_LOOKUP = """
SELECT n_name AS location, CASE WHEN n_regionkey < 2 THEN 'MED' ELSE 'NE' END AS env_type
FROM {nation} WHERE n_regionkey < 4
"""

# Bronze history: every tenth plot has a closed first version and a changed current one.
HISTORY = """
SELECT t.*, TIMESTAMP '2024-01-01 00:00:00' AS valid_from,
 CASE WHEN plot % 10 = 1 THEN TIMESTAMP '2024-06-01 00:00:00' END AS valid_to,
 'load-1' AS load_id, concat('r1-', plot) AS record_id,
 concat('drop_', year, '.csv') AS source_file, CAST(plot % 1000 + 2 AS INT) AS source_row
FROM {trials} t
UNION ALL
SELECT name1, year, location, experiment_name, plot, o_a_score + 1 AS o_a_score, tubersize, eveness, appearance,
 tubnumbers, eyedepth, uniformity, ffscab, ffdefects, ffhollowh, ff_irs, finalyield, yield_total_t_ha,
 TIMESTAMP '2024-06-01 00:00:00' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to,
 'load-2' AS load_id, concat('r2-', plot) AS record_id,
 concat('drop_', year, '_b.csv') AS source_file, CAST(plot % 1000 + 2 AS INT) AS source_row
FROM {trials} WHERE plot % 10 = 1
"""

# Untyped rows as a drop file delivers them, with every kind of dirt.
DIRTY = """
SELECT CASE WHEN plot % 41 = 0 THEN ' ' WHEN plot % 43 = 0 THEN NULL ELSE name1 END AS name1,
 CASE WHEN plot % 37 = 0 THEN NULL WHEN plot % 53 = 0 THEN '-1' WHEN plot % 59 = 0 THEN '20x4'
      ELSE CAST(year AS VARCHAR(20)) END AS year,
 CASE WHEN plot % 47 = 0 THEN '' ELSE concat(' ', location, ' ') END AS location,
 CASE WHEN plot % 61 = 0 THEN '  ' ELSE experiment_name END AS experiment_name,
 CASE WHEN plot % 31 = 0 THEN '0' WHEN plot % 67 = 0 THEN concat(CAST(plot AS VARCHAR(20)), '.0')
      WHEN plot % 71 = 0 THEN '12.5' ELSE CAST(plot AS VARCHAR(20)) END AS plot,
 CASE WHEN plot % 17 = 0 THEN '-9' WHEN plot % 19 = 0 THEN 'nan' WHEN plot % 23 = 0 THEN '5d'
      WHEN plot % 29 = 0 THEN ' 7 ' WHEN plot % 7 = 0 THEN '-0.5' ELSE CAST(CAST(o_a_score AS INT) AS VARCHAR(20)) END
   AS o_a_score,
 concat('drop_', year, '.csv') AS source_file, CAST(plot % 1000 AS INT) AS source_row
FROM {trials}
"""

# Second delivery: some scores changed, some plots absent, some plots new.
SNAPSHOT = """
SELECT name1, year, location, experiment_name, plot,
 CASE WHEN plot % 10 = 2 THEN o_a_score + 1 ELSE o_a_score END AS o_a_score,
 tubersize, eveness, appearance, tubnumbers, eyedepth, uniformity, ffscab, ffdefects, ffhollowh, ff_irs,
 finalyield, yield_total_t_ha, 'second.csv' AS source_file, CAST(plot % 1000 + 2 AS BIGINT) AS source_row
FROM {trials} WHERE plot % 17 <> 0
UNION ALL
SELECT name1, year, location, experiment_name, plot + 1000000000 AS plot, o_a_score,
 tubersize, eveness, appearance, tubnumbers, eyedepth, uniformity, ffscab, ffdefects, ffhollowh, ff_irs,
 finalyield, yield_total_t_ha, 'second.csv' AS source_file, CAST(plot % 1000 + 2 AS BIGINT) AS source_row
FROM {trials} WHERE plot % 13 = 0
"""
BUSINESS = ["name1", "year", "location", "experiment_name", "plot", "o_a_score", "tubersize", "eveness", "appearance",
            "tubnumbers", "eyedepth", "uniformity", "ffscab", "ffdefects", "ffhollowh", "ff_irs", "finalyield",
            "yield_total_t_ha"]

# Header names with every symbol the cleaning rule knows.
RAW_NAMES = """
SELECT concat(CASE p_size % 3 WHEN 0 THEN ' ' WHEN 1 THEN '' ELSE '  ' END, p_type,
 CASE p_size % 7 WHEN 0 THEN ' >=' WHEN 1 THEN ' <= ' WHEN 2 THEN '>' WHEN 3 THEN '<' WHEN 4 THEN '% ' WHEN 5 THEN '#'
   ELSE '-' END, CAST(p_size AS VARCHAR(10)), CASE p_partkey % 4 WHEN 0 THEN ' (t/ha)' WHEN 1 THEN '__' ELSE '' END) AS raw
FROM {part}
UNION ALL SELECT concat(CAST(p_size AS VARCHAR(10)), '-', CAST(p_size + 5 AS VARCHAR(10)), '%') AS raw FROM {part}
UNION ALL SELECT CASE p_size % 3 WHEN 0 THEN '__' WHEN 1 THEN ' % ' ELSE '()' END AS raw FROM {part}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = ("lineitem", "orders", "customer", "nation")
    return spark.sql(TRIALS_ONCE, **{t: table(spark, sf_dir, t) for t in used})


def env_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ENV_LOOKUP, nation=table(spark, sf_dir, "nation"))


def versions(trials: DataFrame) -> DataFrame:
    """The rows of ``HISTORY`` from one pass over the trials: a row gives its first version, and the changed one if it has one."""
    changed = F.col("plot") % 10 == 1
    first, second = (F.lit(f"2024-{month}-01 00:00:00").cast("timestamp") for month in ("01", "06"))
    plain = F.struct(F.col("o_a_score"), first.alias("valid_from"), F.when(changed, second).alias("valid_to"), F.lit("load-1").alias("load_id"),
                     F.concat(F.lit("r1-"), "plot").alias("record_id"), F.concat(F.lit("drop_"), "year", F.lit(".csv")).alias("source_file"))
    later = F.struct((F.col("o_a_score") + 1).alias("o_a_score"), second.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
                     F.lit("load-2").alias("load_id"), F.concat(F.lit("r2-"), "plot").alias("record_id"),
                     F.concat(F.lit("drop_"), "year", F.lit("_b.csv")).alias("source_file"))
    given = [c for c in trials.columns if c != "o_a_score"]
    rows = trials.select(*given, F.inline(F.when(changed, F.array(plain, later)).otherwise(F.array(plain))))
    return rows.select(*trials.columns, "valid_from", "valid_to", "load_id", "record_id", "source_file",
                       (F.col("plot") % 1000 + 2).cast("int").alias("source_row"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(trials(spark, sf_dir))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIRTY, trials=trials(spark, sf_dir))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SNAPSHOT, trials=trials(spark, sf_dir))


def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW_NAMES, part=table(spark, sf_dir, "part"))
