"""Exact order statistics without ever sorting a whole group in one task.

A group (a column, a fold, an environment) may hold any number of rows, so ranks and quantiles are computed from
pre-aggregated (group, value, count) rows. Values are cut into ranges by an approximate sketch, which only balances the
work; positions come from exact range totals plus a window inside one range, so the results are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.session import counted_cut, cut_lineage, order_buckets

BROADCAST_CELLS = 500_000
RANGE_ROWS = 100_000
SKETCH_K = 1024
# Three times the usual bound of the rank error of such a sketch: only the amount of work depends on it, never a result.
RANK_SLACK = 3 * 2.446 / SKETCH_K ** 0.9433


def values_long(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., column, value) of the non-null values."""
    by = by or []
    doubles = [F.col(f"`{c}`").cast("double").alias(c) for c in columns]
    return df.select(*by, *doubles).unpivot(by, columns, "column", "value").where(F.col("value").isNotNull())


def value_counts_long(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., column, value, n) of the non-null values; the count is combined before the shuffle."""
    return values_long(df, columns, by).groupBy(*(by or []), "column", "value").agg(F.count("*").alias("n"))


def _ranges(counts: DataFrame, by: list[str], value: str, n: str) -> tuple[DataFrame, list[str]]:
    """Cut every group's values into ranges of similar size and add the exact rows before each range.

    The counts are written once, then the sketched bounds: every branch, and every recomputation after a lost executor,
    cuts alike, and the base rows are read only once.
    Bounds and range totals are broadcast only when their counted size is small; otherwise both joins shuffle.
    """
    spark = counts.sparkSession
    buckets = order_buckets(spark)
    cuts = [i / buckets for i in range(1, buckets)]
    # NULL group keys must meet again after the joins.
    safe = {f"__k{i}": F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for i, c in enumerate(by)}
    keyed = cut_lineage(counts.withColumns(safe or {"__k0": F.lit("")}))
    keys = list(safe) or ["__k0"]
    bounds, n_groups = counted_cut(
        keyed.groupBy(*keys).agg(F.percentile_approx(value, cuts, 100 * buckets).alias("__bounds")))
    small = n_groups * buckets <= BROADCAST_CELLS
    hint = F.broadcast if small else (lambda side: side)
    ranged = (keyed.join(hint(bounds), keys)
              .withColumn("__range", F.size(F.filter("__bounds", lambda b: b < F.col(value))))
              .drop("__bounds"))
    by_group = Window.partitionBy(*keys)
    sizes = (ranged.groupBy(*keys, "__range").agg(F.sum(n).alias("__size"))
             .withColumn("__offset", F.sum("__size").over(by_group.orderBy("__range")) - F.col("__size"))
             .withColumn("total", F.sum("__size").over(by_group)))
    return ranged.join(hint(sizes), [*keys, "__range"]), keys


def _place(ranged: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    inside = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn("before", F.col("__offset") + F.coalesce(F.sum(n).over(inside), F.lit(0)))
            .drop(*keys, "__range", "__offset", "__size"))


def positions(counts: DataFrame, by: list[str], value: str = "value", n: str = "n") -> DataFrame:
    """Add ``before`` (rows of the group with a smaller value) and ``total`` (rows of the group).

    ``counts`` holds each (by, value) once with its row count ``n``.
    """
    ranged, keys = _ranges(counts, by, value, n)
    return _place(ranged, keys, value, n)


def hash_positions(df: DataFrame, key: str, salt: int, n_rows: int) -> DataFrame:
    """Add ``position`` (from 0) in the order of a salted hash of a unique integer key, equal hashes by the key.

    Hashes lie evenly whatever the keys are, so even ranges of them hold about as many rows each.
    """
    ranges = max(order_buckets(df.sparkSession), n_rows // RANGE_ROWS)
    hashed = df.withColumn("__h", F.xxhash64(key, F.lit(salt)).cast("double"))
    share = (F.col("__h") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    ranged = hashed.withColumn("__range", F.least(F.floor(share * F.lit(ranges)), F.lit(ranges - 1)).cast("int"))
    sizes = np.zeros(ranges, dtype=np.int64)
    for r in ranged.groupBy("__range").agg(F.count("*").alias("n")).collect():
        sizes[r["__range"]] = r["n"]
    before = df.sparkSession.createDataFrame(list(enumerate((np.cumsum(sizes) - sizes).tolist())), "__range int, __before long")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy("__h", key)) - 1
    return (ranged.withColumn("__row", inside).join(F.broadcast(before), "__range")  # one row for each range
            .withColumn("position", F.col("__before") + F.col("__row")).drop("__h", "__range", "__row", "__before"))


def exact_percentiles(counts: DataFrame, by: list[str], probabilities: dict[str, float],
                      value: str = "value", n: str = "n") -> DataFrame:
    """Linearly interpolated percentiles, one column per entry of ``probabilities``.

    Only the ranges that hold a wanted position are sorted.
    """
    ranged, keys = _ranges(counts, by, value, n)
    at = {name: F.lit(float(p)) * (F.col("total") - 1) for name, p in probabilities.items()}
    ends = [(name, side, f(at[name])) for name in at for side, f in (("lo", F.floor), ("hi", F.ceil))]
    wanted = reduce(lambda a, b: a | b, [
        (F.col("__offset") <= index) & (index < F.col("__offset") + F.col("__size")) for _, _, index in ends])
    placed = _place(ranged.where(wanted), keys, value, n)
    pick = [F.max(F.when((F.col("before") <= index) & (index < F.col("before") + F.col(n)), F.col(value)))
            .alias(f"__{name}_{side}") for name, side, index in ends]
    picked = placed.groupBy(*by).agg(F.max("total").alias("total"), *pick)

    def interpolated(name: str) -> Column:
        low, high = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        return (low + (at[name] - F.floor(at[name])) * (high - low)).alias(name)

    return picked.select(*by, F.col("total").alias("n_values"), *[interpolated(name) for name in at])


def _bracket(sketch: Column, n: Column, p: float) -> tuple[Column, Column]:
    """A low and a high value that hold the wanted positions unless the sketch errs by more than the slack; a small group is all inside."""
    small = n < F.lit(int(4 / abs(RANK_SLACK)) + 1)
    low, high = p - RANK_SLACK, p + RANK_SLACK
    lo, hi = F.lit(float("-inf")), F.lit(float("inf"))
    if low > 0:
        lo = F.when(small, lo).otherwise(F.kll_sketch_get_quantile_double(sketch, F.lit(low)))
    if high < 1:
        hi = F.when(small, hi).otherwise(F.kll_sketch_get_quantile_double(sketch, F.lit(high)))
    return lo, hi


def _cells(values: DataFrame, keys: list[str], brackets: DataFrame, n_brackets: int) -> DataFrame:
    """(values' keys..., cell, value, n): values inside a bracket one by one, the others as one count for each gap between.

    ``cell`` counts the brackets' ends below a value, so in order of (cell, value), null first, rows come in the order of their values.
    """
    hint = F.broadcast if n_brackets <= BROADCAST_CELLS else (lambda side: side)
    side = brackets.select(*[F.col(k).alias(f"__b_{k}") for k in keys], "__los", "__his")
    match = reduce(lambda a, b: a & b, [values[k].eqNullSafe(side[f"__b_{k}"]) for k in keys])
    below = F.size(F.filter("__his", lambda x: x < F.col("value")))
    inside = F.size(F.filter("__los", lambda x: x <= F.col("value"))) > below
    own = [c for c in values.columns if c != "value"]
    return (values.join(hint(side), match).select(*own, below.alias("cell"), F.when(inside, F.col("value")).alias("value"))
            .groupBy(*own, "cell", "value").agg(F.count("*").alias("n")))


def _sketches(df: DataFrame, columns: list[str]) -> DataFrame:
    """(part, column, s, n): a sketch of the non-null values of each column and part; the rows are grouped by part alone."""
    doubles = {c: F.col(f"`{c}`").cast("double") for c in columns}
    wide = df.groupBy("part").agg(F.array(*[
        F.struct(F.lit(c).alias("column"), F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias("s"), F.count(v).alias("n")) for c, v in doubles.items()
    ]).alias("found"))
    return wide.select("part", F.inline("found")).where("n > 0")


def _counted_cells(df: DataFrame, columns: list[str], brackets: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``_cells`` by (part, column) for brackets given as sorted lows and highs of each column, a number for each set."""
    columns = [c for c in columns if c in brackets]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps: dict[tuple[int, str, int], int] = {}

        def batch_of(part, column, cell, value, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(column, pa.string()), pa.array(cell, pa.int32()),
                                               pa.array(value, pa.float64()), pa.array(n, pa.int64())], ["part", "column", "cell", "value", "n"])

        for batch in batches:
            parts = batch.column(0).to_numpy()
            for i, c in enumerate(columns):
                given = batch.column(1 + i)
                has = given.is_valid().to_numpy(zero_copy_only=False)
                value, part = given.drop_null().to_numpy(), parts[has]
                los, his = brackets[c]
                below = np.searchsorted(his, value, "left")
                inside = np.searchsorted(los, value, "right") > below
                width = len(his) + 1
                keys, n = np.unique(part[~inside] * np.int64(width) + below[~inside], return_counts=True)
                for key, m in zip(keys.tolist(), n.tolist()):
                    at = (key // width, c, key % width)
                    gaps[at] = gaps.get(at, 0) + m
                if inside.any():
                    yield batch_of(part[inside], [c] * int(inside.sum()), below[inside], value[inside], np.ones(int(inside.sum()), dtype=np.int64))
        yield batch_of([k[0] for k in gaps], [k[1] for k in gaps], [k[2] for k in gaps], [None] * len(gaps), list(gaps.values()))

    rows = df.where("part IS NOT NULL").select("part", *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    counted = rows.mapInArrow(count, "part int, column string, cell int, value double, n long")
    return counted.groupBy("part", "column", "cell", "value").agg(F.sum("n").alias("n"))


def _picked(cells: DataFrame, count: int, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    """Percentiles by the keys from (keys..., cell, value, n); a column is null where its position is in no bracket."""
    group = Window.partitionBy(*keys)
    if count <= BROADCAST_CELLS:
        order = group.orderBy("cell", F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, -1)
        placed = cells.select(*keys, "value", "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"),
                              F.sum("n").over(group).alias("total"))
    else:
        gaps = cells.groupBy(*keys, "cell").agg(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("gap"),
                                                F.sum("n").alias("all"))
        gaps = gaps.select(*[F.col(k).alias(f"__g_{k}") for k in keys], F.col("cell").alias("__cell"),
                           F.sum("gap").over(Window.partitionBy(*keys).orderBy("cell")).alias("gap"),
                           F.sum("all").over(group).alias("total"))
        among = positions(cells.where("value IS NOT NULL"), keys).drop("total")
        match = reduce(lambda a, b: a & b, [among[k].eqNullSafe(gaps[f"__g_{k}"]) for k in keys]) & (among["cell"] == gaps["__cell"])
        placed = among.join(gaps, match).select(*keys, "value", "n", (F.col("before") + F.col("gap")).alias("before"), "total")
    at = {name: F.lit(float(p)) * (F.col("total") - 1) for name, p in probabilities.items()}

    def value_at(index: Column) -> Column:
        return F.max(F.when((F.col("before") <= index) & (index < F.col("before") + F.col("n")), F.col("value")))

    ends = placed.groupBy(*keys).agg(F.max("total").alias("total"), *[
        value_at(f(at[name])).alias(f"__{name}_{side}") for name in at for side, f in (("lo", F.floor), ("hi", F.ceil))])
    return ends.select(*keys, F.col("total").alias("n_values"), *[
        (F.col(f"__{name}_lo") + (at[name] - F.floor(at[name])) * (F.col(f"__{name}_hi") - F.col(f"__{name}_lo"))).alias(name) for name in at])


def percentiles(df: DataFrame, columns: list[str], by: list[str], probabilities: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated percentiles of each column and group, in two passes that keep no column.

    Sketches of the first pass bracket the wanted positions; the second pass counts what lies between the brackets and keeps only
    the values inside. The positions come from those counts, so they are exact; a group whose position is in no bracket
    (a sketch that erred) is seen, and then all groups are computed from full value counts.
    """
    keys = [*by, "column"]
    values = values_long(df, columns, by)
    sketched = values.groupBy(*keys).agg(F.kll_sketch_agg_double("value", F.lit(SKETCH_K)).alias("__s"), F.count("*").alias("__n"))
    pairs = [_bracket(F.col("__s"), F.col("__n"), p) for p in sorted(probabilities.values())]
    brackets, n = counted_cut(sketched.select(*keys, F.array(*[lo for lo, _ in pairs]).alias("__los"), F.array(*[hi for _, hi in pairs]).alias("__his")))
    cells, count = counted_cut(_cells(values, keys, brackets, n * 2 * len(pairs)))
    result = cut_lineage(_picked(cells, count, keys, probabilities))
    if result.where(reduce(lambda a, b: a | b, [F.col(name).isNull() for name in probabilities])).isEmpty():
        return result
    return exact_percentiles(values_long(df, columns, by).groupBy(*keys, "value").agg(F.count("*").alias("n")), keys, probabilities)


def set_medians(df: DataFrame, columns: list[str], part: str, sets: dict[int, Iterable[int]]) -> DataFrame:
    """(set, column, n_values, median) of unions of parts: each set is a list of values of the integer column ``part``.

    Any number of sets takes the same two passes over the rows: sketches and counts are made for each part and added up. A row
    gives all its columns at once in both.
    """
    spark = df.sparkSession
    members = spark.createDataFrame([(s, p) for s, ps in sets.items() for p in ps] or [], "set int, part int")
    df = df.withColumn("part", F.col(part).cast("int"))
    values = values_long(df, columns, ["part"])
    sketched = cut_lineage(_sketches(df, columns))
    merged = sketched.join(F.broadcast(members), "part").groupBy("set", "column").agg(
        F.kll_merge_agg_double("s").alias("__s"), F.sum("n").alias("__n"))
    lo, hi = _bracket(F.col("__s"), F.col("__n"), 0.5)
    brackets = cut_lineage(merged.select("column", lo.alias("lo"), hi.alias("hi")).groupBy("column").agg(
        F.sort_array(F.collect_list("lo")).alias("__los"), F.sort_array(F.collect_list("hi")).alias("__his")))  # a row for each set
    cells = cut_lineage(_counted_cells(df, columns, {r["column"]: (np.array(r["__los"]), np.array(r["__his"])) for r in brackets.collect()}))
    added, count = counted_cut(cells.join(F.broadcast(members), "part").groupBy("set", "column", "cell", "value").agg(F.sum("n").alias("n")))
    result = cut_lineage(_picked(added, count, ["set", "column"], {"median": 0.5}))
    if result.where("median IS NULL").isEmpty():
        return result
    counts = (values.groupBy("part", "column", "value").agg(F.count("*").alias("n")).join(F.broadcast(members), "part")
              .groupBy("set", "column", "value").agg(F.sum("n").alias("n")))
    return exact_percentiles(counts, ["set", "column"], {"median": 0.5})


def average_rank(df: DataFrame, value: str, by: list[str], rank: str = "rank", descending: bool = False) -> DataFrame:
    """Rank with ties averaged, within the groups ``by``; NULL values get no rank.

    The value is matched against its own counts, so it must not be a float sum that a recomputation could change in
    the last bit: checkpoint such a frame first.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    placed = positions(counts, by, value, "__n")
    ascending_rank = F.col("before") + (F.col("__n") + 1) / F.lit(2.0)
    ranked = F.col("total") + 1 - ascending_rank if descending else ascending_rank
    ranks = placed.select(*[F.col(c).alias(f"__r_{c}") for c in by], F.col(value).alias("__r_value"),
                          ranked.alias(rank))
    match = df[value] == ranks["__r_value"]
    for c in by:
        match = match & df[c].eqNullSafe(ranks[f"__r_{c}"])
    return df.join(ranks, match, "left").drop("__r_value", *[f"__r_{c}" for c in by])
