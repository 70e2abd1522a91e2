"""Grouped cross-validation folds.

Groups are taken largest first and each goes to the lightest fold (lowest number on a tie). Among equally large groups
the order is that of the MD5 of the group label. Only the size histogram (at most sqrt(2 * rows) distinct sizes) is
walked in order; for one size the greedy choice has a closed form, so all groups get their fold in parallel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.session import cut_lineage

PREFIX = 3  # hex digits of the MD5 that spread the groups of one size over 4096 ranges


def group_label(group: str):
    """Group as text; missing labels form one group."""
    return F.coalesce(F.col(group).cast("string"), F.lit("<NA>"))


def _fill_rules(k: int, by: list[str]):
    """Walk the sizes in descending order and describe how each size class fills the folds.

    With folds at loads L and size s, the picks are the numbers L[b] + j * s in ascending (value, b) order: within one
    level floor(value / s) the folds follow each other by (L[b] mod s, b), and a fold takes part from level L[b] // s on.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        classes = pdf.sort_values("size", ascending=False)
        if int(classes["n_groups"].sum()) < k:
            raise ValueError(f"{int(classes['n_groups'].sum())} groups but n_splits={k}")
        loads = [0] * k
        rows = []
        for size, n_groups in zip(classes["size"].tolist(), classes["n_groups"].tolist()):
            entry = {b: loads[b] // size for b in range(k)}
            levels = sorted(set(entry.values()))
            starts, members, start = [], [], 0
            for i, level in enumerate(levels):
                if start >= n_groups:
                    break
                active = sorted((b for b in range(k) if entry[b] <= level), key=lambda b: (loads[b] % size, b))
                starts.append(start)
                members.append(active)
                last = i + 1 == len(levels)
                span = n_groups - start if last else min((levels[i + 1] - level) * len(active), n_groups - start)
                whole, rest = divmod(span, len(active))
                for position, b in enumerate(active):
                    loads[b] += size * (whole + (position < rest))
                start += span
            rows.append((size, starts, members))
        out = pd.DataFrame(rows, columns=["size", "starts", "members"])
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "size", "starts", "members"]]

    return walk


def assign_folds(sizes: DataFrame, k: int, group: str = "group", size: str = "size",
                 by: list[str] | None = None, fold: str = "fold") -> DataFrame:
    """(by..., group, fold) for a frame of group sizes; the folds are independent per ``by``."""
    by = by or []
    tagged = sizes.select(*by, group, F.col(size).alias("size"),
                          F.md5(F.col(group).cast("binary")).alias("__hash"))
    tagged = tagged.withColumn("__range", F.substring("__hash", 1, PREFIX))
    types = dict(tagged.dtypes)
    classes = tagged.groupBy(*by, "size").agg(F.count("*").alias("n_groups"))
    schema = ", ".join([f"`{c}` {types[c]}" for c in by]
                       + ["size long", "starts array<long>", "members array<array<int>>"])
    rules = classes.groupBy(*by).applyInPandas(_fill_rules(k, by), schema)
    ranges = (tagged.groupBy(*by, "size", "__range").agg(F.count("*").alias("__n"))
              .withColumn("__offset", F.sum("__n").over(
                  Window.partitionBy(*by, "size").orderBy("__range")) - F.col("__n"))
              .drop("__n"))
    inside = Window.partitionBy(*by, "size", "__range").orderBy("__hash", group)
    ranked = (tagged.withColumn("__row", F.row_number().over(inside) - 1)
              .join(ranges, [*by, "size", "__range"])
              .withColumn("__t", F.col("__offset") + F.col("__row")))
    stage = F.size(F.filter("starts", lambda s: s <= F.col("__t")))
    chosen = F.col("members")[stage - 1]
    return (ranked.join(rules, [*by, "size"])
            .select(*by, group, chosen[((F.col("__t") - F.col("starts")[stage - 1])
                                        % F.size(chosen)).cast("int")].alias(fold)))


def group_kfold(df: DataFrame, group: str, k: int, fold: str = "fold") -> DataFrame:
    """Add the fold of each row's group."""
    if group not in df.columns:
        raise ValueError(f"group column not present: {group}")
    labelled = df.withColumn("__group", group_label(group))
    sizes = labelled.groupBy("__group").agg(F.count("*").alias("size"))
    chosen = cut_lineage(assign_folds(sizes, k, "__group", fold=fold))  # of known size: few groups are sent to the rows, not dealt with them
    return labelled.join(chosen, "__group").drop("__group")


def nested_folds(df: DataFrame, group: str, outer: int, inner: int) -> DataFrame:
    """(group, outer_fold, held_out, inner_fold): inner folds of every outer training set, per group.

    ``held_out`` is the outer fold left out; the group's own ``outer_fold`` always differs from it.
    """
    labels = df.select(group_label(group).alias("group")).groupBy("group").agg(F.count("*").alias("size"))
    outer_map = assign_folds(labels, outer, fold="outer_fold")
    training = (labels.join(outer_map, "group")
                .withColumn("held_out", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))
                .where("held_out <> outer_fold"))
    inner_map = assign_folds(training.select("held_out", "group", "size"), inner, by=["held_out"], fold="inner_fold")
    return training.select("group", "outer_fold", "held_out").join(inner_map, ["held_out", "group"])


def leaked_groups(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    """Groups present on both sides."""
    return train.select(group).intersect(test.select(group))


def assert_no_leakage(train: DataFrame, test: DataFrame, group: str) -> None:
    if leaked_groups(train, test, group).limit(1).count():
        raise AssertionError(f"some values of {group} are in both the fitted and the tested rows")


def leaking_groups(data: DataFrame, group: str, train: Column, test: Column, k: int) -> DataFrame:
    """Groups with rows that are tested in a fold and fitted outside of it, for all k folds in one aggregate.

    Each group gets the set of folds it is fitted and tested in, as bits; with more than one fold among them it leaks.
    """
    words, sides = range(-(-k // 63)), {"__t": train, "__s": test}
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("fold") % 63).cast("int"))
    masks = data.groupBy(group_label(group).alias("group")).agg(*[
        F.coalesce(F.bit_or(F.when(side & (F.floor(F.col("fold") / 63) == w), bit)), F.lit(0).cast("long")).alias(f"{name}{w}")
        for name, side in sides.items() for w in words])
    seen = [sum((F.bit_count(f"{name}{w}") for w in words), F.lit(0)) > 0 for name in sides]
    both = sum((F.bit_count(F.col(f"__t{w}").bitwiseOR(F.col(f"__s{w}"))) for w in words), F.lit(0))
    return masks.where(seen[0] & seen[1] & (both > 1)).select("group")


def assert_folds_apart(data: DataFrame, group: str, train: Column, test: Column, k: int) -> None:
    if leaking_groups(data, group, train, test, k).limit(1).count():
        raise AssertionError(f"some values of {group} are in both the fitted and the tested rows")
