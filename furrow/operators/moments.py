"""Sums of products by group: what linear fits need from the rows, in one pass.

The sums of a union of groups are the sums of its parts, so one table of them serves every training set that is made of groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROOM = 1 << 23  # bytes of sums that a task holds before it sends them on


def grouped_moments(df: DataFrame, key: Column, items: list[Column]) -> dict[int, np.ndarray]:
    """For each value of an integer key the matrix of sums of products of (1, items...); null items count as 0.

    Tasks add up their rows first; groups times the squared number of items is what is shuffled by each task and reaches the driver.
    """
    width = len(items) + 1
    values = F.array(F.lit(1.0), *[F.coalesce(i.cast("double"), F.lit(0.0)) for i in items])

    def packed(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        keys = np.repeat(np.fromiter(sums, dtype=np.int64, count=len(sums)), width)
        rows = np.concatenate(list(sums.values())) if sums else np.zeros((0, width))
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(np.tile(np.arange(width, dtype=np.int32), len(sums))),
             pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(rows.ravel()))],
            ["key", "i", "sums"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = batch.column("z").flatten().to_numpy().reshape(-1, width)
            keys = batch.column("key").to_numpy()
            order = np.argsort(keys, kind="stable")
            begin = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
            for low, high in zip(begin.tolist(), np.append(begin[1:], len(keys)).tolist(), strict=True):
                part = z[order[low:high]]
                group = int(keys[order[low]])
                sums[group] = sums[group] + part.T @ part if group in sums else part.T @ part
            if len(sums) * width * width * 8 > ROOM:
                yield packed(sums)
                sums = {}
        yield packed(sums)

    parts = df.select(key.cast("long").alias("key"), values.alias("z")).mapInArrow(add_up, "key long, i int, sums array<double>")
    total = parts.groupBy("key", "i").agg(F.array(*[F.sum(F.col("sums")[j]) for j in range(width)]).alias("sums"))
    out: dict[int, np.ndarray] = {}
    for r in total.collect():
        out.setdefault(r["key"], np.zeros((width, width)))[r["i"]] = r["sums"]
    return out


def pattern_of(columns: list[str]) -> Column:
    """Which of the columns are null, as the bits of a long."""
    return reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(columns)]).cast("long")


class PatternImputer:
    """Fills missing columns by an affine map of the present ones, one map for each pattern of missing columns."""

    def __init__(self, columns: list[str], centres: np.ndarray, maps: dict[int, np.ndarray]):
        self.columns, self.centres, self.maps = columns, centres, maps

    def transform(self, df: DataFrame) -> DataFrame:
        """One map job; the maps (patterns times squared columns, counted when they were fitted) are sent to every task."""
        flat = [(p, m[1:].ravel().tolist()) for p, m in self.maps.items()]
        table = df.sparkSession.createDataFrame(flat, "__pattern long, __map array<double>")
        width = len(self.columns) + 1
        z = [F.lit(1.0)] + [F.coalesce(F.col(c).cast("double") - F.lit(float(m)), F.lit(0.0)) for c, m in zip(self.columns, self.centres)]

        def filled(k: int, c: str) -> Column:
            value = reduce(lambda a, b: a + b, [F.col("__map")[k * width + j] * z[j] for j in range(width)])
            return F.coalesce(F.col(c).cast("double"), value + F.lit(float(self.centres[k])))

        return (df.withColumn("__pattern", pattern_of(self.columns)).join(F.broadcast(table), "__pattern", "left")
                .withColumns({c: filled(k, c) for k, c in enumerate(self.columns)}).drop("__pattern", "__map"))


class RegressionChain:
    """Rounds of regressions of each column on the others, computed on the moments of each pattern.

    The state of a row with the pattern p is the affine map T[p] of what it has; a round replaces the maps of missing entries by
    the regression's. The rows' moments under T are T S T', so no round reads the rows.
    """

    def __init__(self, patterns: np.ndarray, sums: np.ndarray, start: np.ndarray, order: list[int]):
        width = sums.shape[1]
        self.missing = (patterns[:, None] >> np.arange(width - 1)) & 1 == 1
        self.sums, self.order = sums, order
        maps = np.tile(np.eye(width), (len(patterns), 1, 1))
        p, c = np.nonzero(self.missing)
        maps[p, c + 1] = 0.0
        maps[p, c + 1, 0] = start[c]
        self.rounds = [maps]

    def step(self) -> None:
        maps = self.rounds[-1].copy()
        for c in self.order:
            has = ~self.missing[:, c]
            moments = np.einsum("pij,pjk,plk->il", maps[has], self.sums[has], maps[has], optimize=True)
            means = moments[0, 1:] / moments[0, 0]
            spread = moments[1:, 1:] - moments[0, 0] * np.outer(means, means)
            rest = [j for j in range(len(means)) if j != c]
            weights = np.linalg.lstsq(spread[np.ix_(rest, rest)], spread[rest, c], rcond=1e-12)[0]
            value = np.einsum("j,pjk->pk", weights, maps[:, [j + 1 for j in rest]])
            value[:, 0] += means[c] - weights @ means[rest]
            maps[~has, c + 1] = value[~has]
        self.rounds.append(maps)

    def change(self, number: int) -> np.ndarray:
        """(pattern, ordered column): the difference that a round makes, as a map."""
        return (self.rounds[number] - self.rounds[number - 1])[:, [c + 1 for c in self.order]]

    def least_move(self, number: int) -> float:
        """A lower bound of a round's largest move: the root of the mean square in some pattern."""
        change = self.change(number)
        square = np.einsum("pci,pij,pcj->pc", change, self.sums, change, optimize=True)
        n = self.sums[:, 0, 0]
        return float(np.sqrt(np.maximum(square[n > 0] / n[n > 0, None], 0.0)).max(initial=0.0))


def largest_moves(df: DataFrame, columns: list[str], centres: np.ndarray, patterns: np.ndarray, chains: dict[int, RegressionChain],
                  asked: dict[int, list[int]]) -> dict[tuple[int, int], float]:
    """(fold, round): the largest move of a value of the rows outside the fold, for the asked rounds, in one pass."""
    changes = {(f, r): chains[f].change(r) for f, rs in asked.items() for r in rs}
    sent = df.sparkSession.sparkContext.broadcast((patterns, changes))
    z = F.array(F.lit(1.0), *[F.coalesce(F.col(c).cast("double") - F.lit(float(m)), F.lit(0.0)) for c, m in zip(columns, centres)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = sent.value
        most = dict.fromkeys(wanted, 0.0)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("z").flatten().to_numpy().reshape(batch.num_rows, -1)
            at, fold = np.searchsorted(known, batch.column("pattern").to_numpy()), batch.column("fold").to_numpy()
            for f, r in wanted:
                rows = np.flatnonzero(fold != f)
                if len(rows):
                    moved = np.einsum("nci,ni->nc", wanted[f, r][at[rows]], values[rows])
                    most[f, r] = max(most[f, r], float(np.abs(moved).max(initial=0.0)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in most], pa.int32()), pa.array([k[1] for k in most], pa.int32()),
             pa.array(list(most.values()), pa.float64())], ["held_out", "round", "moved"])

    rows = df.select(F.col("fold").cast("int").alias("fold"), pattern_of(columns).alias("pattern"), z.alias("z"))
    found = rows.mapInArrow(run, "held_out int, round int, moved double").groupBy("held_out", "round").agg(F.max("moved").alias("moved"))
    out = {(r["held_out"], r["round"]): r["moved"] for r in found.collect()}
    sent.unpersist()
    return out
