"""Ridge regressions of many training sets from one pass of sums of products.

A training set is made of (fold, number of missing features) parts. The sums of products of present values, missing flags, category
flags and the target are made once for each part; the sums of any set of parts are theirs added up. Imputation and scaling
are affine in those columns, so the normal equations of every fold, threshold, imputation and penalty follow on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.order_stats import set_medians
from furrow.operators.features import MISSING_CATEGORY, NumericStats
from furrow.operators.moments import grouped_moments


@dataclass(frozen=True)
class RidgeRun:
    """One fit for each fold: training rows with at most ``threshold`` of the features missing, filled by ``impute``."""

    threshold: float = 1.0
    alpha: float = 1.0
    impute: str = "median"
    indicators: bool = True


def _category(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY))


class RidgeFolds:
    """Sums of the training rows of every (fold, missing count); ``rows`` has fold and missing_frac.

    Passes over the rows: one for the centres and categories, one for the sums, and two for the medians if a run asks for them.
    Parts times the squared number of slots is what reaches the driver; categories are as many as the encoded model has anyway.
    """

    def __init__(self, rows: DataFrame, k: int, target: str, numeric: list[str], categorical: list[str]):
        self.rows, self.k, self.target, self.numeric, self.categorical = rows, k, target, numeric, categorical
        self.span = len(numeric) + 1
        missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in numeric], F.lit(0))
        self.marked = rows.withColumn("__part", F.col("fold").cast("int") * F.lit(self.span) + missing)
        means = [F.avg(F.col(c).cast("double")) for c in (*numeric, target)]
        first = rows.agg(*means, *[F.sort_array(F.collect_set(_category(c))) for c in categorical]).first()
        self.centres = np.array([first[i] or 0.0 for i in range(len(means))])
        self.levels = [list(first[len(means) + i]) for i in range(len(categorical))]
        shifted = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip((*numeric, target), self.centres)]
        flags = [F.col(c).isNull().cast("double") for c in numeric]
        slots = [(_category(c) == v).cast("double") for c, values in zip(categorical, self.levels) for v in values]
        self.sums = grouped_moments(self.marked, F.col("__part"), [*shifted[:-1], *flags, *slots, shifted[-1]])
        self._medians: dict[tuple[int, float], dict[str, float]] = {}

    def parts(self, fold: int, threshold: float) -> list[int]:
        """Parts outside the fold whose share of missing features is within the threshold."""
        return [p for p in self.sums if p // self.span != fold and (p % self.span) / max(len(self.numeric), 1) <= threshold]

    def _need_medians(self, thresholds: list[float]) -> None:
        wanted = [(f, t) for t in dict.fromkeys(thresholds) for f in range(self.k) if (f, t) not in self._medians]
        if not wanted or not self.numeric:
            return
        self._medians.update({w: {} for w in wanted})
        found = set_medians(self.marked, self.numeric, "__part", {i: self.parts(f, t) for i, (f, t) in enumerate(wanted)})
        for r in found.collect():
            self._medians[wanted[r["set"]]][r["column"]] = r["median"]

    def _fit(self, fold: int, run: RidgeRun) -> list[float] | None:
        """Coefficients of (1, shifted values, missing flags, category flags) for the raw target; None without training rows."""
        parts = self.parts(fold, run.threshold)
        if not parts:
            return None
        sums, d = sum(self.sums[p] for p in parts), len(self.numeric)
        n = sums[0, 0]
        slots = sums.shape[0] - 1  # without the target
        scaled = np.zeros((2 * d if run.indicators else d, slots))
        for j, c in enumerate(self.numeric):
            seen = n - sums[0, 1 + d + j]
            mean = sums[0, 1 + j] / seen if seen else 0.0
            var = max(sums[1 + j, 1 + j] / seen - mean ** 2, 0.0) if seen else 0.0
            median = self._medians.get((fold, run.threshold), {}).get(c, 0.0)
            own = NumericStats(int(n), int(round(seen)), self.centres[j] + mean, var, median)
            centre, spread = own.scale(run.impute)
            fill = own.fill(run.impute)
            scaled[j, [0, 1 + j, 1 + d + j]] = np.array([self.centres[j] - centre, 1.0, fill - self.centres[j]]) / spread
            if run.indicators:
                scaled[d + j, 1 + d + j] = 1.0
        encoded = np.vstack([scaled, np.eye(slots)[1 + 2 * d:]])
        products = encoded @ sums[:slots, :slots] @ encoded.T
        means, goal = encoded @ sums[0, :slots] / n, sums[0, slots] / n
        spread = products - n * np.outer(means, means)
        cross = encoded @ sums[:slots, slots] - n * means * goal
        weights = np.linalg.lstsq(spread + run.alpha * np.eye(len(spread)), cross, rcond=None)[0]
        out = weights @ encoded
        out[0] += goal - weights @ means + self.centres[-1]
        return out.tolist()

    def predict(self, rows: DataFrame, runs: list[RidgeRun]) -> DataFrame:
        """``rows`` (with fold) once for each run: ``run`` is its index, ``y_pred`` comes from the models outside the row's fold."""
        self._need_medians([r.threshold for r in runs if r.impute == "median"])
        table = rows.sparkSession.createDataFrame(
            [(f, i, self._fit(f, run)) for f in range(self.k) for i, run in enumerate(runs)], "fold int, run int, __w array<double>")
        d = len(self.numeric)
        value = F.col("__w")[0]
        for j, c in enumerate(self.numeric):
            shifted = F.coalesce(F.col(c).cast("double") - F.lit(float(self.centres[j])), F.lit(0.0))
            value = value + F.col("__w")[1 + j] * shifted + F.when(F.col(c).isNull(), F.col("__w")[1 + d + j]).otherwise(F.lit(0.0))
        at = 1 + 2 * d
        for c, values in zip(self.categorical, self.levels):
            if values:
                place = F.array_position(F.array(*[F.lit(v) for v in values]), _category(c))
                value = value + F.when(place > 0, F.col("__w")[(place + at - 1).cast("int")]).otherwise(F.lit(0.0))
            at += len(values)
        fits = F.broadcast(table.withColumnRenamed("fold", "__fold"))  # folds times runs
        return rows.join(fits, F.col("fold") == F.col("__fold")).withColumn("y_pred", value).drop("__w", "__fold")
