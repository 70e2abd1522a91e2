"""Variance components by the method of moments (Henderson I) and a two-stage environment-type test.

For y = mean + g + e + ge + error. The rows are reduced once to (group, environment) cells; everything after that works
on cells. Equal to REML for balanced data, otherwise an unbiased estimate; negative estimates are shown as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.cleaning import environment_id
from furrow.schema import ENV, ENVIRONMENTS, GROUP, TARGET

ENV_DEFINITIONS = {"loc_year": ["location", "year"], "loc_year_exp": ["location", "year", "experiment_name"]}


def _det(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def variance_components(df: DataFrame, env_parts: list[str], group: str = GROUP, target: str = TARGET) -> DataFrame:
    """(component, variance, pct) for group, environment, their interaction and the residual, largest first."""
    cells = (df.where(F.col(target).isNotNull())
             .groupBy(F.col(group).alias("g"), environment_id(*env_parts).alias("e"))
             .agg(F.count(target).cast("double").alias("n"), F.sum(target).alias("s"),
                  F.var_pop(target).alias("v")))
    whole = cells.agg(F.sum("n").alias("N"), F.sum("s").alias("S"), F.count("*").cast("double").alias("cells"),
                      F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("n")).alias("nn"),
                      F.sum(F.col("s") * F.col("s") / F.col("n")).alias("Tge"))

    def margin(side: str) -> DataFrame:
        """Sums over one margin: its uncorrected square sum, size square sum, cell square sum ratio and level count."""
        per_level = cells.groupBy(side).agg(F.sum("n").alias("m"), F.sum("s").alias("t"),
                                            F.sum(F.col("n") * F.col("n")).alias("q"))
        return per_level.agg(F.sum(F.col("t") * F.col("t") / F.col("m")).alias(f"T_{side}"),
                             F.sum(F.col("m") * F.col("m")).alias(f"mm_{side}"),
                             F.sum(F.col("q") / F.col("m")).alias(f"k_{side}"),
                             F.count("*").cast("double").alias(f"levels_{side}"))

    by_g, by_e = margin("g"), margin("e")
    row = whole.select("*", *[by_g.select(c).scalar().alias(c) for c in by_g.columns],
                       *[by_e.select(c).scalar().alias(c) for c in by_e.columns])
    N, mean_ss = F.col("N"), F.col("S") * F.col("S") / F.col("N")
    k1, k2, k12 = F.col("mm_g") / N, F.col("mm_e") / N, F.col("nn") / N
    k3, k4 = F.col("k_g"), F.col("k_e")
    a, b, s = F.col("levels_g"), F.col("levels_e"), F.col("cells")
    residual = F.col("within") / F.nullif(N - s, F.lit(0.0))
    left = [[N - k1, k3 - k2, k3 - k12], [k4 - k1, N - k2, k4 - k12], [k1 - k4, k2 - k3, N - k3 - k4 + k12]]
    right = [F.col("T_g") - mean_ss - (a - 1) * residual, F.col("T_e") - mean_ss - (b - 1) * residual,
             F.col("Tge") - F.col("T_g") - F.col("T_e") + mean_ss - (s - a - b + 1) * residual]
    base = F.nullif(_det(left), F.lit(0.0))
    solved = [_det([[right[r] if c == j else left[r][c] for c in range(3)] for r in range(3)]) / base
              for j in range(3)]
    names = [group, "environment", f"{group}:environment", "residual"]
    values = [F.greatest(v, F.lit(0.0)) for v in (*solved, residual)]
    listed = row.select(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    total = F.nullif(sum((F.col(f"v{i}") for i in range(1, 4)), F.col("v0")), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(n).alias("component"), F.col(f"v{i}").alias("variance"),
                              (100 * F.col(f"v{i}") / total).alias("pct")) for i, n in enumerate(names)])
    return listed.select(F.inline(rows)).orderBy(F.desc("pct"))


def environment_effect(df: DataFrame, env_parts: list[str] | None = None, target: str = TARGET) -> DataFrame:
    """MED against NE on environment means, so that one environment counts once: means, Welch t and its degrees."""
    parts = env_parts or ENV_DEFINITIONS["loc_year"]
    means = (df.where(F.col(target).isNotNull() & F.col(ENV).isin(*ENVIRONMENTS))
             .groupBy(ENV, environment_id(*parts).alias("e")).agg(F.avg(target).alias("m")))
    sides = means.agg(*[f(F.when(F.col(ENV) == e, F.col("m"))).alias(f"{n}_{e.lower()}")
                        for e in ENVIRONMENTS for n, f in
                        (("n_envs", F.count), ("mean", F.avg), ("var", F.var_samp))])
    se2 = {e: F.col(f"var_{e}") / F.nullif(F.col(f"n_envs_{e}").cast("double"), F.lit(0.0)) for e in ("ne", "med")}
    pooled = se2["ne"] + se2["med"]
    t = (F.col("mean_med") - F.col("mean_ne")) / F.nullif(F.sqrt(pooled), F.lit(0.0))
    spread = sum((se2[e] * se2[e] / F.nullif((F.col(f"n_envs_{e}") - 1).cast("double"), F.lit(0.0))
                  for e in ("med",)), se2["ne"] * se2["ne"]
                 / F.nullif((F.col("n_envs_ne") - 1).cast("double"), F.lit(0.0)))
    return sides.select("*", (F.col("mean_med") - F.col("mean_ne")).alias("difference"), t.alias("welch_t"),
                        (pooled * pooled / F.nullif(spread, F.lit(0.0))).alias("welch_df"))
