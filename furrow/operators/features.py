"""Feature statistics and the preprocessing stages of each model profile, all from training rows only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.order_stats import set_medians, value_counts_long
from furrow.operators.moments import PatternImputer, RegressionChain, grouped_moments, largest_moves, pattern_of
from furrow.session import cut_lineage

# Numeric policy of each profile and the category that stands for a missing one.
PROFILES = {"linear": ("median", "standard"), "tree": ("median", "standard"), "booster": ("none", "standard"),
            "native_missing": ("none", "none")}
MISSING_CATEGORY = "__CONSTANT__"
SENTINEL = -1.0e6
MAX_PATTERNS = 1 << 14


@dataclass(frozen=True)
class NumericStats:
    """Training statistics of one column."""

    n_rows: int
    n: int
    mean: float
    var: float
    median: float

    def fill(self, strategy: str) -> float | None:
        value = {"median": self.median, "mean": self.mean, "none": None}[strategy]
        return value

    def scale(self, strategy: str) -> tuple[float, float]:
        """Mean and population std after filling; a constant column is only centred."""
        if self.n == 0:
            return 0.0, 1.0
        fill = self.fill(strategy)
        if fill is None or self.n == self.n_rows:
            mean, var = self.mean, self.var
        else:
            empty = self.n_rows - self.n
            mean = (self.n * self.mean + empty * fill) / self.n_rows
            var = (self.n * (self.var + (self.mean - mean) ** 2) + empty * (fill - mean) ** 2) / self.n_rows
        return mean, var ** 0.5 if var > 0 else 1.0


def training_counts(kept: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(held_out, column, value, n) over the rows outside each fold; expanded after counting, not before."""
    return (value_counts_long(kept, columns, ["fold"])
            .withColumn("held_out", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
            .where("held_out <> fold")
            .groupBy("held_out", "column", "value").agg(F.sum("n").alias("n")))


def training_medians(kept: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(held_out, column, median) of the rows outside each fold."""
    # with one fold, what lies outside is whatever number the caller gave it
    sets = {f: [g for g in range(max(k, 2)) if g != f] for f in range(k)}
    return set_medians(kept, columns, "fold", sets).select(F.col("set").alias("held_out"), "column", "median")


def fold_statistics(kept: DataFrame, columns: list[str], k: int) -> dict[int, dict[str, NumericStats]]:
    """Statistics of the training rows of every fold; k * columns numbers reach the driver."""
    aggregates = [F.count("*").alias("rows")]
    for c in columns:
        aggregates += [F.count(c).alias(f"{c}__n"), F.avg(c).alias(f"{c}__mean"), F.var_pop(c).alias(f"{c}__var")]
    parts = {r["fold"]: r for r in kept.groupBy("fold").agg(*aggregates).collect()}
    medians = {(r["held_out"], r["column"]): r["median"] for r in training_medians(kept, columns, k).collect()}
    out = {}
    for held_out in range(k):
        train = [r for fold, r in parts.items() if fold != held_out]
        rows = sum(r["rows"] for r in train)
        out[held_out] = {}
        for c in columns:
            seen = [(r[f"{c}__n"], r[f"{c}__mean"], r[f"{c}__var"]) for r in train if r[f"{c}__n"]]
            n = sum(s[0] for s in seen)
            mean = sum(s[0] * s[1] for s in seen) / n if n else 0.0
            var = sum(s[0] * (s[2] + (s[1] - mean) ** 2) for s in seen) / n if n else 0.0
            out[held_out][c] = NumericStats(rows, n, mean, var, medians.get((held_out, c), 0.0))
    return out


def full_statistics(kept: DataFrame, columns: list[str]) -> dict[str, NumericStats]:
    """Statistics over all rows: fold 0 of a two-fold layout whose own part is empty."""
    return fold_statistics(kept.withColumn("fold", F.lit(1)), columns, 1)[0]


def _quoted(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def numeric_sql(columns: list[str], stats: dict[str, NumericStats], impute: str, scale: str,
                indicators: bool) -> tuple[list[str], list[str]]:
    """SELECT items for filled and scaled values (prefix num_values__) and missing flags (num_miss__)."""
    items, names = [], []
    for c in columns:
        fill = stats[c].fill(impute)
        value = f"CAST(`{c}` AS DOUBLE)"
        if fill is not None:
            value = f"coalesce({value}, {_quoted(fill)})"
        if scale == "standard":
            mean, std = stats[c].scale(impute)
            value = f"({value} - {_quoted(mean)}) / {_quoted(std)}"
        if fill is None:
            value = f"coalesce({value}, {_quoted(SENTINEL)})"
        items.append(f"{value} AS `num_values__{c}`")
        names.append(f"num_values__{c}")
    if indicators:
        items += [f"CAST(`{c}` IS NULL AS DOUBLE) AS `num_miss__{c}`" for c in columns]
        names += [f"num_miss__{c}" for c in columns]
    return items, names


def preprocessor(profile: str, numeric: list[str], categorical: list[str], stats: dict[str, NumericStats],
                 impute: str | None = None, indicators: bool | None = None) -> Pipeline:
    """Unfitted stages that add a ``features`` vector.

    Imputation and scaling are plain SQL with the training statistics written in; only the category list is fitted.
    Unknown categories become all zeros: the indexer's extra slot is the one the encoder drops. Trees that cannot take
    missing numbers see a sentinel far below the range, with a flag.
    """
    if profile not in PROFILES:
        raise ValueError(f"Unknown profile: {profile}")
    default_impute, scale = PROFILES[profile]
    impute = impute or default_impute
    flags = True if indicators is None else indicators
    items, names = numeric_sql(numeric, stats, impute, scale, flags)
    items += [f"coalesce(CAST(`{c}` AS STRING), '{MISSING_CATEGORY}') AS `cat_text__{c}`" for c in categorical]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(items)} FROM __THIS__")]
    if categorical:
        texts, codes = [f"cat_text__{c}" for c in categorical], [f"cat_code__{c}" for c in categorical]
        flags_out = [f"cat__{c}" for c in categorical]
        stages += [StringIndexer(inputCols=texts, outputCols=codes, handleInvalid="keep",
                                 stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCols=codes, outputCols=flags_out, dropLast=True, handleInvalid="error")]
        names += flags_out
    stages.append(VectorAssembler(inputCols=names, outputCol="features"))
    return Pipeline(stages=stages)


def encoded_names(fitted: PipelineModel, numeric_names: list[str], categorical: list[str]) -> list[str]:
    """Names of the vector slots: numeric ones first, then category_value."""
    names = list(numeric_names)
    if categorical:
        indexer = next(s for s in fitted.stages if hasattr(s, "labelsArray"))
        for c, labels in zip(categorical, indexer.labelsArray):
            names += [f"cat__{c}_{label}" for label in labels]
    return names


def encoded_owners(fitted: PipelineModel, numeric: list[str], categorical: list[str]) -> list[str]:
    """The feature that each vector slot stems from, with missing flags; same order as ``encoded_names``."""
    owners = [*numeric, *numeric]
    if categorical:
        indexer = next(s for s in fitted.stages if hasattr(s, "labelsArray"))
        owners += [c for c, labels in zip(categorical, indexer.labelsArray) for _ in labels]
    return owners


def fill_values(df: DataFrame, stats: dict[str, NumericStats], strategy: str) -> DataFrame:
    """Median or mean imputation as plain columns."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(s.fill(strategy)))
                           for c, s in stats.items()})


def missing_indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"num_miss__{c}": F.col(c).isNull().cast("double") for c in columns})


def held_out_imputation(df: DataFrame, columns: list[str], k: int, strategy: str = "median") -> DataFrame:
    """Each row's missing values filled from the training rows of its own fold, for all folds in one pass."""
    if strategy == "median":
        values = training_medians(df, columns, k).select("held_out", "column", F.col("median").alias("v"))
    else:
        values = (training_counts(df, columns, k).groupBy("held_out", "column")
                  .agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("v")))
    wide = (values.groupBy("held_out").pivot("column", columns).agg(F.first("v"))
            .select(F.col("held_out").alias("fold"), *[F.col(c).alias(f"__fill_{c}") for c in columns]))
    return (df.join(F.broadcast(wide), "fold")  # at most k rows
            .withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__fill_{c}")) for c in columns})
            .drop(*[f"__fill_{c}" for c in columns]))


def held_out_scaling(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Each row standardised with the population statistics of its fold's training rows, missing values ignored."""
    parts = df.groupBy("fold").agg(
        *[f(c).alias(f"{n}_{c}") for c in columns for n, f in
          (("n", F.count), ("m", F.avg), ("v", F.var_pop))])
    training = (parts.withColumnRenamed("fold", "own")
                .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("own <> fold"))
    means = training.groupBy("fold").agg(
        *[(F.sum(F.col(f"n_{c}") * F.col(f"m_{c}")) / F.nullif(F.sum(f"n_{c}").cast("double"), F.lit(0.0)))
          .alias(f"mean_{c}") for c in columns])
    spread = training.join(means, "fold").groupBy("fold").agg(
        *[F.max(f"mean_{c}").alias(f"mean_{c}") for c in columns],
        *[F.sqrt(F.sum(F.col(f"n_{c}") * (F.col(f"v_{c}") + F.pow(F.col(f"m_{c}") - F.col(f"mean_{c}"), F.lit(2))))
                 / F.nullif(F.sum(f"n_{c}").cast("double"), F.lit(0.0))).alias(f"std_{c}") for c in columns])
    scaled = {c: (F.col(c) - F.col(f"mean_{c}"))
              / F.when(F.col(f"std_{c}") > 0, F.col(f"std_{c}")).otherwise(F.lit(1.0)) for c in columns}
    return (df.join(F.broadcast(spread), "fold")  # at most k rows
            .withColumns(scaled).drop(*[f"{p}_{c}" for c in columns for p in ("mean", "std")]))


def _least_squares(df: DataFrame, inputs: list[str], label: str, centres: dict[str, float]) -> tuple[list[float], float]:
    """Coefficients and intercept of a regression, from one aggregation; the centres only keep the sums small."""
    names = [*inputs, label]
    shifted = [F.col(c) - F.lit(float(centres[c])) for c in names]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    row = df.agg(F.count("*"), *[F.sum(x) for x in shifted], *[F.sum(shifted[i] * shifted[j]) for i, j in pairs]).first()
    n, sums, products = row[0], np.array(row[1:1 + len(names)], dtype=float), row[1 + len(names):]
    spread = np.zeros((len(names), len(names)))
    for (i, j), value in zip(pairs, products, strict=True):
        spread[i, j] = spread[j, i] = value - sums[i] * sums[j] / n
    weights = np.linalg.lstsq(spread[:-1, :-1], spread[:-1, -1], rcond=1e-12)[0]
    means = sums / n + [centres[c] for c in names]
    return [float(w) for w in weights], float(means[-1] - weights @ means[:-1])


def fit_imputers(train: DataFrame, columns: list[str], k: int, rounds: int = 10, tolerance: float = 1e-3,
                 others: list[DataFrame] = ()) -> dict[int, PatternImputer] | None:
    """Iterative imputation for every fold of ``train`` (column ``fold``): imputer f is fitted on the rows outside fold f.

    Missing values start as the training medians; in each round every column with gaps, fewest first, is regressed on the others
    and its gaps take the prediction. A row's state is an affine map of what it has, given by its pattern of gaps, so the
    moments of each (fold, pattern) hold all that the rounds need: one pass for those, one more only if the moments leave open in
    which round no value moved more than the tolerance times the largest value. ``others`` are rows to be filled later, read
    for their patterns. None if there are more than ``MAX_PATTERNS`` patterns.
    """
    stats = fold_statistics(train, columns, k)
    sides = train.groupBy("fold").agg(F.count("*").alias("rows"), *[F.max(F.abs(F.col(c).cast("double"))).alias(f"top_{c}") for c in columns],
                                      *[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in columns]).collect()
    seen = {c: [(r["rows"], r[f"mean_{c}"]) for r in sides if r[f"mean_{c}"] is not None] for c in columns}
    centres = np.array([sum(n * m for n, m in seen[c]) / sum(n for n, _ in seen[c]) if seen[c] else 0.0 for c in columns])
    found = reduce(DataFrame.unionByName, [d.select(pattern_of(columns).alias("p")) for d in (train, *others)]).distinct()
    patterns = np.array(sorted(r["p"] for r in found.limit(MAX_PATTERNS + 1).collect()), dtype=np.int64)
    if len(patterns) > MAX_PATTERNS:
        return None
    shifted = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(columns, centres)]
    span = 1 << len(columns)
    moments = grouped_moments(train, F.col("fold").cast("long") * F.lit(span) + pattern_of(columns), shifted)
    none = np.zeros((len(columns) + 1, len(columns) + 1))
    chains, limits = {}, {}
    for fold in range(k):
        sums = np.array([sum((m for key, m in moments.items() if key % span == p and key // span != fold), none) for p in patterns.tolist()])
        own = stats[fold]
        order = [columns.index(c) for c in sorted(columns, key=lambda c: own[c].n_rows - own[c].n) if 0 < own[c].n < own[c].n_rows]
        start = np.array([own[c].median for c in columns]) - centres
        limits[fold] = tolerance * max((r[f"top_{c}"] for r in sides if r["fold"] != fold for c in columns if r[f"top_{c}"] is not None),
                                       default=0.0)
        chains[fold] = RegressionChain(patterns, sums.reshape(len(patterns), *none.shape), start, order)
        for _ in range(rounds if len(columns) > 1 and order else 0):
            chains[fold].step()
    # the bound must clear the limit by more than rounding does
    open_rounds = {f: [r for r in range(1, len(c.rounds)) if c.least_move(r) < limits[f] * (1 + 1e-9)] for f, c in chains.items()}
    open_rounds = {f: list(range(rs[0], len(chains[f].rounds))) for f, rs in open_rounds.items() if rs}
    moves = largest_moves(train, columns, centres, patterns, chains, open_rounds) if open_rounds else {}
    out = {}
    for fold, chain in chains.items():
        ends = [r for r in open_rounds.get(fold, ()) if moves.get((fold, r), 0.0) < limits[fold]]
        last = chain.rounds[ends[0] if ends else -1]
        out[fold] = PatternImputer(columns, centres, dict(zip(patterns.tolist(), last)))
    return out


def iterative_impute(train: DataFrame, others: list[DataFrame], columns: list[str], rounds: int = 10,
                     tolerance: float = 1e-3) -> tuple[DataFrame, list[DataFrame]]:
    """Fill missing values by regressing each column on the others, in rounds, starting from the medians; see ``fit_imputers``.

    ``others`` are filled with the same sequence of coefficients. Tables with more than ``MAX_PATTERNS`` patterns of gaps take
    one aggregation for each column and round instead.
    """
    marked = train.withColumn("fold", F.lit(1))  # outside fold 0, so all of it trains
    imputers = fit_imputers(marked, columns, 1, rounds, tolerance, others)
    if imputers is None:
        return impute_by_scans(train, others, columns, rounds, tolerance)
    return imputers[0].transform(train), [imputers[0].transform(d) for d in others]


def impute_by_scans(train: DataFrame, others: list[DataFrame], columns: list[str], rounds: int = 10,
                    tolerance: float = 1e-3) -> tuple[DataFrame, list[DataFrame]]:
    """The same imputation with a pass for each column and round, for any number of patterns.

    Every regression is one aggregation (sums of products) over the training rows that have the column. The order is
    fewest missing first; a round ends early when no filled value moved more than the tolerance times the largest value.
    ``others`` are filled with the same sequence of coefficients.
    """
    stats = full_statistics(train, columns)
    order = [c for c in sorted(columns, key=lambda c: stats[c].n_rows - stats[c].n)
             if 0 < stats[c].n < stats[c].n_rows]
    top = train.agg(*[F.max(F.abs(F.col(c))).alias(c) for c in columns]).collect()[0]
    limit = tolerance * max((v for v in top if v is not None), default=0.0)
    top_of = top.asDict()

    def start(df: DataFrame) -> DataFrame:
        return fill_values(missing_indicators(df, columns), stats, "median")

    def updated(df: DataFrame, column: str, model: tuple[list[float], float]) -> DataFrame:
        rest = [c for c in columns if c != column]
        value = reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for w, c in zip(model[0], rest)], F.lit(model[1]))
        return df.withColumn(column, F.when(F.col(f"num_miss__{column}") == 1, value).otherwise(F.col(column)))

    current, filled = cut_lineage(start(train)), [start(d) for d in others]
    for _ in range(rounds if len(columns) > 1 else 0):
        before = current.select([F.col(c).alias(f"__old_{c}") for c in order] + ["*"]) if order else current
        moving = before
        for column in order:
            rest = [c for c in columns if c != column]
            centres = {c: (top_of[c] or 0.0) / 2 for c in columns}
            model = _least_squares(moving.where(F.col(f"num_miss__{column}") == 0), rest, column, centres)
            moving = updated(moving, column, model)
            filled = [updated(d, column, model) for d in filled]
        moving = cut_lineage(moving)
        filled = [cut_lineage(d) for d in filled]
        moved = moving.agg(*[F.max(F.abs(F.col(c) - F.col(f"__old_{c}"))).alias(c) for c in order]).collect()[0] \
            if order else [0.0]
        current = moving.drop(*[f"__old_{c}" for c in order])
        if max((v or 0.0) for v in moved) < limit:
            break
    flags = [f"num_miss__{c}" for c in columns]
    return current.drop(*flags), [d.drop(*flags) for d in filled]
