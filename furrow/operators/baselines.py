"""Mean predictors, evaluated for all folds at once: training sums are the total minus the fold's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.session import cut_lineage


def _held_out(own: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Means over all folds but one, from sums (fold, by..., s, n)."""
    spread = own.select(*by, "s", "n", F.col("fold").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    return (spread.where("own <> fold").groupBy("fold", *by)
            .agg((F.sum("s") / F.nullif(F.sum("n").cast("double"), F.lit(0.0))).alias("mean")))


def training_sums(df: DataFrame, target: str, by: list[str]) -> DataFrame:
    return df.where("kept").groupBy("fold", *by).agg(F.sum(target).alias("s"), F.count(target).alias("n"))


def training_means(df: DataFrame, k: int, target: str, by: list[str]) -> DataFrame:
    """(fold, by..., mean) of the kept training rows outside each fold; ``df`` has fold, kept, target.

    The rows are summed once per (fold, by); the k-fold expansion happens on those sums.
    """
    return _held_out(training_sums(df, target, by), k, by)


def predict_mean(df: DataFrame, k: int, target: str, fold: str = "fold") -> DataFrame:
    """Prediction = mean of the training target."""
    means = training_means(df, k, target, []).withColumnRenamed("mean", "y_pred")
    return df.join(F.broadcast(means), fold, "left")  # at most k rows


def predict_env_mean(df: DataFrame, k: int, target: str, env: str = "env_type") -> DataFrame:
    """Prediction = training mean of the row's environment, the global mean for an unseen environment."""
    sums = cut_lineage(training_sums(df, target, [env]))  # a row for each fold and environment; both means come from it
    overall = _held_out(sums, k, []).withColumnRenamed("mean", "__overall")
    by_env = (_held_out(sums, k, [env])
              .select("fold", F.col(env).alias("__env"), F.col("mean").alias("__env_mean")))
    return (df.join(F.broadcast(overall), "fold", "left")  # at most k rows
            .join(by_env, (df["fold"] == by_env["fold"]) & df[env].eqNullSafe(F.col("__env")), "left")
            .drop(by_env["fold"])
            .withColumn("y_pred", F.coalesce("__env_mean", "__overall"))
            .drop("__env", "__env_mean", "__overall"))


def predict_means(df: DataFrame, k: int, target: str, env: str, missing_frac: str, runs: list[tuple[str, float, bool]],
                  train_where: Column | None = None) -> DataFrame:
    """Each row once for each run (model, threshold, by environment or not): the mean of ``predict_mean`` or ``predict_env_mean``.

    A run trains on the rows with at most ``threshold`` of the features missing. One pass sums the target by fold, environment and
    missing share; the means of all runs follow from those sums.
    """
    label = F.col(target) if train_where is None else F.when(train_where, F.col(target))
    cells = cut_lineage(df.groupBy("fold", env, missing_frac).agg(F.sum(label).alias("s"), F.count(label).alias("n")))
    thresholds = df.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(t for _, t, _ in runs)], "threshold double")
    wanted = df.sparkSession.createDataFrame(runs, "model string, threshold double, __by_env boolean")
    sums = (cells.join(F.broadcast(thresholds), F.col(missing_frac) <= F.col("threshold"))
            .groupBy("threshold", "fold", env).agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    overall = _held_out(sums, k, ["threshold"]).withColumnRenamed("mean", "__overall")
    by_env = _held_out(sums, k, ["threshold", env]).select(
        F.col("fold").alias("__fold"), F.col("threshold").alias("__threshold"), F.col(env).alias("__env"), F.col("mean").alias("__env_mean"))
    met = (F.col("fold") == F.col("__fold")) & (F.col("threshold") == F.col("__threshold")) & F.col(env).eqNullSafe(F.col("__env"))
    means = (cells.select("fold", env).distinct().join(F.broadcast(wanted), F.lit(True))
             .join(overall, ["fold", "threshold"], "left").join(by_env, met, "left"))
    table = cut_lineage(means.select(
        F.col("fold").alias("__fold"), F.col(env).alias("__env"), "model", "threshold",
        F.when(F.col("__by_env"), F.coalesce("__env_mean", "__overall")).otherwise(F.col("__overall")).alias("y_pred")))
    return df.join(table, (df["fold"] == table["__fold"]) & df[env].eqNullSafe(table["__env"])).drop("__fold", "__env")
