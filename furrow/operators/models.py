"""Model families by name, as Spark ML estimators on a ``features`` vector."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.operators.kernel import FourierFeatures, KernelTask, fit_kernels
from furrow.operators.knn import knn_regress
from furrow.operators.trees import Boosting, Rules, TreeEnsemble, fit_boostings, fit_forest
from furrow.session import cut_lineage

SEED = 42


@dataclass(frozen=True)
class ModelSpec:
    name: str
    params: dict[str, Any] = field(default_factory=dict)
    label: str | None = None

    @property
    def key(self) -> str:
        return self.label or self.name

    @property
    def profile(self) -> str:
        if self.name not in PROFILE_OF:
            raise ValueError(f"Unknown model name: {self.name}")
        return PROFILE_OF[self.name]


# Preprocessing profile of each model family.
PROFILE_OF = {"baseline_mean": "baseline", "baseline_env_mean": "baseline", "ridge": "linear", "rf": "tree",
              "knn": "linear", "svr": "linear", "xgb": "booster", "lgbm": "booster"}


def _boosting(params: dict[str, Any]) -> Boosting:
    """Boosted trees; the round count is the caller's, trees follow one another, so keep it moderate."""
    rules = Rules(int(params.get("max_depth", 6)), max(1, int(params.get("min_child_weight", 1))), share=str(params.get("column_share", "all")),
                  seed=int(params.get("seed", SEED)))
    return Boosting(int(params.get("rounds", 50)), float(params.get("learning_rate", 0.1)), float(params.get("subsample", 0.8)), rules,
                    float(params.get("gamma", 0.0)))


@dataclass
class FittedModel:
    """``predict(df)`` adds y_pred to a frame with row_id and features."""

    predict: Any
    native: Any = None


SHARING = {"xgb": "boosted", "lgbm": "boosted", "svr": "kernel"}  # families whose fits on the same rows share their passes


def fit_models(specs: list[ModelSpec], train: DataFrame) -> list[FittedModel]:
    """``fit_model`` of each; those of a family that can share their passes over the rows are fitted together."""
    out: list[FittedModel | None] = [None] * len(specs)
    for family in dict.fromkeys(SHARING.get(s.name) for s in specs):
        own = [i for i, s in enumerate(specs) if SHARING.get(s.name) == family]
        if family == "boosted":
            fits = [_trees(m) for m in fit_boostings(train, [_boosting(specs[i].params) for i in own])]
        elif family == "kernel":
            fits = _kernel_models(train, [specs[i].params for i in own])
        else:
            fits = [fit_model(specs[i], train) for i in own]
        for i, fit in zip(own, fits):
            out[i] = fit
    return out


def fit_model(spec: ModelSpec, train: DataFrame) -> FittedModel:
    """Fit on a frame with row_id, label and features."""
    p = dict(spec.params)
    if spec.name == "ridge":
        return _spark_model(_ridge(train, float(p.get("alpha", 1.0))), train)
    if spec.name == "rf":
        return _trees(fit_forest(train, int(p.get("n_estimators", 500)), Rules(int(p.get("max_depth", 15)), seed=int(p.get("seed", SEED)))))
    if spec.name in SHARING:
        return fit_models([spec], train)[0]
    if spec.name == "knn":
        points = train.withColumn("vector", vector_to_array("features"))
        k = int(p.get("n_neighbors", 5))

        def predict(df: DataFrame) -> DataFrame:
            near = knn_regress(points, df.withColumn("vector", vector_to_array("features")), k, "label",
                               "row_no", "row_no")
            return df.join(near.withColumnRenamed("query_id", "row_no"), "row_no", "left")

        return FittedModel(predict)
    raise ValueError(f"Unknown model name: {spec.name}")


def _trees(model: TreeEnsemble) -> FittedModel:
    return FittedModel(model.transform, model)


def _spark_model(estimator, train: DataFrame) -> FittedModel:
    model = estimator.setPredictionCol("y_pred").fit(train)
    return FittedModel(model.transform, model)


def _ridge(train: DataFrame, alpha: float) -> LinearRegression:
    """Penalty alpha on raw coefficients: the solver works on a label scaled to unit std, hence the factor."""
    row = train.agg(F.stddev_pop("label").alias("s"), F.count("*").alias("n")).collect()[0]
    return LinearRegression(labelCol="label", featuresCol="features", elasticNetParam=0.0, standardization=False,
                            solver="normal", regParam=alpha * (row["s"] or 0.0) / max(row["n"], 1))


def _kernel_models(train: DataFrame, wanted: list[dict[str, Any]]) -> list[FittedModel]:
    """RBF-kernel regressions through random Fourier features and a robust linear fit, see ``kernel``.

    The projection is drawn from the seed. ``huber_shape`` (above 1) is where the loss turns from squared to linear, in units of the
    estimated scale; it is not the width of an insensitive tube. ``max_iter`` bounds the passes of the fit, which ends at the minimum.
    """
    shape = train.agg(Summarizer.mean(F.col("features")).alias("m"),
                      Summarizer.variance(F.col("features")).alias("v")).collect()[0]
    mean, var = shape["m"].toArray(), shape["v"].toArray()
    width = len(mean)
    tasks = []
    for p in wanted:
        gamma = p.get("gamma", "scale")
        if gamma == "scale":
            total = float((var + mean ** 2).mean() - mean.mean() ** 2)
            gamma = 1.0 / (width * total) if total > 0 else 1.0
        elif gamma == "auto":
            gamma = 1.0 / width
        features = FourierFeatures.drawn(width, float(gamma), int(p.get("n_components", 128)), int(p.get("seed", SEED)))
        tasks.append(KernelTask(features, float(p.get("huber_shape", 1.35)), 1.0 / float(p.get("C", 1.0)), int(p.get("max_iter", 50))))
    rows = cut_lineage(train.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label")))  # read by every pass
    return [FittedModel(lambda df, fit=fit: df.withColumn("y_pred", fit.predict(vector_to_array("features"))), fit) for fit in fit_kernels(rows, tasks)]
