"""The fit by passes against MLlib's robust regression of the lifted rows, and what a fit costs."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from furrow.operators.kernel import FourierFeatures, fit_kernel
from furrow.operators.models import ModelSpec, fit_model


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (900, 4))
    y = 5 + np.sin(x[:, 0]) * 2 + x[:, 1] + rng.normal(0, 0.3, 900)
    y[::17] += 40  # far off
    return spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "row_no long, x array<double>, label double").cache()


@pytest.mark.parametrize(("shape", "penalty"), [(1.35, 1.0), (1.05, 0.01), (3.0, 100.0)])
def test_reaches_the_minimum_of_the_robust_loss(rows, shape, penalty):
    features = FourierFeatures.drawn(4, 0.2, 24, 42)
    fit = fit_kernel(rows, features, shape, penalty, 50)
    data = rows.collect()
    z = features.lift(np.array([r["x"] for r in data]))
    lifted = rows.sparkSession.createDataFrame([(v.tolist(), r["label"]) for v, r in zip(z, data)], "z array<double>, label double")
    mllib = LinearRegression(labelCol="label", featuresCol="z", loss="huber", epsilon=shape, regParam=penalty / len(data), standardization=False,
                             maxIter=300, tol=1e-12).fit(lifted.withColumn("z", array_to_vector("z")))
    assert fit.scale == pytest.approx(mllib.scale, rel=1e-4)
    assert z @ fit.coefficients + fit.intercept == pytest.approx(z @ mllib.coefficients.toArray() + mllib.intercept, abs=1e-3)
    assert fit.passes < 20


def test_a_fit_runs_few_jobs_and_predicts_every_row(spark, rows):
    data = rows.select("row_no", "label", array_to_vector("x").alias("features"))
    spark.sparkContext.setJobGroup("kernel-fit", "kernel-fit")
    model = fit_model(ModelSpec("svr", {"C": 1.0}), data)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("kernel-fit"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 40  # one for each of some 50 iterations before
    found = {r["row_no"]: r["y_pred"] for r in model.predict(data).select("row_no", "y_pred").collect()}
    z = model.native.features.lift(np.array([r["x"] for r in rows.orderBy("row_no").collect()]))
    assert [found[i] for i in range(900)] == pytest.approx((z @ model.native.coefficients + model.native.intercept).tolist())


def test_constant_labels_and_empty_partitions(spark):
    rows = spark.range(50).repartition(64).select(F.array(F.col("id").cast("double")).alias("x"), F.lit(3.0).alias("label"))
    fit = fit_kernel(rows, FourierFeatures.drawn(1, 0.5, 8, 1), 1.35, 1.0, 50)
    assert [r["p"] for r in rows.select(fit.predict(F.col("x")).alias("p")).collect()] == pytest.approx([3.0] * 50, abs=1e-5)
