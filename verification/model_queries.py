"""Baselines, imputation, scaling, encoding, neighbours and model families."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from furrow import fixtures
from furrow.operators import baselines, features, folds, knn
from furrow.operators.models import ModelSpec, fit_model
from furrow.operators.profile import with_missing_band
from furrow.schema import CATEGORICAL, NUMERIC
from furrow.session import cut_lineage
from verification.evaluation_queries import fold_ctes
from verification.registry import assemble, known, mart, query

BASE = {**fold_ctes("banded", 5), "b": "SELECT *, f <= 0.5 AND o_a_score IS NOT NULL AS kept FROM folded",
        "held": "SELECT CAST(unnest(range(5)) AS INT) AS held_out",
        "gmean": "SELECT held_out, avg(o_a_score) AS m FROM b JOIN held ON fold <> held_out WHERE kept GROUP BY held_out",
        "emean": "SELECT held_out, env_type AS e, avg(o_a_score) AS m FROM b JOIN held ON fold <> held_out WHERE kept GROUP BY ALL"}


def folded(spark, sf_dir):
    rows = folds.group_kfold(with_missing_band(known(spark, sf_dir)), "name1", 5)
    return cut_lineage(rows.withColumn("kept", (F.col("missing_frac") <= 0.5) & F.col("o_a_score").isNotNull()))


@query("M11_baseline_mean",
       assemble("SELECT plot, fold, m AS y_pred FROM b JOIN gmean ON fold = held_out", ["banded"], ["y_pred"], BASE, True))
def baseline_mean(spark, sf_dir):
    return baselines.predict_mean(folded(spark, sf_dir), 5, "o_a_score").select("plot", "fold", "y_pred")


@query("M12_baseline_env_mean",
       assemble("SELECT plot, fold, coalesce(e.m, g.m) AS y_pred FROM b JOIN gmean g ON fold = g.held_out LEFT JOIN emean e "
                "ON fold = e.held_out AND env_type = e.e", ["banded"], ["y_pred"], BASE, True))
def baseline_env_mean(spark, sf_dir):
    return baselines.predict_env_mean(folded(spark, sf_dir), 5, "o_a_score").select("plot", "fold", "y_pred")


@query("J4_group_mean_with_fallback",
       assemble("SELECT held_out AS fold, e AS env_type, m AS mean FROM emean", ["banded"], ["mean"], BASE, True))
def group_means(spark, sf_dir):
    return baselines.training_means(folded(spark, sf_dir), 5, "o_a_score", ["env_type"])


def _held_out(aggregate: str) -> str:
    return " UNION ALL ".join(f"SELECT held_out, '{c}' AS \"column\", {aggregate.format(c=c)} AS v FROM b JOIN held ON fold <> held_out "
                              f"GROUP BY held_out" for c in NUMERIC)


@query("M3_training_medians",
       assemble(f"SELECT held_out, \"column\", v AS median FROM ({_held_out('quantile_cont({c}, 0.5)')})", ["banded"], ["median"], BASE, True))
def training_medians(spark, sf_dir):
    return features.training_medians(folded(spark, sf_dir), NUMERIC, 5).select("held_out", "column", "median")


for _strategy, _aggregate in (("median", "quantile_cont({c}, 0.5)"), ("mean", "avg({c})")):
    @query(f"M3_{_strategy}_imputation",
           assemble("SELECT plot, " + ", ".join(f"coalesce(b.{c}, s.{c}) AS {c}" for c in NUMERIC) + " FROM b JOIN s ON b.fold = s.held_out",
                    ["banded"], NUMERIC,
                    {**BASE, "s": "SELECT held_out, " + ", ".join(f"{_aggregate.format(c=c)} AS {c}" for c in NUMERIC)
                                  + " FROM b JOIN held ON fold <> held_out GROUP BY held_out"}, True))
    def imputation(spark, sf_dir, strategy=_strategy):
        return features.held_out_imputation(folded(spark, sf_dir), NUMERIC, 5, strategy).select("plot", *NUMERIC)


@query("M4_missing_indicators",
       assemble("SELECT plot, " + ", ".join(f"CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END AS num_miss__{c}" for c in NUMERIC)
                + " FROM known", ["known"], [f"num_miss__{c}" for c in NUMERIC]))
def indicators(spark, sf_dir):
    return features.missing_indicators(known(spark, sf_dir), NUMERIC).select("plot", *[f"num_miss__{c}" for c in NUMERIC])


@query("M7_standard_scaling",
       assemble("SELECT plot, " + ", ".join(f"(b.{c} - s.m_{c}) / nullif(s.d_{c}, 0) AS {c}" for c in NUMERIC)
                + " FROM b JOIN s ON b.fold = s.held_out", ["banded"], NUMERIC,
                {**BASE, "s": "SELECT held_out, " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in NUMERIC)
                              + " FROM b JOIN held ON fold <> held_out GROUP BY held_out"}, True))
def scaling(spark, sf_dir):
    return features.held_out_scaling(folded(spark, sf_dir), NUMERIC, 5).select("plot", *NUMERIC)


@query("M8_one_hot_unknown_ignored",
       assemble("SELECT plot, trial_type, CASE WHEN trial_type = 'PROCESS' THEN 1.0::DOUBLE ELSE 0 END AS slot_process, "
                "CASE WHEN trial_type = 'UNKNOWN' THEN 1.0::DOUBLE ELSE 0 END AS slot_unknown FROM mart", ["mart"],
                ["slot_process", "slot_unknown"]))
def one_hot(spark, sf_dir):
    """Fitted without WARE rows, so WARE is unknown and its slots stay empty."""
    rows = mart(spark, sf_dir).select("plot", "trial_type")
    fitted = features.preprocessor("linear", [], ["trial_type"], {}).fit(rows.where("trial_type <> 'WARE'"))
    slots = vector_to_array("features")
    return fitted.transform(rows).select("plot", "trial_type", slots[0].alias("slot_process"), slots[1].alias("slot_unknown"))


def _cells(text: str, joiner: str = ", ") -> str:
    return joiner.join(text.format(c=c) for c in NUMERIC)


_FEATURE_CTES = {
    "md": f"SELECT {_cells('quantile_cont({c}, 0.5) AS {c}')} FROM mart",
    "imp": f"SELECT m.plot, m.year, {_cells('coalesce(m.{c}, md.{c}) AS {c}')}, {_cells('(m.{c} IS NULL)::INT', ' + ')} AS gaps FROM mart m, md",
    "sc": f"SELECT {_cells('avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}')} FROM imp",
    "raw": f"SELECT {_cells('avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}')} FROM mart",
    "wide": "SELECT CAST(22 + count(DISTINCT env_type) + count(DISTINCT trial_type) + count(DISTINCT soil_type) AS INT) AS width FROM mart",
}
_FILLED = f"SELECT plot, '{{0}}' AS profile, width, {_cells('(i.{c} - m_{c}) / d_{c}', ' + ')} + gaps + 3 AS total FROM imp i, sc, wide"
_OPEN = (f"SELECT plot, 'booster' AS profile, width, {_cells('coalesce((m.{c} - m_{c}) / d_{c}, -1e6)', ' + ')} + "
         f"{_cells('(m.{c} IS NULL)::INT', ' + ')} + 3 AS total FROM mart m, raw, wide")


@query("M9_profile_features", assemble(f"{_FILLED.format('linear')} UNION ALL {_FILLED.format('tree')} UNION ALL {_OPEN}", ["mart"], ["total"], _FEATURE_CTES))
def profile_features(spark, sf_dir):
    """Vector width and sum per profile over the whole mart, which every pass below reads as written once."""
    rows = cut_lineage(mart(spark, sf_dir))
    stats = features.full_statistics(rows, NUMERIC)
    parts = []
    for profile in ("linear", "tree", "booster"):
        fitted = features.preprocessor(profile, NUMERIC, CATEGORICAL, stats).fit(rows)
        array = vector_to_array("features")
        parts.append(fitted.transform(rows).select("plot", F.lit(profile).alias("profile"), F.size(array).alias("width"),
                                                   F.aggregate(array, F.lit(0.0), lambda a, x: a + x).alias("total")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("M10_native_missing_features",
       assemble(f"SELECT plot, CAST({_cells('({c} IS NULL)::INT', ' + ')} AS INT) AS n_sentinel FROM mart", ["mart"]))
def native_missing(spark, sf_dir):
    rows = cut_lineage(mart(spark, sf_dir))
    fitted = features.preprocessor("native_missing", NUMERIC, CATEGORICAL, features.full_statistics(rows, NUMERIC)).fit(rows)
    array = vector_to_array("features")
    return fitted.transform(rows).select("plot", F.size(F.filter(array, lambda v: v == features.SENTINEL)).alias("n_sentinel"))


# ---- neighbours on the embedding vectors

PAIRS = ("SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance, "
         "b.label FROM embeddings a, embeddings b")
RANKED = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM ({PAIRS})"


@query("J6_nearest_neighbours",
       assemble(f"SELECT query_id, neighbour_id, CAST(rank AS INT) AS rank, distance FROM ({RANKED}) WHERE rank <= 15", [], ["distance"]))
def nearest_neighbours(spark, sf_dir):
    points = fixtures.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return knn.knn_join(points, points, 15)


@query("M15_knn_regression",
       assemble(f"SELECT query_id, avg(label) AS y_pred FROM ({RANKED}) WHERE rank <= 5 GROUP BY query_id", [], ["y_pred"]))
def knn_regression(spark, sf_dir):
    points = fixtures.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return knn.knn_regress(points, points, 5, "label")


WIDTH = 64
_CELLS = {"lng": f"SELECT vec_id, j, CASE WHEN (vec_id + j) % 7 <> 0 THEN embedding[j + 1]::DOUBLE END AS v FROM embeddings, "
                 f"(SELECT unnest(range({WIDTH})) AS j)",
          "pr": f"SELECT a.vec_id AS q, b.vec_id AS d, sqrt(sum((a.v - b.v) * (a.v - b.v)) * {WIDTH} / count(*)) AS dist FROM lng a "
                "JOIN lng b ON a.j = b.j AND a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL",
          "fl": "SELECT q, j, avg(v) AS v FROM (SELECT m.vec_id AS q, m.j, x.v, row_number() OVER (PARTITION BY m.vec_id, m.j "
                "ORDER BY dist, d) AS rn FROM lng m JOIN pr ON pr.q = m.vec_id JOIN lng x ON x.vec_id = pr.d AND x.j = m.j "
                "WHERE m.v IS NULL AND x.v IS NOT NULL) WHERE rn <= 15 GROUP BY q, j"}


@query("M5_knn_imputation",
       assemble("SELECT lng.vec_id, " + ", ".join(f"max(coalesce(lng.v, fl.v)) FILTER (WHERE lng.j = {j}) AS x{j}" for j in range(WIDTH))
                + " FROM lng LEFT JOIN fl ON fl.q = lng.vec_id AND fl.j = lng.j GROUP BY lng.vec_id", [],
                [f"x{j}" for j in range(WIDTH)], _CELLS))
def knn_imputation(spark, sf_dir):
    columns = [f"x{j}" for j in range(WIDTH)]
    rows = fixtures.table(spark, sf_dir, "embeddings").select("vec_id", *[
        F.when((F.col("vec_id") + j) % 7 != 0, F.col("embedding")[j].cast("double")).alias(c) for j, c in enumerate(columns)])
    return knn.knn_impute(rows, rows, columns, 15, "vec_id", "vec_id")


@query("M6_two_columns_one_round",
       assemble("SELECT plot, coalesce(appearance, i1 + s1 * t0) AS appearance, coalesce(tubersize, i2 + s2 * a1) AS tubersize FROM a, r2", ["mart"],
                ["appearance", "tubersize"],
                {"md": "SELECT quantile_cont(tubersize, 0.5) AS mt FROM mart",
                 "t": "SELECT plot, appearance, tubersize, coalesce(tubersize, mt) AS t0 FROM mart, md",
                 "r1": "SELECT regr_slope(appearance, t0) AS s1, regr_intercept(appearance, t0) AS i1 FROM t",
                 "a": "SELECT *, coalesce(appearance, i1 + s1 * t0) AS a1 FROM t, r1",
                 "r2": "SELECT regr_slope(tubersize, a1) AS s2, regr_intercept(tubersize, a1) AS i2 FROM a"}))
def two_columns_one_round(spark, sf_dir):
    rows = mart(spark, sf_dir).select("plot", "appearance", "tubersize")
    return features.iterative_impute(rows, [], ["appearance", "tubersize"], rounds=1)[0]


@query("M6_two_columns_two_rounds",
       assemble("SELECT plot, coalesce(appearance, i3 + s3 * t1) AS appearance, coalesce(tubersize, i4 + s4 * a2) AS tubersize FROM a2, r4", ["mart"],
                ["appearance", "tubersize"],
                {"md": "SELECT quantile_cont(tubersize, 0.5) AS mt FROM mart",
                 "t": "SELECT plot, appearance, tubersize, coalesce(tubersize, mt) AS t0 FROM mart, md",
                 "r1": "SELECT regr_slope(appearance, t0) AS s1, regr_intercept(appearance, t0) AS i1 FROM t",
                 "a": "SELECT *, coalesce(appearance, i1 + s1 * t0) AS a1 FROM t, r1",
                 "r2": "SELECT regr_slope(tubersize, a1) AS s2, regr_intercept(tubersize, a1) AS i2 FROM a",
                 "t1": "SELECT *, coalesce(tubersize, i2 + s2 * a1) AS t1 FROM a, r2",
                 "r3": "SELECT regr_slope(appearance, t1) AS s3, regr_intercept(appearance, t1) AS i3 FROM t1",
                 "a2": "SELECT *, coalesce(appearance, i3 + s3 * t1) AS a2 FROM t1, r3",
                 "r4": "SELECT regr_slope(tubersize, a2) AS s4, regr_intercept(tubersize, a2) AS i4 FROM a2"}))
def two_columns_two_rounds(spark, sf_dir):
    rows = mart(spark, sf_dir).select("plot", "appearance", "tubersize")
    return features.iterative_impute(rows, [], ["appearance", "tubersize"], rounds=2, tolerance=0.0)[0]


@query("M6_iterative_imputation",
       assemble(f"SELECT count(*) AS n_rows, {_cells('count({c})', ' + ')} AS n_given, TRUE AS all_filled FROM mart", ["mart"]))
def iterative_imputation(spark, sf_dir):
    """All columns, all rounds: given values stay, every gap is filled."""
    rows = mart(spark, sf_dir).select("plot", "year", *NUMERIC)
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    filled = features.iterative_impute(rows.select("row", *NUMERIC), [], NUMERIC)[0]
    both = rows.select("row", *[F.col(c).alias(f"old_{c}") for c in NUMERIC]).join(filled, "row")
    kept = reduce(lambda a, b: a + b, [F.count_if(F.col(c) == F.col(f"old_{c}")) for c in NUMERIC])
    gaps = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in NUMERIC])
    return both.agg(F.count("*").alias("n_rows"), kept.alias("n_given"), (gaps == 0).alias("all_filled"))


# ---- model families: fitted on the whole mart, error on the same rows

def _fit_error(spark, sf_dir, spec: ModelSpec):
    rows = cut_lineage(mart(spark, sf_dir).withColumn("row_no", F.monotonically_increasing_id()))  # read by every pass of the fit
    stats = features.full_statistics(rows, NUMERIC)
    fitted = features.preprocessor(spec.profile, NUMERIC, CATEGORICAL, stats).fit(rows)
    encoded = fitted.transform(rows).select("row_no", "plot", F.col("o_a_score").alias("label"), "features")
    return fit_model(spec, encoded).predict(encoded).select("plot", F.col("label").alias("y_true"), "y_pred")


def fit_summary(predictions):
    """One row that any seed gives: all rows scored, and the error below that of the constant predictor."""
    error = F.avg(F.pow(F.col("y_pred") - F.col("y_true"), F.lit(2)))
    return predictions.agg(F.count("*").alias("n_rows"), F.count("y_pred").alias("n_scored"),
                           (error < F.var_pop("y_true")).alias("beats_constant"))


FIT_SQL = assemble("SELECT count(*) AS n_rows, count(*) AS n_scored, TRUE AS beats_constant FROM mart", ["mart"])
FAMILIES = {
    "M13_ridge_regression": ModelSpec("ridge", {"alpha": 1.0}),
    "M14_random_forest": ModelSpec("rf", {"n_estimators": 100}),
    "M16_kernel_regression": ModelSpec("svr", {"C": 1.0}),
    "M17_boosted_trees": ModelSpec("xgb", {"learning_rate": 0.3}),
}
for _name, _spec in FAMILIES.items():
    @query(_name, FIT_SQL)
    def family(spark, sf_dir, spec=_spec):
        return fit_summary(_fit_error(spark, sf_dir, spec))


@query("M13_ridge_closed_form",
       assemble("SELECT plot, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS y_pred FROM t, mm, bb", ["mart"], ["y_pred"],
                {"t": "SELECT plot, appearance AS x1, tubersize AS x2, o_a_score AS y FROM mart WHERE appearance IS NOT NULL AND tubersize IS NOT NULL",
                 "mm": "SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM t",
                 "ss": "SELECT sum((x1 - m1) * (x1 - m1)) + 5 AS s11, sum((x2 - m2) * (x2 - m2)) + 5 AS s22, sum((x1 - m1) * (x2 - m2)) AS s12, "
                       "sum((x1 - m1) * (y - my)) AS c1, sum((x2 - m2) * (y - my)) AS c2 FROM t, mm",
                 "bb": "SELECT (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) AS b1, (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM ss"}))
def ridge_closed_form(spark, sf_dir):
    """Two features and a penalty of 5, solved by Cramer's rule in SQL."""
    rows = mart(spark, sf_dir).where("appearance IS NOT NULL AND tubersize IS NOT NULL").withColumn("row_no", F.monotonically_increasing_id())
    data = rows.select("plot", "row_no", array_to_vector(F.array("appearance", "tubersize")).alias("features"), F.col("o_a_score").alias("label"))
    return fit_model(ModelSpec("ridge", {"alpha": 5.0}), data).predict(data).select("plot", "y_pred")
