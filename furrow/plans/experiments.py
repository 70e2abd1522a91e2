"""Model experiments as DataFrame jobs: folds are a column, every fit is distributed, predictions are one long table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.cleaning import coerce_numeric, missing_band, missing_fraction, row_id, upper_label
from furrow.functions.order_stats import hash_positions
from furrow.operators import attribution, evaluation, folds
from furrow.operators.baselines import predict_env_mean, predict_mean, predict_means
from furrow.operators.features import (
    encoded_names, encoded_owners, fit_imputers, fold_statistics, full_statistics, iterative_impute, numeric_sql, preprocessor,
)
from furrow.operators.headers import require_columns
from furrow.operators.knn import knn_impute
from furrow.operators.moments import PatternImputer
from furrow.operators.models import SHARING, FittedModel, ModelSpec, fit_model, fit_models
from furrow.operators.ridge_folds import RidgeFolds, RidgeRun
from furrow.schema import CATEGORICAL, ENV, GROUP, KEYS, NUMERIC, TARGET
from furrow.session import counted_cut, cut_lineage


@dataclass(frozen=True)
class Roles:
    target: str = TARGET
    group: str = GROUP
    env: str = ENV
    keys: list[str] = field(default_factory=lambda: list(KEYS))
    numeric: list[str] = field(default_factory=lambda: list(NUMERIC))
    categorical: list[str] = field(default_factory=lambda: list(CATEGORICAL))


# The compared models, imputation strategies, thresholds and tuned parameters.
MODEL_SPECS = [
    ModelSpec("baseline_mean"), ModelSpec("baseline_env_mean"), ModelSpec("ridge", {"alpha": 1.0}),
    ModelSpec("rf", {"n_estimators": 500}), ModelSpec("knn", {"n_neighbors": 5}),
    ModelSpec("svr", {"C": 1.0}),
    ModelSpec("xgb", {"learning_rate": 0.03, "max_depth": 6, "subsample": 0.8}),
    ModelSpec("lgbm", {"learning_rate": 0.03, "max_depth": 6, "subsample": 0.8}),
]
IMPUTE_STRATEGIES = [("median", False), ("median", True), ("mean", False), ("knn", False), ("iterative", False)]
IMPUTE_MODELS = [m for m in MODEL_SPECS if m.name in ("ridge", "rf", "svr", "xgb")]
KNN_NEIGHBOURS = 15
ITERATIVE_ROUNDS = 10
THRESHOLDS = [i / 10 for i in range(1, 11)]
TUNED_BOOSTER = {"learning_rate": 0.05579378978522556, "max_depth": 4, "min_child_weight": 16.17686906786567,
                 "subsample": 0.7266044212478868, "gamma": 0.16930231325154688}
BOOSTER_BASELINE = {"learning_rate": 0.03, "max_depth": 6, "min_child_weight": 1.0, "subsample": 0.8, "gamma": 0.0}
KERNEL_BASELINE = {"C": 1.0, "huber_shape": 1.35, "gamma_mode": "scale"}
BOOSTER_SPACE = {
    "rounds": ("int", 20, 50), "learning_rate": ("log", 0.01, 0.3), "max_depth": ("int", 3, 10),
    "min_child_weight": ("log", 1.0, 20.0), "subsample": ("uniform", 0.5, 1.0), "gamma": ("uniform", 0.0, 10.0),
}
KERNEL_SPACE = {
    "C": ("log", 1e-2, 1e3), "huber_shape": ("uniform", 1.05, 3.0),
    "gamma_mode": ("choice", ["scale", "auto", "float"]),
    "gamma": ("when", "gamma_mode", "float", ("log", 1e-8, 1.0)),
}
SAMPLE_ROWS = 200


def prepare(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Prune and coerce the columns, derive the evaluation columns, give every row a number; written once."""
    used = [roles.target, roles.group, roles.env, *roles.keys, *roles.numeric, *roles.categorical]
    pinned = require_columns(df, used).select(F.inline(F.array(F.struct(*dict.fromkeys(used)))))  # else each use of a column repeats its expression
    df = coerce_numeric(pinned, [roles.target, *roles.numeric])
    texts = {c: F.col(c).cast("string") for c in {*roles.categorical, *roles.keys, roles.group, roles.env}}
    df = df.withColumns(texts)
    df = df.withColumns({
        "env_label": upper_label(F.col(roles.env)),
        "row_id": row_id(roles.keys) if roles.keys else F.monotonically_increasing_id().cast("string"),
        "missing_frac": missing_fraction(roles.numeric),
        "row_no": F.monotonically_increasing_id(),
    }).withColumn("missing_band", missing_band(F.col("missing_frac")))
    df = cut_lineage(df)
    if df.where(F.col(roles.target).isNotNull()).limit(1).count() == 0:
        raise ValueError(f"{roles.target} holds no number in any row")
    return df


def with_folds(prepared: DataFrame, k: int, roles: Roles = Roles()) -> DataFrame:
    return cut_lineage(folds.group_kfold(prepared.drop("fold"), roles.group, k))


def _predictions(df: DataFrame, model: str | Column, roles: Roles, *more: str) -> DataFrame:
    return df.select(
        (F.lit(model) if isinstance(model, str) else model).alias("model"), "fold", "row_id", F.col(roles.group).alias("name1"),
        F.col("env_label").alias("env_type"), F.col(roles.target).alias("y_true"),
        F.col("y_pred").cast("double").alias("y_pred"), F.col(roles.target).isNotNull().alias("y_observed"),
        F.col("missing_frac").alias("x_missing_frac"), "missing_band", *more)


@dataclass(frozen=True)
class Policy:
    """How one evaluation treats training rows and missing values."""

    threshold: float = 1.0
    impute: str | None = None
    indicators: bool | None = None
    native_missing: bool = False
    train_where: Column | None = None
    test_where: Column | None = None
    parallelism: int = 4
    rounds: int = ITERATIVE_ROUNDS


def out_of_fold(data: DataFrame, specs: list[ModelSpec], k: int, roles: Roles = Roles(),
                policy: Policy = Policy(), only: list[int] | None = None) -> DataFrame:
    """Predictions of every row by models trained on the other folds; ``data`` comes from ``with_folds``.

    ``only`` limits the learned models to some folds.
    """
    kept = (F.col("missing_frac") <= policy.threshold) & F.col(roles.target).isNotNull()
    if policy.train_where is not None:
        kept = kept & policy.train_where
    test_rows = data if policy.test_where is None else data.where(policy.test_where)
    parts = []
    for spec in specs:
        if spec.profile == "baseline":
            flagged = data.withColumn("kept", F.coalesce(kept, F.lit(False)))
            predicted = (predict_mean(flagged, k, roles.target) if spec.name == "baseline_mean"
                         else predict_env_mean(flagged, k, roles.target, "env_label"))
            if policy.test_where is not None:
                predicted = predicted.where(policy.test_where)
            parts.append(_predictions(predicted, spec.key, roles))
    summed = [s for s in specs if s.name == "ridge"] if ridge_run(policy) else []
    if summed:
        parts.append(_ridge_predictions(data.where(kept), test_rows if only is None else test_rows.where(F.col("fold").isin(only)), k, roles,
                                        [(s.key, ridge_run(policy, s)) for s in summed]).drop("run"))
    learned = [s for s in specs if s.profile != "baseline" and s not in summed]
    if learned:
        train_all = data.where(kept)
        stats = fold_statistics(train_all, roles.numeric, k)
        imputers = (fit_imputers(train_all, roles.numeric, k, policy.rounds, others=[test_rows]) if policy.impute == "iterative" else None) or {}

        def one_fold(fold: int) -> list[DataFrame]:
            test = test_rows.where(F.col("fold") == fold)
            if not any(s.n_rows for s in stats[fold].values()):
                return [_predictions(test.withColumn("y_pred", F.lit(None).cast("double")), s.key, roles)
                        for s in learned]
            return _fit_fold(train_all.where(F.col("fold") != fold), test, stats[fold], learned, roles, policy, imputers.get(fold))

        with ThreadPoolExecutor(max_workers=max(1, policy.parallelism)) as pool:
            run = inheritable_thread_target(data.sparkSession)(one_fold)
            for frames in pool.map(run, range(k) if only is None else only):
                parts += frames
    return evaluation.union_folds(parts)


def ridge_run(policy: Policy, spec: ModelSpec = ModelSpec("ridge")) -> RidgeRun | None:
    """The run of a ridge model whose imputation is one value a column; None for the other imputations."""
    if policy.native_missing or policy.impute not in (None, "median", "mean"):
        return None
    flags = True if policy.indicators is None else policy.indicators
    return RidgeRun(policy.threshold, float(spec.params.get("alpha", 1.0)), policy.impute or "median", flags)


def _ridge_predictions(train: DataFrame, test: DataFrame, k: int, roles: Roles, runs: list[tuple[str, RidgeRun]]) -> DataFrame:
    """Predictions of all runs in one plan; the models come from one table of sums."""
    fits = RidgeFolds(train, k, roles.target, roles.numeric, roles.categorical)
    scored = fits.predict(test, [run for _, run in runs])
    names = F.array(*[F.lit(name) for name, _ in runs])
    return _predictions(scored, names[F.col("run")], roles, "run")


def _fit_fold(train: DataFrame, test: DataFrame, stats: dict, specs: list[ModelSpec], roles: Roles,
              policy: Policy, imputer: PatternImputer | None = None) -> list[DataFrame]:
    impute = policy.impute
    if impute == "knn":
        train, test = (knn_impute(train, train, roles.numeric, KNN_NEIGHBOURS, "row_no", "row_no"),
                       knn_impute(train, test, roles.numeric, KNN_NEIGHBOURS, "row_no", "row_no"))
    elif imputer is not None:
        train, test = imputer.transform(train), imputer.transform(test)
    elif impute == "iterative":
        train, (test,) = iterative_impute(train, [test], roles.numeric, policy.rounds)
    if impute in ("knn", "iterative"):
        train = cut_lineage(train)
        stats, impute = full_statistics(train, roles.numeric), "median"
    frames = []
    for profile in dict.fromkeys(s.profile for s in specs):
        used = "native_missing" if policy.native_missing else profile
        stages = preprocessor(used, roles.numeric, roles.categorical, stats, impute, policy.indicators).fit(train)
        columns = ["row_no", "features", F.col(roles.target).alias("label")]
        encoded = cut_lineage(stages.transform(train).select(*columns))
        own = [s for s in specs if s.profile == profile]
        models, scored = fit_models(own, encoded), stages.transform(test)
        if len(own) > 1 and all(s.name in SHARING for s in own):  # the test rows are encoded and read once for all
            for i, model in enumerate(models):
                scored = model.predict(scored).withColumnRenamed("y_pred", f"__y{i}")
            named = [F.struct(F.lit(s.key).alias("__model"), F.col(f"__y{i}").alias("y_pred")) for i, s in enumerate(own)]
            frames.append(_predictions(scored.select(*test.columns, F.inline(F.array(*named))), F.col("__model"), roles))
        else:
            frames += [_predictions(model.predict(scored), s.key, roles) for s, model in zip(own, models)]
    return frames


def evaluate(predictions: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Metrics and group rank correlations by (by..., fold, subset)."""
    keys = [*(by or ["model"]), "fold"]
    return evaluation.subset_metrics(predictions, keys), evaluation.group_spearman(predictions, keys)


def model_selection(df: DataFrame, specs: list[ModelSpec] = MODEL_SPECS, k: int = 5, roles: Roles = Roles(),
                    policy: Policy = Policy()) -> dict[str, DataFrame]:
    """Predictions, fold metrics, summary and ranking of all models on the same folds."""
    data = with_folds(prepare(df, roles), k, roles)
    predictions = cut_lineage(out_of_fold(data, specs, k, roles, policy))
    metrics, ranks = evaluate(predictions)
    summary = evaluation.summarise(metrics, ["model"], ranks)
    return {"predictions": predictions, "fold_metrics": metrics, "group_spearman": ranks, "summary": summary,
            "bookkeeping": evaluation.fold_bookkeeping(data, roles.target, "missing_frac", policy.threshold),
            "ranking": evaluation.rank_models(summary)}


def threshold_sweep(df: DataFrame, specs: list[ModelSpec], thresholds: list[float] = THRESHOLDS, k: int = 5,
                    roles: Roles = Roles(), strategy: str = "avg_models_rmse", policy: Policy = Policy()) -> dict[str, DataFrame]:
    """Every model under every training-missingness threshold, and the threshold to use. All thresholds of ridge take one scan."""
    data = with_folds(prepare(df, roles), k, roles)
    ridge = [s for s in specs if s.name == "ridge"]
    ridge = ridge if ridge_run(policy) else []
    means = [s for s in specs if s.profile == "baseline"]
    others = [s for s in specs if s not in ridge and s not in means]
    parts = [out_of_fold(data, others, k, roles, replace(policy, threshold=t)).withColumn("threshold", F.lit(float(t)))
             for t in thresholds if others]
    if means:  # one table of means for all thresholds
        runs = [(s.key, float(t), s.name == "baseline_env_mean") for s in means for t in thresholds]
        scored = predict_means(data, k, roles.target, "env_label", "missing_frac", runs, policy.train_where)
        scored = scored if policy.test_where is None else scored.where(policy.test_where)
        parts.append(_predictions(scored, F.col("model"), roles, "threshold"))
    if ridge:  # one table of sums for all thresholds
        runs = [(s.key, float(t), ridge_run(replace(policy, threshold=t), s)) for s in ridge for t in thresholds]
        scored = _ridge_predictions(data.where(F.col(roles.target).isNotNull()), data, k, roles, [(name, run) for name, _, run in runs])
        parts.append(scored.withColumn("threshold", F.array(*[F.lit(t) for _, t, _ in runs])[F.col("run")]).drop("run"))
    metrics = evaluation.subset_metrics(evaluation.union_folds(parts), ["model", "threshold", "fold"])
    results = evaluation.summarise(metrics, ["model", "threshold"]).orderBy("model", "threshold")
    summary = evaluation.threshold_summary(results).orderBy("threshold")
    return {"results": results, "summary": summary, "selected": evaluation.select_threshold(summary, strategy)}


def imputation_comparison(df: DataFrame, specs: list[ModelSpec] = IMPUTE_MODELS,
                          strategies: list[tuple[str, bool]] = IMPUTE_STRATEGIES, k: int = 5, roles: Roles = Roles(),
                          native_reference: ModelSpec | None = MODEL_SPECS[6],
                          rounds: int = ITERATIVE_ROUNDS) -> DataFrame:
    """RMSE and group rank correlation per model and imputation strategy, best first."""
    data = with_folds(prepare(df, roles), k, roles)
    parts = []
    for strategy, indicators in strategies:
        label = strategy + ("+indicator" if indicators else "")
        policy = Policy(impute=strategy, indicators=indicators, rounds=rounds)
        parts.append(out_of_fold(data, specs, k, roles, policy).withColumn("strategy", F.lit(label)))
    if native_reference is not None:
        policy = Policy(native_missing=True, indicators=False)
        parts.append(out_of_fold(data, [native_reference], k, roles, policy)
                     .withColumn("strategy", F.lit("native_nan")))
    scored = evaluation.union_folds(parts).select("model", "strategy", "fold", "name1", "env_type", "missing_band", "y_true", "y_pred")
    metrics, ranks = evaluate(cut_lineage(scored), ["model", "strategy"])
    summary = evaluation.summarise(metrics, ["model", "strategy"], ranks)
    return summary.orderBy(F.asc_nulls_last("rmse_all_mean"), F.desc_nulls_last("spearman_variety_all_mean"))


def sample_params(space: dict[str, tuple], rng: np.random.Generator) -> dict[str, Any]:
    """One draw; a ``when`` entry is drawn only if another choice has the given value."""
    def draw(rule: tuple) -> Any:
        if rule[0] == "int":
            return int(rng.integers(rule[1], rule[2] + 1))
        if rule[0] == "log":
            return float(np.exp(rng.uniform(np.log(rule[1]), np.log(rule[2]))))
        if rule[0] == "uniform":
            return float(rng.uniform(rule[1], rule[2]))
        if rule[0] == "choice":
            return rule[1][int(rng.integers(len(rule[1])))]
        raise ValueError(f"Unknown rule: {rule[0]}")

    params: dict[str, Any] = {}
    for name, rule in space.items():
        if rule[0] != "when":
            params[name] = draw(rule)
        elif params.get(rule[1]) == rule[2]:
            params[name] = draw(rule[3])
    return params


def model_params(params: dict[str, Any]) -> dict[str, Any]:
    """Search parameters in the form a model takes them: the gamma mode becomes its gamma."""
    params = dict(params)
    mode = params.pop("gamma_mode", None)
    if mode in ("scale", "auto"):
        params["gamma"] = mode
    return params


def parameter_search(data: DataFrame, model: str, space: dict[str, tuple], n_trials: int, k: int, seed: int,
                     roles: Roles = Roles(), policy: Policy = Policy(), first: dict[str, Any] | None = None,
                     fixed: dict[str, Any] | None = None) -> tuple[dict[str, Any], list[tuple[int, float, dict]]]:
    """Seeded random search for the lowest mean fold RMSE; a trial without a usable fold counts as infinite."""
    rng = np.random.default_rng(seed)
    draws = ([dict(first)] if first else []) + [sample_params(space, rng) for _ in range(n_trials)]
    specs = [ModelSpec(model, {**(fixed or {}), **model_params(params)}, str(i)) for i, params in enumerate(draws[:n_trials])]
    if model == "ridge" and ridge_run(policy) and policy.train_where is None and policy.test_where is None:
        # all trials from one table of sums
        kept = data.where((F.col("missing_frac") <= policy.threshold) & F.col(roles.target).isNotNull())
        scored = _ridge_predictions(kept, data, k, roles, [(str(i), ridge_run(policy, s)) for i, s in enumerate(specs)])
    else:  # all trials on the same training rows, which are prepared once
        scored = out_of_fold(data, specs, k, roles, policy)
    errors = evaluation.subset_metrics(scored, ["model", "fold"], ["all"]).groupBy("model").agg(F.avg("rmse").alias("v"))
    found = {int(r["model"]): r["v"] for r in errors.collect()}
    trials = [(i, float("inf") if found.get(i) is None else found[i], params) for i, params in enumerate(draws[:n_trials])]
    return min(trials, key=lambda t: t[1])[2], trials


def trials_frame(spark: SparkSession, trials: list[tuple[int, float, dict]]) -> DataFrame:
    rows = [(n, v, {key: str(x) for key, x in p.items()}) for n, v, p in trials]
    return spark.createDataFrame(rows, "trial int, rmse double, params map<string,string>")


def nested_tuning(df: DataFrame, model: str, space: dict[str, tuple], n_trials: int = 20, outer: int = 5,
                  inner: int = 3, roles: Roles = Roles(), seed: int = 42, first: dict[str, Any] | None = None,
                  fixed: dict[str, Any] | None = None) -> dict[str, DataFrame]:
    """Tune on inner folds of every outer training set, refit, score the outer fold."""
    prepared = prepare(df, roles)
    data = with_folds(prepared, outer, roles)
    inner_map = cut_lineage(folds.nested_folds(prepared, roles.group, outer, inner))
    parts, best = [], []
    for held_out in range(outer):
        mapping = inner_map.where(F.col("held_out") == held_out).select(
            F.col("group").alias("__group"), F.col("inner_fold").alias("fold"))
        training = (data.where(F.col("fold") != held_out).drop("fold")
                    .withColumn("__group", folds.group_label(roles.group)).join(mapping, "__group").drop("__group"))
        params, trials = parameter_search(cut_lineage(training), model, space, n_trials, inner, seed + held_out + 1,
                                          roles, Policy(), first, fixed)
        best.append((held_out, min(t[1] for t in trials), {key: str(v) for key, v in params.items()}))
        two = data.withColumn("fold", F.when(F.col("fold") == held_out, 0).otherwise(1))
        spec = ModelSpec(model, {**(fixed or {}), **model_params(params)})
        parts.append(out_of_fold(two, [spec], 2, roles, only=[0]).withColumn("fold", F.lit(held_out)))
    metrics = evaluation.subset_metrics(evaluation.union_folds(parts), ["model", "fold"],
                                        ["all", "ne", "med"])
    params = df.sparkSession.createDataFrame(best, "outer_fold int, inner_rmse double, params map<string,string>")
    return {"fold_metrics": metrics, "best_params": params}


def environment_transfer(df: DataFrame, spec: ModelSpec, k: int = 5, roles: Roles = Roles()) -> DataFrame:
    """Global, within-environment and cross-environment errors; transfer scores varieties never trained on."""
    prepared = prepare(df, roles)
    env = F.col("env_label")
    plans = [("A_global_cv1", None, None, None)]
    plans += [(f"B_{e.lower()}_only_cv1", (e,), None, None) for e in ("NE", "MED")]
    plans += [(f"C_transfer_{a.lower()}_to_{b.lower()}_unseen", ("NE", "MED"), env == a, env == b)
              for a, b in (("NE", "MED"), ("MED", "NE"))]
    parts, made = [], {}  # both transfers take the folds of the same rows
    for name, envs, train_where, test_where in plans:
        if envs not in made:
            made[envs] = with_folds(prepared if envs is None else prepared.where(env.isin(*envs)), k, roles)
        data = made[envs]
        if train_where is not None:
            folds.assert_folds_apart(data, roles.group, train_where, test_where, k)
        policy = Policy(train_where=train_where, test_where=test_where)
        parts.append(out_of_fold(data, [spec], k, roles, policy).withColumn("run", F.lit(name)))
    metrics = evaluation.subset_metrics(evaluation.union_folds(parts), ["run", "fold"],
                                        ["all", "ne", "med"])
    return evaluation.summarise(metrics, ["run"], subsets=["all", "ne", "med"]).orderBy("run")


@dataclass(frozen=True)
class TrainedModel:
    stages: Any
    model: FittedModel
    slots: list[str]
    training: DataFrame


def fit_all(df: DataFrame, spec: ModelSpec, roles: Roles = Roles(), threshold: float = 1.0) -> TrainedModel:
    """Fit on all eligible rows."""
    rows = df.where((F.col("missing_frac") <= threshold) & F.col(roles.target).isNotNull())
    if rows.limit(1).count() == 0:
        raise ValueError(f"no row has a target and at most {threshold} of its numbers missing")
    stats = full_statistics(rows, roles.numeric)
    stages = preprocessor(spec.profile, roles.numeric, roles.categorical, stats).fit(rows)
    encoded = cut_lineage(stages.transform(rows).select(*rows.columns, "features", F.col(roles.target).alias("label")))  # read by every pass of the fit
    model = fit_model(spec, encoded.select("row_no", "features", "label"))
    _, names = numeric_sql(roles.numeric, stats, "none", "standard", True)
    return TrainedModel(stages, model, encoded_names(stages, names, roles.categorical), encoded)


def production_training(df: DataFrame, n_trials: int = 40, k: int = 5, roles: Roles = Roles(), seed: int = 42,
                        model: str = "xgb", space: dict[str, tuple] = BOOSTER_SPACE,
                        first: dict[str, Any] | None = None, fixed: dict[str, Any] | None = None,
                        folder: str | None = None) -> dict[str, Any]:
    """Search, cross-validated metrics of the best parameters, refit on all eligible rows, persist."""
    from furrow.sources.tables import save_model

    data = with_folds(prepare(df, roles), k, roles)
    params, trials = parameter_search(data, model, space, n_trials, k, seed, roles, Policy(),
                                      first if first is not None else BOOSTER_BASELINE, fixed)
    spec = ModelSpec(model, {**(fixed or {}), **model_params(params)})
    metrics = evaluation.subset_metrics(out_of_fold(data, [spec], k, roles), ["model", "fold"],
                                        ["all", "ne", "med"])
    trained = fit_all(data, spec, roles)
    if folder:
        save_model(trained, roles, folder, n_trials, SAMPLE_ROWS)
    return {"best_params": params, "trials": trials_frame(df.sparkSession, trials),
            "summary": evaluation.summarise(metrics, ["model"], subsets=["all", "ne", "med"]), "trained": trained}


def linear_contributions(trained: TrainedModel) -> DataFrame:
    """(row_id, env_type, encoded, value): coefficient times the distance from the slot's mean, exact for a linear model."""
    weights = [float(w) for w in trained.model.native.coefficients]
    array = vector_to_array("features")
    slots = range(len(weights))
    means = trained.training.agg(*[F.avg(array[i]).alias(f"m{i}") for i in slots]).collect()[0]
    items = F.array(*[F.struct(F.lit(trained.slots[i]).alias("encoded"),
                               (F.lit(weights[i]) * (F.col("__x")[i] - F.lit(means[i]))).alias("value")) for i in slots])
    return (trained.training.withColumn("__x", array)
            .select("row_no", F.col("env_label").alias("env_type"), F.inline(items)))


def permuted_contributions(trained: TrainedModel, roles: Roles = Roles(), seed: int = 7) -> DataFrame:
    """(row_no, env_type, encoded, value): change of a row's prediction when one feature comes from a random other row.

    Rows are paired by their positions in two hash orders, so the pairing is a permutation made by a join of row numbers. Every slot
    of the encoded vector stems from one feature, so a row is encoded once and a copy takes the feature's slots from the other row.
    One pass scores a copy of each row for each feature, under a row number of its own.
    """
    features = [*roles.numeric, *roles.categorical]
    owners = encoded_owners(trained.stages, roles.numeric, roles.categorical)
    rows, n_rows = counted_cut(trained.training.select("row_no", "env_label", vector_to_array("features").alias("__x")))
    mine, other = (hash_positions(rows.select("row_no"), "row_no", salt, n_rows) for salt in (seed, seed + 1))
    pairs = mine.join(other.withColumnRenamed("row_no", "__other"), "position").drop("position")
    others = pairs.join(rows.select(F.col("row_no").alias("__other"), F.col("__x").alias("__other_x")), "__other").drop("__other")
    paired = rows.join(others, "row_no").withColumn("features", array_to_vector("__x"))
    base = cut_lineage(trained.model.predict(paired).select("row_no", "env_label", "__x", "__other_x", F.col("y_pred").alias("__base")))
    copies = base.select("*", F.posexplode(F.array(*[F.lit(c) for c in features])).alias("__copy", "encoded"))
    slots = [F.when(F.col("encoded") == c, F.col("__other_x")[i]).otherwise(F.col("__x")[i]) for i, c in enumerate(owners)]
    swapped = copies.select((F.col("row_no") * len(features) + F.col("__copy")).alias("row_no"), "env_label", "encoded", "__base",
                            F.col("row_no").alias("__row"), array_to_vector(F.array(*slots)).alias("features"))
    return trained.model.predict(swapped).select(F.col("__row").alias("row_no"), F.col("env_label").alias("env_type"), "encoded",
                                                 (F.col("y_pred") - F.col("__base")).alias("value"))


def feature_attribution(df: DataFrame, spec: ModelSpec = ModelSpec("xgb", TUNED_BOOSTER), roles: Roles = Roles()) -> dict[str, DataFrame]:
    """Importance overall and per environment, the side-by-side table and the rank agreement."""
    trained = fit_all(prepare(df, roles), spec, roles)
    linear = hasattr(trained.model.native, "coefficients") and spec.name == "ridge"
    contributions = linear_contributions(trained) if linear else permuted_contributions(trained, roles)
    table = cut_lineage(attribution.importance(contributions, [*roles.numeric, *roles.categorical]))
    return {"contributions": contributions, "importance": table, "comparison": attribution.compare_environments(table),
            "agreement": attribution.rank_agreement(table)}


