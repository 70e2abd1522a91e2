"""One pass over swapped copies against a pass for each feature, and against the exact contributions of a linear model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions.order_stats import hash_positions
from furrow.operators.attribution import original_feature
from furrow.operators.models import ModelSpec
from furrow.plans import experiments as ex
from furrow.session import cut_lineage

ROLES = ex.Roles("y", "name1", "env_label", [], ["a", "b"], ["e"])


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    out = []
    for k in range(120):
        a, b = float(rng.normal(10, 2)), float(rng.normal(-5, 4))
        out.append((k - 40, "NE" if k % 3 else "MED", a, None if k % 7 == 0 else b, [None, "p", "q"][k % 3], 2 * a - b + k % 3, 0.0))
    return spark.createDataFrame(out, "row_no long, env_label string, a double, b double, e string, y double, missing_frac double").cache()


def table(found):
    return {(r["row_no"], r["encoded"]): r["value"] for r in found.collect()}


def test_linear_contributions_say_the_same(rows):
    trained = ex.fit_all(rows, ModelSpec("ridge", {"alpha": 1.0}), ROLES)
    got = table(ex.permuted_contributions(trained, ROLES))
    assert len(got) == 120 * 3
    exact = {}
    named = ex.linear_contributions(trained).withColumn("feature", original_feature(F.col("encoded"), ["a", "b", "e"]))
    for r in named.collect():
        exact[r["row_no"], r["feature"]] = exact.get((r["row_no"], r["feature"]), 0.0) + r["value"]
    ids = [r["row_no"] for r in rows.select("row_no").collect()]
    partner = {i: min(ids, key=lambda j: abs(exact[j, "a"] - exact[i, "a"] - got[i, "a"])) for i in ids}
    assert sorted(partner.values()) == sorted(ids)  # a permutation, the same for all features
    for c in "abe":
        assert [got[i, c] for i in ids] == pytest.approx([exact[partner[i], c] - exact[i, c] for i in ids], abs=1e-8)


@pytest.mark.parametrize("spec", [ModelSpec("knn", {"n_neighbors": 3}), ModelSpec("rf", {"n_estimators": 5, "max_depth": 3})])
def test_one_pass_is_a_pass_for_each_feature(rows, spec):
    trained = ex.fit_all(rows, spec, ROLES)
    whole = table(ex.permuted_contributions(trained, ROLES))
    line = ex.permuted_contributions(ex.fit_all(rows, ModelSpec("ridge", {"alpha": 1.0}), ROLES), ROLES)  # same pairing, whatever the model
    assert set(table(line)) == set(whole)
    plain = {r["row_no"]: r["y_pred"] for r in trained.model.predict(trained.stages.transform(
        rows.select("row_no", "env_label", "a", "b", "e"))).select("row_no", "y_pred").collect()}
    values = {r["row_no"]: r.asDict() for r in rows.collect()}
    trained_line = ex.fit_all(rows, ModelSpec("ridge", {"alpha": 1.0}), ROLES)
    of_a = ex.linear_contributions(trained_line).where(original_feature(F.col("encoded"), ["a", "b", "e"]) == "a")
    slope = {r["row_no"]: r["value"] for r in of_a.groupBy("row_no").agg(F.sum("value").alias("value")).collect()}
    moved = table(line)
    partner = {i: min(slope, key=lambda j, i=i: abs(slope[j] - slope[i] - moved[i, "a"])) for i in slope}
    for c in "abe":
        swapped = rows.sparkSession.createDataFrame(
            [tuple(values[partner[i] if f == c else i][f] if f != "row_no" else i for f in ("row_no", "env_label", "a", "b", "e")) for i in sorted(values)],
            "row_no long, env_label string, a double, b double, e string")
        after = {r["row_no"]: r["y_pred"] for r in trained.model.predict(trained.stages.transform(swapped)).select("row_no", "y_pred").collect()}
        assert [whole[i, c] for i in sorted(values)] == pytest.approx([after[i] - plain[i] for i in sorted(values)], abs=1e-9)


def test_hash_positions_are_the_order_of_the_hashes(spark):
    keys = spark.range(5000).select((F.col("id") * 7 - 900).alias("row_no"))
    hashes = keys.select("row_no", F.xxhash64("row_no", F.lit(7)).cast("double").alias("h")).collect()
    expected = {r["row_no"]: i for i, r in enumerate(sorted(hashes, key=lambda r: (r["h"], r["row_no"])))}
    for n_rows in (5000, 3_000_000):  # the number of ranges changes nothing
        assert {r["row_no"]: r["position"] for r in hash_positions(keys, "row_no", 7, n_rows).collect()} == expected


def test_rows_are_encoded_once(rows):
    """The stages ran over every copy before."""
    trained = ex.fit_all(rows, ModelSpec("rf", {"n_estimators": 2, "max_depth": 2}), ROLES)
    encoded = ex.TrainedModel(trained.stages, trained.model, trained.slots, cut_lineage(trained.training))
    calls = []
    encoded.stages.transform = calls.append
    assert len(table(ex.permuted_contributions(encoded, ROLES))) == 120 * 3
    assert not calls
