"""The large tables are read, and dealt, as often as needed and no more; the rows are those of the SQL texts."""

import pytest
from pyspark.sql import functions as F

from furrow import fixtures
from furrow.sources import tables
from verification import QUERIES
from verification.registry import known, mart

SF = "/root/testdata/sf0.001"


def _plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain(mode="formatted")
    return capsys.readouterr().out


def _same(left, right):
    assert left.dtypes == right.dtypes
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_trials_and_history_are_the_rows_of_their_sql(spark):
    trials = spark.sql(fixtures.TRIALS, **{t: fixtures.table(spark, SF, t) for t in ("lineitem", "orders", "customer", "nation")})
    _same(fixtures.trials(spark, SF), trials)
    expected = spark.sql(fixtures.HISTORY, trials=trials)
    found = fixtures.history(spark, SF).select(*expected.columns)
    _same(found, expected)
    assert fixtures.history(spark, SF).columns == expected.columns


def test_mart_reads_and_deals_lineitem_once(spark, capsys):
    wide = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = mart(spark, SF)
        plan = _plan(rows, capsys)
        assert plan.count("lineitem.parquet") == 1
        # between the scan of lineitem and its join with the orders lies one exchange, and none follows for customer and nation
        assert plan.count("l_orderkey") and "hashpartitioning(o_custkey" in plan
        carrying = [p for p in plan.split("\n\n") if "Exchange" in p.split("\n")[0] and "l_orderkey" in p and "Broadcast" not in p]
        assert len([p for p in carrying if "hashpartitioning(l_orderkey" in p]) == 1
        assert not any("hashpartitioning(o_custkey" in p for p in carrying)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", wide)


@pytest.mark.parametrize("name", ["M9_profile_features", "M10_native_missing_features", "M13_ridge_regression"])
def test_fits_read_the_mart_as_written_once(spark, capsys, name):
    found = QUERIES[name](spark, SF)
    assert "lineitem.parquet" not in _plan(found, capsys)
    assert found.agg(F.count("*")).first()[0] > 0


def test_child_runs_read_the_trials_once(spark, capsys, monkeypatch):
    written, write = [], tables.write_result

    def seen(result, *where, **how):
        written.append(_plan(result, capsys))
        return write(result, *where, **how)

    monkeypatch.setattr(tables, "write_result", seen)
    found = {r["run"]: r["n"] for r in QUERIES["S17_child_runs"](spark, SF).collect()}
    assert len(written) == 6 and not any("lineitem.parquet" in p for p in written)
    assert sum(found.values()) == known(spark, SF).count()
