import pytest
from pyspark.sql import functions as F

from furrow.functions.cleaning import classify, missing_band, normalise_missing, within
from furrow.functions.names import clean_name, clean_name_column
from furrow.operators.enrich import location_env_type, with_environment, with_value_rules
from furrow.operators.headers import require_columns, standardise_header
from furrow.operators.validate import validate
from furrow.schema import SCORES, SOIL_TYPE_RULES, TRIAL_TYPE_RULES, drop_columns

NAMES = {" Yield  >=80 (t/ha) ": "yield_gte80_t_ha", "75-80 #": "col_75_80_hash", "%": "percent", "": "col", "__": "col",
         "Name1": "name1", "75-80%": "col_75_80percent", "75 80%": "col_75_80percent"}


def test_clean_name_in_schema_and_in_data(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "raw string").select("raw", clean_name_column(F.col("raw")).alias("c"))
    assert {r["raw"]: r["c"] for r in rows.collect()} == NAMES
    assert {n: clean_name(n) for n in NAMES} == NAMES


def test_duplicate_header_is_refused(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int").toDF("75-80%", "75 80%")
    with pytest.raises(ValueError, match="Duplicate column names after standardisation"):
        standardise_header(df)


def test_header_report(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("Name 1", "Block", "o_a_score")
    out = standardise_header(df, drop_columns(), {"name_1": "name1"})
    assert out.data.columns == ["name1", "o_a_score"]
    assert out.renamed == {"Name 1": "name1", "Block": "block"} and out.dropped == ["block"]
    assert len(set(drop_columns())) == 244


def test_required_columns(spark):
    with pytest.raises(ValueError, match="yield"):
        require_columns(spark.range(1), ["id", "yield"])


def test_missing_values(spark):
    rows = spark.createDataFrame([("",), ("  ",), (" x ",), ("7",), ("-9",), ("-0.5",), ("nan",), ("5d",), ("\t y ",),
                                  ("-inf",), ("-1_000",)], "v string")
    assert [r["v"] for r in normalise_missing(rows).collect()] == [None, None, "x", "7", None, None, "nan", "5d", "y", None, None]
    typed = spark.createDataFrame([(-3, 4, 2024, True, -0.5, float("nan"))], "a int, b int, year int, c boolean, d double, e double")
    row = normalise_missing(typed).collect()[0]
    assert (row["a"], row["b"], row["year"], row["c"], row["d"], row["e"]) == (None, 4.0, 2024, True, None, None)


GOOD = {"experiment_name": "E", "location": "L", "name1": "N", "plot": 1, "year": 2020, "source_file": "f", "source_row": 2,
        "o_a_score": "5"}


@pytest.mark.parametrize("change, message", [
    ({"experiment_name": " "}, "experiment_name: Input should be a valid string, (None)"),
    ({"location": " "}, "location: Input should be a valid string, (None)"),
    ({"name1": " "}, "name1: Input should be a valid string, (None)"),
    ({"plot": 0}, "plot: Input should be greater than 0, (0)"),
    ({"year": None}, "year: Input should be a valid integer, (None)"),
    ({"year": -1}, "year: Input should be a valid integer, (None)"),
])
def test_rejects(spark, change, message):
    schema = ("experiment_name string, location string, name1 string, plot long, year long, source_file string, "
              "source_row long, o_a_score string")
    data = {**GOOD, **change}
    df = spark.createDataFrame([tuple(data.values()), tuple(GOOD.values())], schema)
    out = validate(df)
    assert out.valid.count() == 1
    assert [r["error_message"] for r in out.rejects.collect()] == [message]


def test_numeric_name_is_rejected_and_negative_score_is_missing(spark):
    schema = "experiment_name string, location string, name1 {}, plot long, year long, source_file string, source_row long, o_a_score string"
    numeric = spark.createDataFrame([("E", "L", 7.0, 1, 2020, "f", 2, "5")], schema.format("double"))
    assert validate(numeric).valid.count() == 0
    negative = spark.createDataFrame([("E", "L", "N", 1, 2020, "f", 2, "-9")], schema.format("string"))
    assert validate(negative).valid.collect()[0]["o_a_score"] is None


def test_missing_required_column(spark):
    df = spark.createDataFrame([("E", "L", 1, 2020, "f", 2)],
                               "experiment_name string, location string, plot long, year long, source_file string, source_row long")
    assert validate(df).rejects.collect()[0]["error_message"] == "name1: Field required, (None)"


def test_value_rules(spark):
    rows = spark.createDataFrame([(-1.0,), (0.0,), (9.0,), (9.1,), (None,)], "v double")
    assert [r[0] for r in rows.select(within(F.col("v"), 0, 9)).collect()] == [None, 0.0, 9.0, None, None]
    texts = spark.createDataFrame([("Ware process clay",), ("HARDWARE",), ("seed",), (None,), ("Clay sand",), ("Sandy",)], "t string")
    assert [r[0] for r in texts.select(classify(F.col("t"), TRIAL_TYPE_RULES)).collect()] == [
        "PROCESS", "WARE", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert [r[0] for r in texts.select(classify(F.col("t"), SOIL_TYPE_RULES)).collect()] == [
        "CLAY", "UNKNOWN", "UNKNOWN", "UNKNOWN", "CLAY", "SAND"]
    pairs = [(300.0, 40.0), (None, 40.0), (0.0, 40.0), (250.0, None), (None, None)]
    df = spark.createDataFrame([(a, b, "x", *[None] * len(SCORES)) for a, b in pairs],
                               "finalyield double, yield_total_t_ha double, experiment_name string, "
                               + ", ".join(f"{c} double" for c in SCORES))
    assert [r["yield"] for r in with_value_rules(df).collect()] == [None, 40.0, 0.0, 250.0, None]


def test_lookup_join_normalises_the_location(spark):
    df = spark.createDataFrame([(" oak PARK ",), ("Mars",)], "location string")
    found = {r["location"]: r["env_type"] for r in with_environment(df, location_env_type(spark)).collect()}
    assert found == {" oak PARK ": "NE", "Mars": "UNKNOWN"}
    assert location_env_type(spark).groupBy("env_type").count().orderBy("env_type").collect()[0]["count"] == 16


def test_missing_band(spark):
    rows = spark.createDataFrame([(0.0,), (0.01,), (0.5,), (0.51,), (1.0,)], "f double")
    assert [r[0] for r in rows.select(missing_band(F.col("f"))).collect()] == [
        "complete", "medium", "medium", "incomplete", "incomplete"]
