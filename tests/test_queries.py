"""Registered queries against DuckDB. All of them with FURROW_ALL=1, a cross-section otherwise."""

import os

import pytest

from tests.compare import compare, connect

import __spark_entry__ as contract

SOME = ["E11_mart_end_to_end", "V1_missing_values_text", "V2_valid_rows", "V3_reject_messages", "S2_scan_csv_with_line_breaks", "S4_lookalike_names",
        "S5_archive_clash", "S7_scd2_merge", "S7_value_returns", "S8_schema_contract", "S8_type_conflict", "S9_schema_changes",
        "S15_materialised_table", "C8_utc_text_and_suffix", "A16_iqr_outliers", "A17_correlation_matrix", "A24_metrics_by_subset",
        "M2_nested_folds", "M6_two_columns_one_round", "M9_profile_features", "M12_baseline_env_mean", "M13_ridge_closed_form",
        "S18_model_persistence", "J6_nearest_neighbours", "A33_variance_components_loc_year"]
NAMES = list(contract.queries()) if os.environ.get("FURROW_ALL") else SOME


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf_dir, name):
    good, note = compare(spark, con, sf_dir, contract.queries()[name], contract.oracle_sql().get(name))
    assert good, note


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
