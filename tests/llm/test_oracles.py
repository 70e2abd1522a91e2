"""Queries that SQL can express, against DuckDB."""

import pytest

from furrow.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    good, note = compare(spark, connect(sf_dir), sf_dir, QUERIES[name], ORACLES[name])
    assert good, note
