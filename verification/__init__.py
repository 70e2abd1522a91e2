"""Registered queries on the driver tables and, where SQL can say it, the equivalent DuckDB text."""

from verification.registry import ORACLES, QUERIES  # noqa: F401
from verification import (  # noqa: F401  (registration)
    evaluation_queries, experiment_queries, ingest_queries, mart_queries, model_queries, profile_queries,
)
