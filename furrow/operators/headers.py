"""Header projections: standardise, alias, drop and check column names."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.names import clean_name, clean_name_column


@dataclass(frozen=True)
class StandardisedFrame:
    data: DataFrame
    renamed: dict[str, str]
    dropped: list[str]


def standardise_header(df: DataFrame, drop: list[str] | None = None,
                       aliases: dict[str, str] | None = None) -> StandardisedFrame:
    """Clean and alias all names, refuse clashes, drop the listed columns that are present."""
    aliases, unwanted = aliases or {}, set(drop or [])
    names = [aliases.get(n, n) for n in map(clean_name, df.columns)]
    repeated = [name for name, times in Counter(names).items() if times > 1]
    if repeated:
        raise ValueError(f"Duplicate column names after standardisation: {repeated}")
    renamed = {old: new for old, new in zip(df.columns, names) if old != new}
    dropped = [n for n in names if n in unwanted]
    return StandardisedFrame(df.toDF(*names).drop(*dropped), renamed, dropped)


def standardised_names(names: DataFrame, raw: str) -> DataFrame:
    """The cleaning rule for names held as rows."""
    return names.withColumn("clean", clean_name_column(F.col(raw)))


def duplicate_names(names: DataFrame, raw: str) -> DataFrame:
    """Cleaned names that occur more than once, with their count."""
    return (names.groupBy(clean_name_column(F.col(raw)).alias("clean"))
            .agg(F.count("*").alias("n")).where("n > 1"))


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Keep exactly the required columns, in name order; an error names the missing ones."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Dataset missing required columns: {missing}")
    return df.select(*sorted(set(required)))


def as_text(df: DataFrame) -> list[Column]:
    """All columns of the frame as strings."""
    return [F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]
