"""Column expressions for cleaning, labelling and coercing values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.schema import MEDIUM_MAX_MISSING, UNKNOWN

# Plain decimal notation, digits may be grouped by single underscores.
DIGITS = r"\d+(_\d+)*"
NUMBER = rf"^[+-]?({DIGITS}\.?({DIGITS})?|\.{DIGITS})([eE][+-]?{DIGITS})?$"


# The characters that count as white space.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
               "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    """Trim every kind of white space, tabs and no-break spaces included."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def text_to_double(text: Column) -> Column:
    """Number held in text, NULL when the text is no number (never raises)."""
    bare = strip(text)
    return F.when(bare.rlike(NUMBER), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))


def lenient_double(name: str, dtype: T.DataType) -> Column:
    """Lenient coercion of a column of any type; NaN and bad text become NULL."""
    column = F.col(f"`{name}`")
    if isinstance(dtype, T.StringType):
        return text_to_double(column)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column.cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return column.cast("double")
    return F.lit(None).cast("double")


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace the listed columns by their lenient double form."""
    return df.withColumns({c: lenient_double(c, df.schema[c].dataType) for c in columns})


def normalise_missing(df: DataFrame) -> DataFrame:
    """One missing-value policy for all columns: blank, NaN and negative become NULL, whole numbers become double."""
    return df.select(*[normalised_value(f).alias(f.name) for f in df.schema.fields])


def normalised_value(field: T.StructField, whole_number_cols: tuple[str, ...] = ("year", "plot")) -> Column:
    """The policy for one column; text stays text, year and plot stay whole."""
    column, dtype = F.col(f"`{field.name}`"), field.dataType
    if isinstance(dtype, T.StringType):
        bare = strip(column)
        # Only text with a minus sign pays for the number test.
        negative = bare.startswith("-") & ((text_to_double(column) < 0) | F.lower(bare).isin("-inf", "-infinity"))
        return F.when((bare != "") & ~F.coalesce(negative, F.lit(False)), bare)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column) & (column >= 0), column.cast("double"))
    if isinstance(dtype, T.NumericType):
        kept = F.when(column >= 0, column)
        return kept.cast("long") if field.name in whole_number_cols else kept.cast("double")
    return column


def within(value: Column, low: float, high: float) -> Column:
    """Value if low <= value <= high, else NULL."""
    return F.when((value >= low) & (value <= high), value)


def classify(text: Column, rules: list[tuple[str, str]], default: str = UNKNOWN) -> Column:
    """Label of the first keyword the text contains, ignoring case."""
    lowered = F.lower(text)
    chain = reduce(lambda acc, rule: acc.when(lowered.contains(rule[0]), rule[1]), rules, F)
    return chain.otherwise(default)


def lookup_key(text: Column) -> Column:
    return F.lower(F.trim(text))


def upper_label(column: Column) -> Column:
    return F.upper(strip(column.cast("string")))


def row_id(keys: list[str], separator: str = "|") -> Column:
    """Composite id; a missing key part is spelled <NA>."""
    return F.concat_ws(separator, *[F.coalesce(F.col(k).cast("string"), F.lit("<NA>")) for k in keys])


def missing_count(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns], F.lit(0))


def missing_fraction(columns: list[str]) -> Column:
    """Share of missing values among the columns, 0 when there are none."""
    return missing_count(columns) / F.lit(float(max(len(columns), 1)))


def missing_band(fraction: Column, medium_max: float = MEDIUM_MAX_MISSING) -> Column:
    return (F.when(fraction == 0, "complete")
            .when(fraction <= medium_max, "medium")
            .when(fraction > medium_max, "incomplete"))


def environment_id(*parts: str) -> Column:
    return F.concat_ws("_", *[F.col(p).cast("string") for p in parts])
