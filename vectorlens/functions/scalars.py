"""Small scalar expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the literal shown for missing metadata and left out of agreement metrics.
MISSING = "N/A"


def basename(path: Column) -> Column:
    """Text after the last slash."""
    return F.regexp_extract(path, "[^/]*$", 0)


def category(column: Column) -> Column:
    """Metadata value as a category: text, with null shown as ``N/A``."""
    return F.coalesce(column.cast("string"), F.lit(MISSING))


def nan_to_null(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column)
    return column


def fixed(number: Column, digits: int) -> Column:
    """Number with a fixed count of decimals, rounded half-even on its binary value, without grouping."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", number.cast("double"), F.lit(pattern))
