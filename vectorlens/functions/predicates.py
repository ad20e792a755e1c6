"""Compile a filter dictionary into one Column predicate."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Filters = dict[str, Any]


def in_list(column: Column, values: Iterable[Any]) -> Column:
    """Membership in which a listed ``None`` matches null rows."""
    values = list(values)
    present = [v for v in values if v is not None]
    wanted = column.isin(present) if present else F.lit(False)
    return (wanted | column.isNull()) if len(present) < len(values) else wanted


def in_range(column: Column, dtype: T.DataType, low: Any = None, high: Any = None) -> Column | None:
    """Inclusive bounds, each optional. NaN lies outside every range, although Spark sorts it last."""
    parts = []
    if low is not None:
        parts.append(column >= F.lit(low))
    if high is not None:
        parts.append(column <= F.lit(high))
    if not parts:
        return None
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        parts.append(~F.isnan(column))
    return reduce(and_, parts)


def contains_text(column: Column, dtype: T.DataType, text: str) -> Column:
    """Case-insensitive literal substring."""
    if not isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        raise TypeError(f"text search needs a string column, got {dtype.simpleString()}")
    return F.lower(column).contains(text.lower())


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def column_predicates(df: DataFrame, filters: Filters) -> dict[str, Column]:
    """One predicate per effective filter.

    A dict is a range, a list is membership, a string is a text search. Unknown columns, ``None``, empty
    lists, blank strings, empty ranges and other value types have no effect.
    """
    types = {field.name: field.dataType for field in df.schema.fields}
    out: dict[str, Column] = {}
    for name, wanted in filters.items():
        if name not in types or wanted is None:
            continue
        column, dtype = quoted(name), types[name]
        if isinstance(wanted, dict):
            predicate = in_range(column, dtype, wanted.get("min"), wanted.get("max"))
            if predicate is not None:
                out[name] = predicate
        elif isinstance(wanted, list):
            if wanted:
                out[name] = in_list(column, wanted)
        elif isinstance(wanted, str):
            if wanted.strip():
                out[name] = contains_text(column, dtype, wanted)
    return out


def conjunction(predicates: Iterable[Column]) -> Column | None:
    predicates = list(predicates)
    return reduce(and_, predicates) if predicates else None


def apply_filters(df: DataFrame, filters: Filters) -> DataFrame:
    """Rows for which every effective filter is true; with none, the table unchanged."""
    predicate = conjunction(column_predicates(df, filters).values())
    return df if predicate is None else df.filter(predicate)


def apply_membership_filters(df: DataFrame, filters: Filters) -> DataFrame:
    """Batch-load variant: ``column IN values`` only, and an unknown column is an error.

    Keys starting with ``_`` are comments of the job file; empty lists are skipped.
    """
    wanted = {k: v for k, v in filters.items() if not k.startswith("_") and v}
    unknown = [name for name in wanted if name not in df.columns]
    if unknown:
        raise ValueError(f"filter columns not in the data: {unknown}")
    predicate = conjunction(in_list(quoted(name), values) for name, values in wanted.items())
    return df if predicate is None else df.filter(predicate)
