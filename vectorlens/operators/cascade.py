"""Cascading filters: what each filter can still offer, given all the others."""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorlens.functions.predicates import Filters, apply_filters, column_predicates, conjunction, quoted
from vectorlens.operators.profile import profile


def _others(filters: Filters, target: str) -> Filters:
    return {name: wanted for name, wanted in filters.items() if name != target and wanted}


def options(df: DataFrame, target: str, filters: Filters) -> DataFrame:
    """Sorted distinct non-null values of ``target`` after every other filter.

    With no other filter the profile's values are offered: none for numeric and text columns.
    """
    others = _others(filters, target)
    column = quoted(target)
    kept = apply_filters(df, others)
    if not others:
        kind = profile(df.select(column), reserved=set()).first()["type"]
        if kind != "categorical":
            kept = kept.filter(F.lit(False))
    values = kept.filter(column.isNotNull()).select(column.alias("value")).distinct()
    return values.sort("value")


def options_for_all(df: DataFrame, targets: list[str], filters: Filters) -> DataFrame:
    """``(column, value, n)`` for every target at once, in one scan.

    A row feeds the options of a target when no predicate other than the target's own fails on it.
    """
    predicates = {n: F.coalesce(p, F.lit(False)) for n, p in column_predicates(df, filters).items()}
    failures = reduce(add, [(~p).cast("int") for p in predicates.values()], F.lit(0))
    staged = df.select(
        *[quoted(t) for t in targets],
        failures.alias("__failures"),
        *[(~predicates[t]).cast("int").alias(f"__own_{i}") for i, t in enumerate(targets) if t in predicates],
    )
    pairs: list[Column] = []
    for i, target in enumerate(targets):
        own = F.col(f"__own_{i}") if target in predicates else F.lit(0)
        pairs += [F.lit(target), F.when(F.col("__failures") == own, quoted(target).cast("string"))]
    long = staged.select(F.stack(F.lit(len(targets)), *pairs).alias("column", "value"))
    return long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def numeric_range(df: DataFrame, target: str, filters: Filters) -> DataFrame:
    """Available range of a numeric column after the other filters, and the current range clamped into it.

    ``offered`` is false when there is nothing to choose; ``active`` is false when the current range is the
    whole available range, which counts as no filter.
    """
    kept = apply_filters(df, _others(filters, target))
    value = quoted(target).cast("double")
    bounds = kept.filter(value.isNotNull() & ~F.isnan(value)).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    current: Any = filters.get(target)
    current = current if isinstance(current, dict) else {}

    def clamp(wanted: Any, default: str) -> Column:
        asked = F.lit(float(wanted)) if wanted is not None else F.col(default)
        return F.when(F.col("low").isNotNull(), F.greatest(F.col("low"), F.least(asked, F.col("high"))))

    chosen = bounds.select(
        "low", "high", clamp(current.get("min"), "low").alias("min"), clamp(current.get("max"), "high").alias("max")
    )
    offered = F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    narrowed = (F.col("min") != F.col("low")) | (F.col("max") != F.col("high"))
    return chosen.select(
        "low", "high", "min", "max", offered.alias("offered"), (offered & narrowed).alias("active")
    )


def prune_selection(df: DataFrame, target: str, filters: Filters) -> DataFrame:
    """Selected values still available after the other filters, with their place in the selection."""
    selection = [v for v in filters.get(target) or [] if v is not None]
    column = quoted(target)
    kept = apply_filters(df, _others(filters, target)).filter(column.isin(selection))
    dtype = df.schema[target].dataType
    chosen = F.array(*[F.lit(v) for v in selection]).cast(T.ArrayType(dtype))
    return kept.select(column.alias("value")).distinct().select(
        F.array_position(chosen, F.col("value")).alias("position"), "value"
    )


def preview(df: DataFrame, filters: Filters) -> DataFrame:
    """Matching rows, all rows, and the share kept in percent, in one scan."""
    predicate = conjunction(column_predicates(df, filters).values())
    kept = F.count(F.lit(1)) if predicate is None else F.count_if(predicate)
    total = F.count(F.lit(1))
    share = F.when(total > 0, kept * 100.0 / total)
    return df.agg(kept.alias("kept"), total.alias("total"), share.alias("retained_pct"))
