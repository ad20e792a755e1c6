"""Column profiles: type class, null share, value counts, and the orderings derived from them."""

from __future__ import annotations

import re

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorlens.functions.predicates import Filters, apply_filters, quoted
from vectorlens.functions.scalars import MISSING, nan_to_null
from vectorlens.operators.ordering import with_row_index
from vectorlens.session import cut_lineage

# Columns never offered as metadata (compared in lower case), and the category limit.
RESERVED = {"uuid", "emb", "embedding", "embeddings", "vector"}
MAX_CATEGORIES = 100

# A HyperLogLog++ sketch at this error has 512 registers. At most 100 distinct values fill at most 100 of
# them, where the estimate is linear counting: 512 * ln(512 / 412) = 111.3. An estimate above the cutoff
# therefore proves more than 100 distinct values; only columns at or below it need an exact count, and
# those have few values. High-cardinality text is never shuffled.
SKETCH_ERROR = 0.05
SKETCH_CUTOFF = 112


@dataclass(frozen=True)
class ColumnFacts:
    position: int
    name: str
    kind: str  # empty, numeric, text, or countable (category or text, still to be counted)
    null_count: int
    total: int


def metadata_fields(df: DataFrame, reserved: set[str] = RESERVED) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name.lower() not in reserved]


def column_facts(df: DataFrame, reserved: set[str] = RESERVED) -> list[ColumnFacts]:
    """First pass: one aggregate row with null counts and distinct sketches."""
    fields = metadata_fields(df, reserved)
    aggregates = [F.count(F.lit(1)).alias("total")]
    for i, field in enumerate(fields):
        aggregates.append(F.count(quoted(field.name)).alias(f"present_{i}"))
        if _countable(field.dataType):
            aggregates.append(F.approx_count_distinct(quoted(field.name), SKETCH_ERROR).alias(f"sketch_{i}"))
    row = df.agg(*aggregates).first()
    facts = []
    for i, field in enumerate(fields):
        present = row[f"present_{i}"]
        if present == 0:
            kind = "empty"
        elif isinstance(field.dataType, T.ArrayType):
            continue
        elif isinstance(field.dataType, T.NumericType):
            kind = "numeric"
        elif _countable(field.dataType) and row[f"sketch_{i}"] <= SKETCH_CUTOFF:
            kind = "countable"
        else:
            kind = "text"
        facts.append(ColumnFacts(i, field.name, kind, row["total"] - present, row["total"]))
    return facts


def _countable(dtype: T.DataType) -> bool:
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    return not isinstance(dtype, (T.NumericType, *nested))


def _long_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """``(column, value, n)`` of the named columns, null values included, in one scan."""
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value string, n long")
    pairs = ", ".join(
        "'{}', cast(`{}` as string)".format(n.replace("\\", "\\\\").replace("'", "\\'"), n.replace("`", "``"))
        for n in names
    )
    unpivoted = df.select(F.expr(f"stack({len(names)}, {pairs}) as (column, value)"))
    return unpivoted.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, reserved: set[str] = RESERVED) -> DataFrame:
    """One row per metadata column: class, distinct count (categories only), nulls.

    A column is a category when it has at most 100 distinct values, null counted as one of them.
    """
    facts = column_facts(df, reserved)
    spark = df.sparkSession
    base = spark.createDataFrame(
        [(f.position, f.name, f.kind, f.null_count, f.total) for f in facts],
        "position int, column string, kind string, null_count long, total_count long",
    )
    counted = (
        _long_counts(df, [f.name for f in facts if f.kind == "countable"])
        .groupBy("column")
        .agg(F.count("value").alias("present"), F.count(F.lit(1)).alias("distinct"))
    )
    is_category = (F.col("kind") == "countable") & (F.col("distinct") <= MAX_CATEGORIES)
    kind = F.when(is_category, "categorical").when(F.col("kind") == "countable", "text").otherwise(F.col("kind"))
    return base.join(counted, "column", "left").select(
        "position",
        "column",
        kind.alias("type"),
        F.when(is_category, F.col("present")).when(F.col("kind") == "empty", F.lit(0)).cast("long").alias("n_unique"),
        "null_count",
        "total_count",
        F.when(F.col("total_count") > 0, F.col("null_count") * 100.0 / F.col("total_count"))
        .otherwise(0.0)
        .alias("null_pct"),
    )


def class_counts(df: DataFrame, reserved: set[str] = RESERVED) -> DataFrame:
    """``(type, n)``: how many columns of each class a loaded table has."""
    return profile(df, reserved).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, reserved: set[str] = RESERVED) -> DataFrame:
    """``(column, value, n)`` of every categorical column, nulls left out."""
    facts = column_facts(df, reserved)
    counts = _long_counts(df, [f.name for f in facts if f.kind == "countable"])
    # The sketch has left only columns with few values, so a window over one column's values is small.
    distinct = F.count(F.lit(1)).over(Window.partitionBy("column"))
    kept = counts.withColumn("distinct", distinct).filter(F.col("distinct") <= MAX_CATEGORIES)
    return kept.filter(F.col("value").isNotNull()).drop("distinct")


def column_summary(df: DataFrame, reserved: set[str] = RESERVED) -> DataFrame:
    """Display form of the profile: ``many`` where the number of values is unknown or zero."""
    unique = F.when(F.col("n_unique") > 0, F.col("n_unique").cast("string")).otherwise("many")
    return profile(df, reserved).select(
        F.col("column").alias("Column"),
        F.col("type").alias("Type"),
        unique.alias("Unique"),
        F.round("null_pct", 1).alias("null_pct"),
    )


def filter_column_order(df: DataFrame, reserved: set[str] = RESERVED) -> DataFrame:
    """Offered filter columns: categories by ascending cardinality, then numeric, then text."""
    rank = F.when(F.col("type") == "categorical", 0).when(F.col("type") == "numeric", 1).when(F.col("type") == "text", 2)
    ranked = profile(df, reserved).withColumn("type_rank", rank).filter(F.col("type_rank").isNotNull())
    order = F.struct(
        "type_rank", F.when(F.col("type_rank") == 0, F.col("n_unique")).otherwise(0).alias("size"), "position", "column"
    )
    # One small array: at most one entry per table column.
    listed = ranked.agg(F.sort_array(F.collect_list(order)).alias("cols"))
    return listed.select(F.posexplode("cols").alias("rank", "c")).select(
        (F.col("rank") + 1).alias("rank"), F.col("c.column").alias("column"), F.col("c.type_rank").alias("type_rank")
    )


# Columns that can not colour a chart, and the prefix of cluster label columns.
NOT_COLOUR = {
    "x", "y", "idx", "uuid", "emb", "embedding", "embeddings", "vector",
    "identifier", "image_url", "url", "img_url", "image", "image_path", "file_name",
}
LABEL_PREFIX = "KMeans (k="
MANY_COLOURS = 20


def label_columns(columns: list[str]) -> list[str]:
    """Cluster label columns ``KMeans (k=N)`` ordered by N."""
    numbers = {c: m[1] for c in columns if (m := re.fullmatch(re.escape(LABEL_PREFIX) + r"(\d+)\)", c))}
    return sorted(numbers, key=lambda c: int(numbers[c]))


def colour_candidates(df: DataFrame, skip: set[str] = NOT_COLOUR) -> DataFrame:
    """Columns of a plot frame with at most 100 distinct values, label columns first.

    A missing value shows as ``N/A`` in the frame and so counts as one value.
    """
    fields = [
        f for f in df.schema.fields
        if f.name not in skip and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
    ]
    labels = label_columns([f.name for f in fields])
    order = labels + [f.name for f in fields if f.name not in labels]
    cleaned = df.select(
        *[nan_to_null(quoted(f.name), f.dataType).cast("string").alias(f.name) for f in fields]
    )
    facts = cleaned.agg(
        *[F.approx_count_distinct(quoted(n), SKETCH_ERROR).alias(str(i)) for i, n in enumerate(order)]
    ).first()
    small = [n for i, n in enumerate(order) if facts[str(i)] <= SKETCH_CUTOFF]
    counted = _long_counts(cleaned.fillna(MISSING), small).groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    position = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("column"))
    return counted.filter(F.col("n_unique") <= MAX_CATEGORIES).select(
        "column", "n_unique", position.alias("position"), (F.col("n_unique") > MANY_COLOURS).alias("many")
    )


def legend_order(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a colour column with their legend rank.

    Numeric order if every value parses as an integer, else text order.
    """
    values = cut_lineage(df.select(quoted(column).cast("string").alias("value")).distinct())
    whole = F.coalesce(F.col("value").rlike(r"^\s*[+-]?\d+\s*$"), F.lit(False))
    numeric = values.agg(F.min(whole)).first()[0]
    keys = [F.trim("value").cast("decimal(38,0)"), F.col("value")] if numeric else [F.col("value")]
    return with_row_index(values, keys, "rank").select((F.col("rank") + 1).alias("rank"), "value")


def clusters_from_column(df: DataFrame, column: str, filters: Filters | None = None) -> DataFrame:
    """Cluster count proposed by a column (distinct non-null values) and the allowed slider range."""
    kept = apply_filters(df, filters or {})
    total = F.count(F.lit(1))
    return kept.agg(
        F.count_distinct(quoted(column)).alias("n_clusters"),
        F.lit(2).alias("slider_min"),
        F.least(F.lit(100), F.floor(total / 2)).cast("long").alias("slider_max"),
    )
