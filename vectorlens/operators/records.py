"""Row-level views: plot frame, record lookup and detail, image link, file name, tooltip columns."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorlens.functions.predicates import quoted
from vectorlens.functions.scalars import MISSING, basename, fixed, nan_to_null
from vectorlens.operators.ordering import with_row_index
from vectorlens.operators.profile import RESERVED

# Fixed values, in order of preference: columns that may hold an image link.
IMAGE_COLUMNS = ["identifier", "image_url", "url", "img_url", "image"]
HIDDEN_FIELDS = RESERVED | {"idx"}
NOT_TOOLTIP = {
    "x", "y", "idx", "emb", "embedding", "embeddings", "vector",
    "uuid", "identifier", "image_url", "url", "img_url", "image", "image_path",
}
TOOLTIP_LIMIT = 15


def plot_frame(
    df: DataFrame,
    x: str | Column,
    y: str | Column,
    id_col: str = "uuid",
    vec_col: str | None = None,
    index: bool = False,
) -> DataFrame:
    """``x, y, id`` and the metadata columns, without vectors and without columns named x, y or idx.

    Missing text shows as ``N/A``; missing values of other types (and NaN) stay null and are read as ``N/A``
    by the evaluation operators.
    """
    coordinate = {"x": quoted(x) if isinstance(x, str) else x, "y": quoted(y) if isinstance(y, str) else y}
    taken = {"x", "y", "idx", id_col} | {c for c in (vec_col, x, y) if isinstance(c, str)}
    shown = [coordinate["x"].alias("x"), coordinate["y"].alias("y"), quoted(id_col)]
    for field in df.schema.fields:
        if field.name in taken or field.name.lower() in RESERVED:
            continue
        value = nan_to_null(quoted(field.name), field.dataType)
        if isinstance(field.dataType, T.StringType):
            value = F.coalesce(value, F.lit(MISSING))
        shown.append(value.alias(field.name))
    frame = df.select(*shown)
    return with_row_index(frame, [quoted(id_col)]) if index else frame


def with_file_name(df: DataFrame, path_col: str, name: str = "file_name") -> DataFrame:
    return df.withColumn(name, basename(quoted(path_col)))


def lookup(df: DataFrame, id_col: str, value: object) -> DataFrame:
    """The first record with this id, in the order of its columns; the filter reaches the scan."""
    order = [quoted(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return df.filter(quoted(id_col) == F.lit(value)).sort(*order).limit(1)


def lookup_many(df: DataFrame, id_col: str, wanted: DataFrame) -> DataFrame:
    """Records whose id is in the one-column frame ``wanted``, each once per record."""
    ids = wanted.toDF(id_col)
    return df.join(ids, id_col, "left_semi")


def record_detail(df: DataFrame, id_col: str) -> DataFrame:
    """``(id, Field, Value)`` for every non-null shown field.

    Floats print with four decimals, lists as their length, everything else as text.
    """
    pairs: list[Column] = []
    for field in df.schema.fields:
        if field.name == id_col or field.name.lower() in HIDDEN_FIELDS:
            continue
        column = nan_to_null(quoted(field.name), field.dataType)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            text = fixed(column, 4)
        elif isinstance(field.dataType, T.ArrayType):
            text = F.when(column.isNotNull(), F.format_string("[%d items]", F.size(column)))
        else:
            text = column.cast("string")
        pairs += [F.lit(field.name), text]
    long = df.select(quoted(id_col), F.stack(F.lit(len(pairs) // 2), *pairs).alias("Field", "Value"))
    return long.filter(F.col("Value").isNotNull())


def with_image_url(df: DataFrame, name: str = "resolved_url") -> DataFrame:
    """First candidate column, in fixed order, that holds an http or https link."""
    candidates = []
    for column in IMAGE_COLUMNS:
        if column in df.columns and isinstance(df.schema[column].dataType, T.StringType):
            link = quoted(column)
            candidates.append(F.when(link.startswith("http://") | link.startswith("https://"), link))
    resolved = F.coalesce(*candidates) if candidates else F.lit(None).cast("string")
    return df.withColumn(name, resolved)


def tooltip_columns(
    columns: list[str], colour: str | None = None, file_names: bool = False, limit: int = TOOLTIP_LIMIT
) -> list[str]:
    """File name (if asked for), then the colour column, then up to ``limit`` other metadata columns in table order."""
    head = [c for c in (["file_name"] if file_names and "file_name" in columns else []) + [colour] if c and c not in NOT_TOOLTIP]
    head = list(dict.fromkeys(head))
    others = (c for c in columns if c not in NOT_TOOLTIP and c not in head)
    return [*head, *islice(others, limit)]
