"""Vector column functions.

All take and return ``array<float>`` columns. They are Arrow UDFs over numpy: Spark's higher-order array
functions evaluate one boxed element at a time, measured several times slower on 64-wide vectors, and a norm
used inside ``transform`` is even evaluated again for every element. Arithmetic runs in double precision;
vectors are stored as float.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: smallest divisor used when normalizing; a norm below it counts as near zero.
MIN_NORM = 1e-10

VECTOR = T.ArrayType(T.FloatType())

# Queries compared at once with all points of a task, and the room left for rounding in such comparisons,
# relative to the squared norms.
CHUNK = 256
SLACK = 1e-9


def flat_values(vectors: pa.Array, stored: type = np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated elements of a list array, in the stored precision, and the length of each row (null row = 0)."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore"):
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(stored)
    return values, lengths


def as_matrix(vectors: pa.Array, stored: type = np.float32) -> np.ndarray:
    """Rows as a double matrix. Ragged or null rows are an error."""
    values, lengths = flat_values(vectors, stored)
    if len(lengths) == 0:
        return np.empty((0, 0))
    if vectors.null_count or lengths.min() != lengths.max():
        raise ValueError("vectors must be non-null and of equal length")
    return values.astype(np.float64).reshape(len(lengths), int(lengths[0]))


def as_list_array(values: np.ndarray, lengths: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    mask = pa.array(nulls) if nulls is not None and nulls.any() else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=mask)


def _clean(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Finite double elements, row lengths, row norms, and the non-finite element count per row."""
    values, lengths = flat_values(vectors)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    finite = np.isfinite(values)
    clean = np.where(finite, values, 0.0).astype(np.float64)
    norms = np.sqrt(np.bincount(rows, weights=clean * clean, minlength=len(lengths)))
    bad = np.bincount(rows, weights=~finite, minlength=len(lengths)).astype(np.int32)
    return clean, lengths, norms, bad


def prepare(vector: Column) -> Column:
    """Cast to float, set non-finite elements to 0, divide by ``max(norm, 1e-10)``. Null stays null."""

    @F.arrow_udf(returnType=VECTOR)
    def prepare_vector(vectors: pa.Array) -> pa.Array:
        clean, lengths, norms, _ = _clean(vectors)
        scaled = clean / np.repeat(np.maximum(norms, MIN_NORM), lengths) + 0.0  # no negative zeros
        nulls = vectors.is_null().to_numpy(zero_copy_only=False)
        return as_list_array(scaled.astype(np.float32), lengths, nulls)

    return prepare_vector(vector)


def quality(vector: Column) -> Column:
    """``struct(nonfinite, norm)``: replaced element count and the norm before division."""
    schema = T.StructType(
        [T.StructField("nonfinite", T.IntegerType()), T.StructField("norm", T.DoubleType())]
    )

    @F.arrow_udf(returnType=schema)
    def vector_quality(vectors: pa.Array) -> pa.Array:
        _, _, norms, bad = _clean(vectors)
        return pa.StructArray.from_arrays([pa.array(bad), pa.array(norms)], names=["nonfinite", "norm"])

    return vector_quality(vector)


def squared_distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """All point-to-center squared distances of two matrices that both fit in a task."""
    cross = points @ centers.T
    total = (points * points).sum(1)[:, None] + (centers * centers).sum(1)[None, :] - 2.0 * cross
    return np.maximum(total, 0.0)


def closest(queries: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and exact squared distances of the k nearest points, ties to the earlier position.

    A matrix product makes a shortlist; distances within it are recomputed as differences, which makes
    identical vectors exactly 0 apart. Where the shortlist could have missed a tie, the row is done in full.
    """
    k = min(k, len(points))
    short = min(len(points), 2 * k + 16)
    room = SLACK * (1.0 + (points * points).sum(axis=1).max(initial=0.0) + (queries * queries).sum(axis=1).max(initial=0.0))
    where = np.empty((len(queries), k), dtype=np.int64)
    dist = np.empty((len(queries), k))
    for start in range(0, len(queries), CHUNK):
        part = queries[start : start + CHUNK]
        rough = squared_distances(part, points)
        if short < len(points):
            listed = np.argpartition(rough, short - 1, axis=1)[:, :short]
            listed.sort(axis=1)
        else:
            listed = np.broadcast_to(np.arange(len(points)), rough.shape)
        exact = ((points[listed] - part[:, None, :]) ** 2).sum(axis=2)
        order = np.argsort(exact, axis=1, kind="stable")[:, :k]
        found, value = np.take_along_axis(listed, order, 1), np.take_along_axis(exact, order, 1)
        if short < len(points):
            edge = np.take_along_axis(rough, listed, 1).max(axis=1)
            for row in np.flatnonzero(edge <= value[:, -1] + room):
                whole = ((points - part[row]) ** 2).sum(axis=1)
                best = np.argsort(whole, kind="stable")[:k]
                found[row], value[row] = best, whole[best]
        where[start : start + CHUNK], dist[start : start + CHUNK] = found, value
    return where, dist


def nearest_center(vector: Column, ids: list[int], centers: np.ndarray) -> Column:
    """``struct(cluster, dist2)`` of the closest center; equal distances go to the first listed id."""
    names = np.asarray(ids, dtype=np.int32)
    schema = T.StructType(
        [T.StructField("cluster", T.IntegerType()), T.StructField("dist2", T.DoubleType())]
    )

    @F.arrow_udf(returnType=schema)
    def assign(vectors: pa.Array) -> pa.Array:
        points = as_matrix(vectors)
        if len(points) == 0:
            best, exact = np.empty(0, dtype=np.int64), np.empty(0)
        else:
            where, distances = closest(points, centers, 1)
            best, exact = where[:, 0], distances[:, 0]
        return pa.StructArray.from_arrays(
            [pa.array(names[best]), pa.array(exact)], names=["cluster", "dist2"]
        )

    return assign(vector)


def distance2_to_own(vector: Column, label: Column, labels: list[str], centers: np.ndarray) -> Column:
    """Squared distance of each row to the center of the label it carries."""
    position = {name: i for i, name in enumerate(labels)}

    @F.arrow_udf(returnType=T.DoubleType())
    def distance(vectors: pa.Array, names: pa.Array) -> pa.Array:
        points = as_matrix(vectors)
        if len(points) == 0:
            return pa.array([], pa.float64())
        encoded = names.dictionary_encode()
        lookup = np.array([position[n] for n in encoded.dictionary.to_pylist()], dtype=np.int64)
        own = centers[lookup[encoded.indices.to_numpy(zero_copy_only=False)]]
        return pa.array(((points - own) ** 2).sum(axis=1))

    return distance(vector, label.cast("string"))


def distance2(vector: Column, center: Column) -> Column:
    """Squared distance of a vector column to a column of double centers of equal width."""

    @F.arrow_udf(returnType=T.DoubleType())
    def distance(points: pa.Array, centers: pa.Array) -> pa.Array:
        x, y = as_matrix(points), as_matrix(centers, np.float64)
        return pa.array(((x - y) ** 2).sum(axis=1) if len(x) else np.empty(0))

    return distance(vector, center)
