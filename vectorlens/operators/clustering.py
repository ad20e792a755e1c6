"""K-Means, assignment to given centers, label columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorlens.functions import vectors
from vectorlens.functions.predicates import quoted
from vectorlens.operators import lloyd
from vectorlens.operators.ordering import with_row_key
from vectorlens.operators.preparation import FEATURES, with_features
from vectorlens.operators.profile import LABEL_PREFIX, label_columns

# Largest center table held by every task. Clustering itself goes to 100 clusters.
MAX_CENTER_BYTES = 64 * 1024 * 1024
# Rows and centers of one block, when neither side is small; a block of rows and one of centers are compared at once.
ROWS_PER_BLOCK, CENTERS_PER_BLOCK = 16_384, 4096
# Vectors of either side that meet in one task, as bytes of doubles: a task takes as many whole blocks as fit, for every
# row travels once to each task that needs it. Smaller tables make up to TASKS tasks.
TASK_BYTES = 32 * 1024 * 1024
TASKS = 24


@dataclass(frozen=True)
class Clusters:
    """A fitted K-Means model together with how its input was prepared."""

    model: KMeansModel
    vec_col: str
    normalize: bool

    @property
    def k(self) -> int:
        return len(self.centers)

    @property
    def centers(self) -> np.ndarray:
        return np.array(self.model.clusterCenters())

    def label(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Add the int cluster id; row-wise, so metadata stays in place and no join is needed."""
        ready = with_features(df, self.vec_col, self.normalize)
        return self.model.transform(ready).withColumnRenamed("prediction", name).drop(FEATURES)


def check_cluster_count(df: DataFrame, k: int) -> None:
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    seen = len(df.select(F.lit(1)).take(k))
    if seen < k:
        raise ValueError(f"k={k} exceeds the number of rows ({seen})")


def kmeans(
    df: DataFrame,
    k: int,
    vec_col: str = "emb",
    seed: int | None = None,
    normalize: bool = True,
    max_iter: int = 300,
    tol: float = 1e-4,
) -> Clusters | lloyd.Centers:
    """Fit Euclidean K-Means, by default on normalized vectors.

    MLlib keeps the feature vectors for the length of the fit, spilling to disk. It fits two clusters and more; the
    center of a single one is the mean.
    """
    check_cluster_count(df, k)
    if k == 1:
        return lloyd.lloyd(df, np.zeros((1, vector_width(df, vec_col))), vec_col, normalize)
    estimator = KMeans(
        k=k, maxIter=max_iter, tol=tol, featuresCol=FEATURES, initMode="k-means||", distanceMeasure="euclidean"
    )
    if seed is not None:
        estimator = estimator.setSeed(seed)
    features = with_features(df.select(quoted(vec_col)), vec_col, normalize).select(FEATURES)
    return Clusters(estimator.fit(features), vec_col, normalize)


def vector_width(df: DataFrame, vec_col: str) -> int:
    first = df.select(F.size(quoted(vec_col))).filter(quoted(vec_col).isNotNull()).first()
    return 0 if first is None else first[0]


def lloyd_kmeans(
    df: DataFrame, k: int, id_col: str = "uuid", vec_col: str = "emb", normalize: bool = True, max_iter: int = 300
) -> lloyd.Centers:
    """Lloyd to its fixed point from the rows with the k lowest ids; determined by the data alone."""
    check_cluster_count(df, k)
    return lloyd.lloyd(df, lloyd.first_vectors(df, k, id_col, vec_col, normalize), vec_col, normalize, max_iter)


def kmeans_labels(df: DataFrame, k: int, id_col: str = "uuid", vec_col: str = "emb", seed: int | None = None) -> DataFrame:
    """``(id, prediction)`` only."""
    return kmeans(df, k, vec_col, seed).label(df.select(id_col, vec_col)).select(id_col, "prediction")


def add_label_column(df: DataFrame, clusters: Clusters | lloyd.Centers, k: int) -> DataFrame:
    """Add ``KMeans (k=N)`` as text. Several k stand side by side, the same k is replaced."""
    labelled = clusters.label(df, "__label")
    name = f"{LABEL_PREFIX}{k})"
    return labelled.withColumn(name, F.col("__label").cast("string")).drop("__label")


def carry_label_columns(new: DataFrame, previous: DataFrame, id_col: str = "uuid") -> DataFrame:
    """Copy the label columns of an earlier frame to a new one, matched by id; every new row comes out once.

    Null is an id like others. An id that repeats in the earlier frame carries a label on which its rows agree, and null
    where they do not: frames whose ids repeat are matched by a row key instead (``ordering.with_row_key``).
    """
    names = label_columns(previous.columns)
    if not names:
        return new
    kept = new.drop(*[n for n in names if n in new.columns])
    agreed = [F.when(F.min(quoted(n)) == F.max(quoted(n)), F.min(quoted(n))).alias(n) for n in names]
    carried = previous.groupBy(quoted(id_col).alias("__id")).agg(*agreed)
    return kept.join(carried, quoted(id_col).eqNullSafe(F.col("__id")), "left").drop("__id")


def collect_centers(centers: DataFrame, id_col: str, vec_col: str) -> tuple[list[int], np.ndarray]:
    """Read a center table to the driver, in id order, after checking that it is small."""
    if _center_bytes(centers, vec_col) > MAX_CENTER_BYTES:
        raise ValueError(f"the centers exceed {MAX_CENTER_BYTES} bytes")
    found = sorted(tuple(r) for r in centers.select(quoted(id_col), quoted(vec_col)).collect())
    if not found:
        raise ValueError("no centers given")
    return [int(r[0]) for r in found], np.array([r[1] for r in found], dtype=np.float64)


def _center_bytes(centers: DataFrame, vec_col: str) -> int:
    width, rows = centers.agg(F.max(F.size(quoted(vec_col))), F.count(F.lit(1))).first()
    return (width or 0) * rows * 8


def _nearest(points: np.ndarray, centers: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and exact squared distance of the nearest center, ties to the earlier position, ``step`` centers at once."""
    where, dist = np.zeros(len(points), dtype=np.int64), np.full(len(points), np.nan)
    norms, center_norms = (points * points).sum(axis=1), (centers * centers).sum(axis=1)
    # What is not finite has no rough distance; such rows and centers are compared element by element.
    plain = np.flatnonzero(np.isfinite(center_norms))
    odd = np.flatnonzero(~np.isfinite(center_norms))
    room = vectors.SLACK * (1.0 + center_norms[plain].max(initial=0.0) + norms)
    for first in range(0, len(plain), step):
        some = plain[first : first + step]
        for start in range(0, len(points), vectors.CHUNK):
            part = slice(start, start + vectors.CHUNK)
            rough = points[part] @ centers[some].T
            rough *= -2.0
            rough += center_norms[some]
            # All that may be nearest, or as near as what was found before.
            limit = np.fmin(rough.min(axis=1) + norms[part], dist[part]) + room[part] - norms[part]
            row, col = np.nonzero(rough <= limit[:, None])
            _keep_nearest(where[part], dist[part], row, some[col], ((centers[some[col]] - points[part][row]) ** 2).sum(axis=1))
    rows = np.flatnonzero(~np.isfinite(norms))
    for row in range(len(points)) if len(odd) else rows:
        others = np.arange(len(centers)) if not np.isfinite(norms[row]) else odd
        _keep_nearest(where[row : row + 1], dist[row : row + 1], np.zeros(len(others), int), others, ((centers[others] - points[row]) ** 2).sum(axis=1))
    return where, dist


def _keep_nearest(where: np.ndarray, dist: np.ndarray, row: np.ndarray, at: np.ndarray, d2: np.ndarray) -> None:
    """Take over, for each row, the nearest of the centers met if it is nearer than the one before. NaN is farthest."""
    order = np.lexsort((at, d2, row))
    row, at, d2 = row[order], at[order], d2[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    row, at, d2 = row[first], at[first], d2[first]
    closer = (d2 < dist[row]) | (np.isnan(dist[row]) & ~np.isnan(d2)) | ((d2 == dist[row]) & (at < where[row]))
    where[row[closer]], dist[row[closer]] = at[closer], d2[closer]


def _meet_centers(center_type: pa.DataType, step: int):
    """Blocks of rows against blocks of centers: the nearest one of each row, ties to the lowest id, null ids last."""

    def run(rows: pa.Table, centers: pa.Table) -> pa.Table:
        schema = pa.schema([("key", pa.int64()), ("dist2", pa.float64()), ("unnamed", pa.bool_()), ("cluster", center_type)])
        if rows.num_rows == 0 or centers.num_rows == 0:
            return schema.empty_table()
        centers = centers.sort_by("id").combine_chunks()
        points = vectors.as_matrix(rows["v"].combine_chunks())
        where, dist = _nearest(points, vectors.as_matrix(centers["c"].combine_chunks(), np.float64), step)
        ids = centers["id"].combine_chunks().take(pa.array(where))
        return pa.Table.from_arrays([rows["key"].combine_chunks(), pa.array(dist), ids.is_null(), ids], schema=schema)

    return run


def _parts(n_rows: int, n_centers: int, width: int, row_block: int, center_block: int) -> tuple[int, int]:
    """Parts of the rows and of the centers: as many as memory asks for, and of the rows up to ``TASKS`` tasks."""
    room = TASK_BYTES // (8 * max(1, width))
    of_rows, of_centers = (max(1, -(-n // (max(1, room // block) * block))) for n, block in ((n_rows, row_block), (n_centers, center_block)))
    return max(of_rows, min(-(-n_rows // row_block), -(-TASKS // of_centers))), of_centers


def assign_to_table(
    df: DataFrame,
    centers: DataFrame,
    id_col: str,
    vec_col: str,
    center_id: str,
    center_vec: str,
    rows_per_block: int = ROWS_PER_BLOCK,
    centers_per_block: int = CENTERS_PER_BLOCK,
) -> DataFrame:
    """Add ``cluster`` and ``dist2`` of the nearest row of a center table (ties to the lowest id, a null id after all).

    Parts of the rows, many blocks each, meet parts of the centers on the executors, block by block, and each row keeps
    its nearest center over all parts.
    Rows are told apart by a key of their own: ``id_col`` may repeat or be null and only names the column to keep. No
    center reaches the driver. Rows without a vector get nulls.
    """
    n_centers, n_rows = centers.count(), df.count()
    if n_centers == 0:
        raise ValueError("no centers given")
    row_parts, center_parts = _parts(n_rows, n_centers, vector_width(centers, center_vec), rows_per_block, centers_per_block)
    keyed = with_row_key(df, "__key")
    named = centers.select(quoted(center_id).alias("id"), quoted(center_vec).cast("array<double>").alias("c"))
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (center_parts, row_parts)]
    rows = keyed.select(F.col("__key").alias("key"), quoted(vec_col).cast(vectors.VECTOR).alias("v")).filter("v IS NOT NULL")
    rows = rows.withColumn("rb", F.pmod(F.xxhash64("key"), F.lit(row_parts)).cast("int")).withColumn("cb", every[0])
    dealt = named.withColumn("cb", F.pmod(F.xxhash64("id", "c"), F.lit(center_parts)).cast("int")).withColumn("rb", every[1])
    tasks = row_parts * center_parts
    left, right = (side.repartition(tasks, "rb", "cb").groupBy("rb", "cb") for side in (rows, dealt))
    id_type = named.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("key", T.LongType()), T.StructField("dist2", T.DoubleType()), T.StructField("unnamed", T.BooleanType()), T.StructField("cluster", id_type)]
    )
    from pyspark.sql.pandas.types import to_arrow_type

    met = left.cogroup(right).applyInArrow(_meet_centers(to_arrow_type(id_type), centers_per_block), schema)
    best = met.groupBy("key").agg(F.min(F.struct("dist2", "unnamed", "cluster")).alias("best"))
    found = keyed.join(best, F.col("__key") == F.col("key"), "left")
    return found.select(*[quoted(c) for c in df.columns], F.col("best.cluster").alias("cluster"), F.col("best.dist2").alias("dist2"))


def assign_nearest(df: DataFrame, ids: list[int], centers: np.ndarray, vec_col: str = "emb") -> DataFrame:
    """Add ``cluster`` and ``dist2`` of the nearest given center (ties to the lowest id)."""
    hit = vectors.nearest_center(quoted(vec_col), ids, centers)
    return df.withColumn("__hit", hit).select(
        *[quoted(c) for c in df.columns], F.col("__hit.cluster").alias("cluster"), F.col("__hit.dist2").alias("dist2")
    )


def mean_vectors(df: DataFrame, label_col: str, vec_col: str) -> DataFrame:
    """``(label, features)``: mean vector per label, combined map-side."""
    return df.groupBy(quoted(label_col)).agg(Summarizer.mean(array_to_vector(quoted(vec_col))).alias("features"))


def seeded_lloyd(df: DataFrame, k: int, iterations: int, id_col: str = "uuid", vec_col: str = "emb") -> DataFrame:
    """A fixed number of assign-and-average steps from the k rows with the lowest ids.

    Fully determined by the data, so it can be compared across engines. Only the k centers are held by the
    driver; a cluster that empties keeps its center.
    """
    check_cluster_count(df, k)
    start = df.sort(quoted(id_col)).select(quoted(vec_col)).take(k)
    centers = np.array([r[0] for r in start], dtype=np.float64)
    ids = list(range(k))
    for _ in range(iterations):
        step = mean_vectors(assign_nearest(df.select(quoted(vec_col)), ids, centers, vec_col), "cluster", vec_col)
        centers = centers.copy()
        for cluster, mean in step.collect():  # at most k rows
            centers[cluster] = mean.toArray()
    return assign_nearest(df, ids, centers, vec_col)
