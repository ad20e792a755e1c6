"""Lloyd's iterations to a fixed point, with distance bounds that spare most rows.

At an anchor every row is searched, and its label, the distance to its center and that to the next center are written.
From then on a row whose bounds still tell its center apart, however far the centers have drifted since, is not looked
at: a filter on two numbers leaves it in the table. Sums change only by rows that have changed their center. When too
many rows fail their bounds, a new anchor is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorlens.functions import vectors
from vectorlens.functions.predicates import quoted
from vectorlens.operators.projection import prepared
from vectorlens.session import cut_lineage

# A new anchor is written once more than this share of all rows failed their bounds in a round.
ANCHOR_SHARE = 0.4
# Bounds are widened by this share of the distances, as room for rounding.
ROOM = 1e-9
_SUMS = "cluster int, n long, sums array<double>"


@dataclass(frozen=True)
class Centers:
    """Fitted centers together with how their input was prepared, and what the fit took."""

    centers: np.ndarray
    vec_col: str
    normalize: bool
    rounds: int
    searched: int
    rows: int

    @property
    def k(self) -> int:
        return len(self.centers)

    def label(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Add the int id of the nearest center, ties to the lowest; row-wise."""
        hit = vectors.nearest_center(prepared(self.vec_col, self.normalize), list(range(self.k)), self.centers)
        return df.withColumn(name, hit["cluster"])


def first_vectors(df: DataFrame, k: int, id_col: str, vec_col: str, normalize: bool = True) -> np.ndarray:
    """Prepared vectors of the rows with the k lowest ids, equal ids by their vectors."""
    chosen = df.select(quoted(id_col).alias("id"), prepared(vec_col, normalize).alias("v")).orderBy("id", "v").limit(k)
    return np.array([r["v"] for r in chosen.collect()], dtype=np.float64)


def _sums(cluster: np.ndarray, sign: np.ndarray, points: np.ndarray, k: int) -> pa.RecordBatch:
    total = np.zeros((k, points.shape[1]))
    np.add.at(total, cluster, points * sign[:, None])
    n = np.bincount(cluster, sign, k).astype(np.int64)
    columns = [pa.array(np.arange(k, dtype=np.int32)), pa.array(n), vectors.as_list_array(total.ravel(), np.full(k, points.shape[1]))]
    return pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])


def _anchor(centers: np.ndarray):
    """Every row with its label, the distance to its center and that to the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                where, dist = vectors.closest(vectors.as_matrix(batch.column(0)), centers, 2)
                upper = np.sqrt(dist[:, 0])
                lower = np.sqrt(dist[:, 1]) if dist.shape[1] > 1 else np.full(len(dist), np.inf)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(where[:, 0].astype(np.int32)), pa.array(upper), pa.array(lower)], ["v", "label", "upper", "lower"]
                )

    return run


def _own_sums(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = vectors.as_matrix(batch.column(0))
                yield _sums(batch.column(1).to_numpy(), np.ones(len(points)), points, k)

    return run


def _changes(centers: np.ndarray):
    """What rows that are searched again take from the sums of their label at the anchor, and add to others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = vectors.as_matrix(batch.column(0))
                label = batch.column(1).to_numpy()
                now = vectors.closest(points, centers, 1)[0][:, 0]
                gone = now != label
                cluster = np.concatenate((now[gone], label[gone]))
                sign = np.repeat([1.0, -1.0], int(gone.sum()))
                yield _sums(cluster, sign, np.concatenate((points[gone], points[gone])), len(centers))
                counted = pa.RecordBatch.from_arrays(
                    [pa.array([-1], pa.int32()), pa.array([len(points)]), vectors.as_list_array(np.zeros(points.shape[1]), np.array([points.shape[1]]))],
                    ["cluster", "n", "sums"],
                )
                yield counted

    return run


def _collected(partial: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Counts and sums per center (k rows reach the driver), and the rows that were searched."""
    spread = partial.select("cluster", "n", F.posexplode("sums").alias("pos", "s"))
    merged = spread.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    counts, sums, searched = np.zeros(k), np.zeros((k, width)), 0
    for cluster, pos, n, s in merged.collect():
        if cluster < 0:
            searched = n
        else:
            counts[cluster], sums[cluster, pos] = n, s
    return counts, sums, searched


def lloyd(
    df: DataFrame, start: np.ndarray, vec_col: str = "emb", normalize: bool = True, max_iter: int = 300, tol: float = 1e-9
) -> Centers:
    """Assign and average from the given centers until none moves by more than ``tol``; one center is allowed.

    A center without rows stays where it is. Rows without a vector take no part in the fit.
    """
    rows = df.select(prepared(vec_col, normalize).alias("v")).filter(F.col("v").isNotNull())
    centers, (k, width) = np.array(start, dtype=np.float64), np.shape(start)
    anchor, anchored, total = None, None, 0
    rounds = searched = 0
    for _ in range(max_iter):
        if anchor is None:
            anchor = cut_lineage(rows.mapInArrow(_anchor(centers), "v array<float>, label int, upper double, lower double"))
            base_n, base_sums, _ = _collected(anchor.select("v", "label").mapInArrow(_own_sums(k), _SUMS), k, width)
            anchored, total = centers, int(base_n.sum())
            counts, sums, again = base_n, base_sums, total
        else:
            drift = np.sqrt(((centers - anchored) ** 2).sum(axis=1))
            others = np.array([np.delete(drift, j).max(initial=0.0) for j in range(k)])
            up, down = (F.element_at(F.lit([float(x) for x in side]), F.col("label") + 1) for side in (drift, others))
            unsure = (F.col("upper") + up) * (1.0 + ROOM) + ROOM >= F.col("lower") - down
            more_n, more_sums, again = _collected(anchor.filter(unsure).select("v", "label").mapInArrow(_changes(centers), _SUMS), k, width)
            counts, sums = base_n + more_n, base_sums + more_sums
        rounds, searched = rounds + 1, searched + again
        after = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        moved = float(np.sqrt(((after - centers) ** 2).sum(axis=1)).max(initial=0.0))
        if moved <= tol:
            break
        if anchored is not centers and again > ANCHOR_SHARE * total:
            anchor = None
        centers = after
    return Centers(centers, vec_col, normalize, rounds, searched, total)
