"""Neighbour layout in two or more dimensions: attraction along graph edges, repulsion through a pyramid of cell means.

Rows are dealt to blocks along the first principal axis. In each round, one job, every block moves its rows a few steps
against what the others sent in the round before, and sends on what they need. Far rows push as the mean of a large
cell, near ones as that of a small one; the pyramid has a fixed number of cells and is all that a round sends to every
task.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorlens.functions import vectors
from vectorlens.functions.predicates import quoted
from vectorlens.operators import descent, neighbours
from vectorlens.operators.ordering import with_row_key
from vectorlens.operators.projection import pca
from vectorlens.session import cut_lineage

# Rounds, and steps that a block takes in each of them.
ITERATIONS, STEPS = 8, 6
# The layout stops once points move less than this on average in a step, as a share of its half width.
TOLERANCE = 1e-3
# Cells of the finest level of the pyramid, at most. Beyond GRID_AXES dimensions cells are told apart along the first
# ones only.
GRID_CELLS, GRID_AXES = 4096, 3
BLOCK_ROWS = 4096
# Curve of the UMAP paper for a minimum distance of 0.1, and its negative samples per edge.
CURVE_A, CURVE_B = 1.577, 0.895
NEGATIVES = 5.0
# Pull of the first quarter of the steps of t-SNE, against the later ones.
EXAGGERATION = 4.0
# Largest move of a point in one step, as a share of the layout's half width.
MAX_STEP = 0.25
HALF_WIDTH = 10.0
# Points compared with their cells at once inside a task.
CHUNK = 2048

# Kinds of rows that a round passes on: own points, positions for other blocks, forces on their points, cell sums.
OWN, PLACE, FORCE, CELL = 0, 1, 2, 3
_STATE = "block int, kind int, key long, degree double, at array<double>"
_STATE_ARROW = pa.schema(
    [("block", pa.int32()), ("kind", pa.int32()), ("key", pa.int64()), ("degree", pa.float64()), ("at", pa.list_(pa.float64()))]
)


def levels_for(axes: int) -> int:
    """Levels of the pyramid: halvings per axis until the finest level has ``GRID_CELLS`` cells."""
    return (GRID_CELLS.bit_length() - 1) // min(axes, GRID_AXES)


class Pyramid:
    """Sizes and means of the cells of a box, halved again and again."""

    def __init__(self, mass: np.ndarray, sums: np.ndarray, half: float, levels: int):
        """``mass`` and ``sums`` of the finest cells, in row-major order; coarser levels add them up."""
        self.axes = min(sums.shape[-1], GRID_AXES)
        self.half, self.levels = half, levels
        side = 1 << levels
        mass, sums = mass.reshape((side,) * self.axes), sums.reshape((side,) * self.axes + (-1,))
        self.mass, self.sums = [mass], [sums]
        for _ in range(levels):
            for axis in range(self.axes):
                take = [slice(None)] * self.axes
                even, odd = list(take), list(take)
                even[axis], odd[axis] = slice(0, None, 2), slice(1, None, 2)
                mass = mass[tuple(even)] + mass[tuple(odd)]
                sums = sums[tuple(even)] + sums[tuple(odd)]
            self.mass.insert(0, mass)
            self.sums.insert(0, sums)

    def cells(self, points: np.ndarray) -> np.ndarray:
        """Finest cell of every point, one index per axis. Outliers count in edge cells."""
        return finest_cells(points, self.axes, self.half, self.levels)

    def near_and_far(self, points: np.ndarray):
        """Per group of cells: the rows, their gaps to the means of cells that hold points, and the sizes of these. All
        groups together cover all other points of each row exactly once.

        On each level these are the children of the cells around the parent that do not touch the point's own cell, and
        on the finest one also those that do. The point itself is taken out of its own cell.
        """
        own = self.cells(points)
        around = np.array(list(itertools.product((-1, 0, 1), repeat=self.axes)))
        corners = np.array(list(itertools.product((0, 1), repeat=self.axes)))
        children = (2 * around[:, None, :] + corners[None, :, :]).reshape(-1, self.axes)
        for level in range(1, self.levels + 1):
            here, which = self._distinct(own >> (self.levels - level), level)
            cells = 2 * (here >> 1)[:, None, :] + children[None, :, :]
            apart = np.abs(cells - here[:, None, :]).max(axis=2) > 1
            rows, entry, mass, sums, _ = self._met(which, cells, apart, level)
            means = sums / mass[:, None]
            yield rows, _gaps(points, rows, means, entry), mass[entry]
        here, which = self._distinct(own, self.levels)
        cells = here[:, None, :] + around[None, :, :]
        rows, entry, mass, sums, middle = self._met(which, cells, np.ones(cells.shape[:2], dtype=bool), self.levels)
        means, mass = sums / mass[:, None], mass[entry]
        gaps = _gaps(points, rows, means, entry)
        # Cell sums are those before the steps of a round, so a point may have left its cell since.
        itself = np.flatnonzero(middle[entry])
        mass[itself] -= 1.0
        others = (sums[entry[itself]] - points[rows[itself]]) / np.maximum(mass[itself], 0.5)[:, None]
        gaps[itself] = points[rows[itself]] - others
        held = mass > 0.5
        yield (rows, gaps, mass) if held.all() else (rows[held], gaps[held], mass[held])

    def _distinct(self, cells: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The different cells of a level that points lie in, and which of them is whose: points of a cell meet the same cells."""
        shape = (1 << level,) * self.axes
        flat, which = np.unique(np.ravel_multi_index(tuple(cells.T), shape), return_inverse=True)
        return np.stack(np.unravel_index(flat, shape), axis=1), which

    def _met(self, which: np.ndarray, cells: np.ndarray, wanted: np.ndarray, level: int):
        """Row and entry of each meeting of a point with a cell that holds points; per entry the size and the sums of the cell,
        and whether it stands in the middle of its list."""
        side = 1 << level
        wanted = wanted & ((cells >= 0) & (cells < side)).all(axis=2)
        flat = np.ravel_multi_index(tuple(np.clip(cells, 0, side - 1).transpose(2, 0, 1)), (side,) * self.axes)
        mass, sums = self.mass[level].ravel(), self.sums[level].reshape(side**self.axes, -1)
        lists, places = np.nonzero(wanted & (mass[flat] > 0.5))
        flat = flat[lists, places]
        sizes = np.bincount(lists, minlength=len(cells))
        counts = sizes[which]
        rows = np.repeat(np.arange(len(which)), counts)
        shift = (np.cumsum(sizes) - sizes)[which] - (np.cumsum(counts) - counts)
        entry = np.arange(len(rows)) + np.repeat(shift, counts)
        return rows, entry, mass[flat], sums[flat], places == cells.shape[1] // 2

    def pair_sum(self) -> float:
        """Sum of ``1 / (1 + d2)`` over ordered pairs of points, taken between cell means."""
        mass = self.mass[-1].ravel()
        held = np.flatnonzero(mass)
        mass, means = mass[held], self.sums[-1].reshape(len(self.mass[-1].ravel()), -1)[held] / mass[held][:, None]
        total = 0.0
        for start in range(0, len(mass), 512):
            part = slice(start, start + 512)
            total += float((mass[part, None] * mass[None, :] / (1.0 + vectors.squared_distances(means[part], means))).sum())
        return total - float(mass.sum())


def _gaps(left: np.ndarray, rows: np.ndarray, right: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """``left[rows] - right[entry]``, one axis after the other in memory."""
    out = np.empty((left.shape[1], len(rows)))
    for axis in range(len(out)):
        np.subtract(left[:, axis].copy()[rows], right[:, axis].copy()[entry], out=out[axis])
    return out.T


def finest_cells(points: np.ndarray, axes: int, half: float, levels: int) -> np.ndarray:
    side = 1 << levels
    return np.clip(((points[:, :axes] + half) * (side / (2.0 * half))).astype(np.int64), 0, side - 1)


def _repulsion(method: str, points: np.ndarray, pyramid: Pyramid) -> np.ndarray:
    out = np.zeros_like(points)
    for start in range(0, len(points), CHUNK):
        part = slice(start, start + CHUNK)
        for rows, gap, mass in pyramid.near_and_far(points[part]):
            d2 = (gap * gap).sum(axis=1)
            if method == "TSNE":
                force = mass / (1.0 + d2) ** 2
            else:
                force = mass * 2.0 * CURVE_B / ((0.001 + d2) * (1.0 + CURVE_A * d2**CURVE_B))
                force = np.minimum(force, mass * 4.0 / np.sqrt(d2 + 1e-12))
            for axis in range(points.shape[1]):
                out[part, axis] += np.bincount(rows, force * gap[:, axis], len(out[part]))
    return out


def _pull(method: str, d2: np.ndarray) -> np.ndarray:
    """Attraction per unit of edge weight and of coordinate difference."""
    if method == "TSNE":
        return 1.0 / (1.0 + d2)
    d2 = np.maximum(d2, 1e-12)
    return 2.0 * CURVE_A * CURVE_B * d2 ** (CURVE_B - 1.0) / (1.0 + CURVE_A * d2**CURVE_B)


def _round(method: str, pyramid: Pyramid, n: int, first_step: int, steps: int, total_steps: int):
    """One block: its points, what others sent, and its edges, to moved points and what others need."""
    norm = max(pyramid.pair_sum(), 1e-9) if method == "TSNE" else 1.0

    def run(state: pa.Table, fixed: pa.Table) -> pa.Table:
        if state.num_rows == 0:
            return _STATE_ARROW.empty_table()
        state = state.sort_by([("kind", "ascending"), ("key", "ascending")]).combine_chunks()
        kind, key = state["kind"].to_numpy(), state["key"].to_numpy()
        at = vectors.as_matrix(state["at"].combine_chunks(), np.float64)
        mine = kind == OWN
        keys, points, degree = key[mine], at[mine], state["degree"].to_numpy()[mine]
        away, remote = key[kind == PLACE], at[kind == PLACE]
        sent = np.zeros_like(points)
        np.add.at(sent, np.searchsorted(keys, key[kind == FORCE]), at[kind == FORCE])
        block = state["block"][0].as_py()
        edges = {c: fixed[c][0].values.to_numpy(zero_copy_only=False) if fixed.num_rows else np.array([]) for c in ("src", "dst", "w", "home", "asked", "asks")}
        src = np.searchsorted(keys, edges["src"])
        inner = edges["home"] == block
        # Far ends stand behind the own points; in the first round nothing has been sent yet, and they do not pull.
        dst = np.where(inner, np.searchsorted(keys, edges["dst"]), len(keys) + np.searchsorted(away, edges["dst"]))
        met = inner if not len(away) else np.ones(len(src), dtype=bool)
        src, dst, w, inner_met = src[met].astype(int), dst[met].astype(int), edges["w"][met], inner[met]
        width = points.shape[1]
        inside, inside_dst = np.flatnonzero(inner_met), dst[inner_met]
        moved = np.zeros(len(points))
        for step in range(first_step, first_step + steps):
            cool = 1.0 - step / total_steps
            everywhere = np.concatenate((points, remote)) if len(remote) else points
            gap = _gaps(everywhere, dst, points, src)
            pull = (w * _pull(method, (gap * gap).sum(axis=1)))[:, None] * gap
            drawn = sent.copy()
            for axis in range(width):
                drawn[:, axis] += np.bincount(src, pull[:, axis], len(points))
                drawn[:, axis] -= np.bincount(inside_dst, pull[:, axis][inside], len(points))
            pushed = _repulsion(method, points, pyramid)
            if method == "TSNE":
                # Affinities of a point sum to about 1 / n, so that a step closes at most a third of a gap.
                early = EXAGGERATION if step < total_steps // 4 else 1.0
                move = n / 3.0 / EXAGGERATION * 4.0 * (early * drawn + pushed / norm) if step < total_steps // 4 else n * (drawn + pushed / norm)
            else:
                # Per unit of edge weight, so that a step does not carry a point past its neighbours, and with the expected
                # repulsion of NEGATIVES uniform samples.
                move = cool * (drawn / np.maximum(degree, 1e-12)[:, None] + NEGATIVES / n * pushed)
            length = np.sqrt((move * move).sum(axis=1))
            bound = MAX_STEP * pyramid.half * (0.2 + 0.8 * cool)
            move *= np.minimum(1.0, bound / np.maximum(length, 1e-12))[:, None]
            points = points + move
            moved += np.minimum(length, bound)
        out = [_rows(block, OWN, keys, points, degree)]
        if len(edges["asked"]):
            out.append(_rows(edges["asks"], PLACE, edges["asked"], points[np.searchsorted(keys, edges["asked"])]))
        outer = ~inner_met
        if outer.any():
            ends, where = np.unique(dst[outer] - len(keys), return_inverse=True)
            force = np.stack([np.bincount(where, -pull[outer, axis], len(ends)) for axis in range(width)], axis=1)
            homes = np.zeros(len(ends), dtype=np.int64)
            homes[where] = edges["home"][met][outer]
            out.append(_rows(homes, FORCE, away[ends], force))
        out.append(_cell_rows(block, points, moved / max(steps, 1), pyramid.levels))
        return pa.concat_tables(out)

    return run


def _rows(block, kind: int, keys: np.ndarray, at: np.ndarray, degree: np.ndarray | None = None) -> pa.Table:
    n, width = len(keys), at.shape[1]
    columns = [
        pa.array(np.broadcast_to(np.asarray(block, dtype=np.int32), n)),
        pa.array(np.full(n, kind, dtype=np.int32)),
        pa.array(np.asarray(keys, dtype=np.int64)),
        pa.array(np.zeros(n) if degree is None else degree),
        vectors.as_list_array(np.ascontiguousarray(at, dtype=np.float64).ravel(), np.full(n, width)),
    ]
    return pa.Table.from_arrays(columns, schema=_STATE_ARROW)


def _cell_rows(block: int, points: np.ndarray, moved: np.ndarray, levels: int) -> pa.Table:
    """Sums of one block over the finest cells, for the largest power of two as half width that holds its points."""
    half = 2.0 ** np.ceil(np.log2(max(float(np.abs(points).max()), 2.0**-10)))
    axes = min(points.shape[1], GRID_AXES)
    cells = np.ravel_multi_index(tuple(finest_cells(points, axes, half, levels).T), (1 << levels,) * axes)
    held, where = np.unique(cells, return_inverse=True)
    columns = [np.bincount(where), np.bincount(where, moved), np.full(len(held), half)]
    columns += [np.bincount(where, points[:, axis]) for axis in range(points.shape[1])]
    return _rows(block, CELL, held, np.stack(columns, axis=1).astype(float))


def _pyramid(state: DataFrame, width: int, levels: int) -> tuple[Pyramid, float]:
    """The pyramid over all blocks, and the mean movement of a point.

    Blocks with a smaller box than the largest one have finer cells; these fall into the cells of the largest.
    """
    values = [F.sum(F.col("at")[i]).alias(f"v{i}") for i in range(width + 3) if i != 2]
    sums = state.filter(F.col("kind") == CELL).groupBy("key", F.col("at")[2].alias("half")).agg(*values).collect()
    axes = min(width, GRID_AXES)
    side = 1 << levels
    half = max(r["half"] for r in sums)
    mass, total, moved = np.zeros(side**axes), np.zeros((side**axes, width)), 0.0
    boxes = np.array([r["half"] for r in sums])
    index = np.stack(np.unravel_index(np.array([r["key"] for r in sums]), (side,) * axes), axis=1)
    middle = ((index + 0.5) * (2.0 / side) - 1.0) * boxes[:, None]
    cell = np.ravel_multi_index(tuple(finest_cells(middle, axes, half, levels).T), (side,) * axes)
    np.add.at(mass, cell, [r["v0"] for r in sums])
    np.add.at(total, cell, [[r[f"v{3 + i}"] for i in range(width)] for r in sums])
    moved = sum(r["v1"] for r in sums)
    return Pyramid(mass, total, half, levels), moved / max(mass.sum(), 1.0)


def _start_cells(levels: int):
    """Own rows as they stand, with the cell sums of each block."""

    def run(state: pa.Table) -> pa.Table:
        points = vectors.as_matrix(state["at"].combine_chunks(), np.float64)
        rows = state.select(_STATE_ARROW.names).cast(_STATE_ARROW)
        return pa.concat_tables([rows, _cell_rows(state["block"][0].as_py(), points, np.full(len(points), np.inf), levels)])

    return run


def _fixed_parts(edges: DataFrame, homes: DataFrame) -> DataFrame:
    """One row per block: the edges it owns, and which blocks ask for which of its points.

    An edge belongs to the end with fewer edges. A point with very many edges so owns few of them; the forces of the
    others arrive added up, one row from each block.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("edges"))
    known = cut_lineage(homes.join(ends, "key"))
    for end in ("src", "dst"):
        edges = edges.join(known.select(F.col("key").alias(end), F.col("block").alias(f"{end}_block"), F.col("edges").alias(f"{end}_edges")), end)
    turned = (F.col("dst_edges") < F.col("src_edges")) | ((F.col("dst_edges") == F.col("src_edges")) & (F.col("dst") < F.col("src")))
    owned = cut_lineage(
        edges.select(
            F.when(turned, F.col("dst_block")).otherwise(F.col("src_block")).alias("block"),
            F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"),
            F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"),
            F.when(turned, F.col("src_block")).otherwise(F.col("dst_block")).alias("home"),
            "w",
        )
    )
    lists = owned.groupBy("block").agg(F.collect_list(F.struct("src", "dst", "w", "home")).alias("e"))
    asks = owned.filter(F.col("home") != F.col("block")).select(F.col("home").alias("block"), F.col("dst").alias("asked"), F.col("block").alias("asks")).distinct()
    asks = asks.groupBy("block").agg(F.collect_list(F.struct("asked", "asks")).alias("a"))
    return lists.join(asks, "block", "full").select("block", "e.src", "e.dst", "e.w", "e.home", "a.asked", "a.asks").select(
        "block", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in _FIXED.items()]
    )


_FIXED = {"src": "array<long>", "dst": "array<long>", "w": "array<double>", "home": "array<int>", "asked": "array<long>", "asks": "array<int>"}


def graph_neighbours(method: str, n: int) -> int:
    """Neighbours of each row that a layout of ``n`` rows is drawn from."""
    return neighbours.umap_neighbours(n) if method.upper() == "UMAP" else min(n - 1, 3 * neighbours.tsne_perplexity(n))


def _graph(rows: DataFrame, graph: str | DataFrame, k: int, vec_col: str, block_rows: int, seed: int, normalize: bool) -> DataFrame:
    if isinstance(graph, DataFrame):
        return graph.filter(F.col("rank") <= k)
    if graph == "exact":
        return neighbours.knn_graph(rows, k, "key", vec_col, block_rows, seed, normalize)
    return descent.knn_descent(rows, k, "key", vec_col, seed=seed, normalize=normalize)


def neighbour_layout(
    df: DataFrame,
    method: str = "UMAP",
    id_col: str = "uuid",
    vec_col: str = "emb",
    iterations: int = ITERATIONS,
    seed: int = 0,
    block_rows: int = neighbours.BLOCK_ROWS,
    normalize: bool = True,
    names: list[str] | tuple[str, ...] = ("x", "y"),
    graph: str | DataFrame = "exact",
    key_col: str | None = None,
    layout_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(id, *names)``, one coordinate per name and one row per row given. Starts from principal component scores.

    ``graph`` is ``exact``, or ``refined`` for tables too large to compare all cells, or a graph of the rows by ``key_col``, as
    of :func:`neighbours.knn_graph` with :func:`graph_neighbours` or more, for several layouts of the same rows. At most ``iterations`` rounds of
    ``STEPS`` steps are run, fewer if the points hardly move any more. With ``key_col``, a long column without repeats
    that does not change between uses, the result is ``(key, *names)``; otherwise rows get such a key here, and ids may
    repeat or be null.
    """
    method = method.upper()
    if method not in ("UMAP", "TSNE"):
        raise ValueError(f"unsupported layout {method!r}, choose UMAP or TSNE")
    if isinstance(graph, DataFrame):
        if key_col is None:
            raise ValueError("a graph that is given needs the key column of its rows")
    elif graph not in ("exact", "refined"):
        raise ValueError(f"unsupported graph {graph!r}, choose exact or refined")
    if key_col is None:
        rows = with_row_key(df.select(quoted(id_col).alias("id"), quoted(vec_col).alias("v")), "key")
    else:
        rows = df.select(quoted(key_col).alias("id"), quoted(vec_col).alias("v"), quoted(key_col).alias("key"))
    width = len(names)
    axes = [f"__p{i}" for i in range(width)]
    scores = pca(rows, width, "v", normalize).project(rows, axes).select("key", *axes)
    sizes = [F.abs(c) for c in axes]
    n, reach = scores.agg(F.count(F.lit(1)), F.max(F.greatest(*sizes) if width > 1 else sizes[0])).first()
    reach = reach or 1.0
    # Copies of a vector start a little apart; the shift depends on the key only.
    start = [
        F.col(c) / F.lit(reach) * HALF_WIDTH + (F.pmod(F.xxhash64("key", F.lit(seed), F.lit(i)), F.lit(1_000_003)) / 1_000_003.0 - 0.5) * 1e-3
        for i, c in enumerate(axes)
    ]
    blocks = max(1, -(-n // layout_rows))
    scores = scores.select("key", F.array(*start).alias("at"))
    dealt = scores.repartitionByRange(blocks, F.col("at")[0], "key").withColumn("block", F.spark_partition_id())
    places = cut_lineage(dealt)
    if n < 3:
        return _named(places, rows, id_col if key_col is None else key_col, names)
    found = _graph(rows, graph, graph_neighbours(method, n), "v", block_rows, seed, normalize)
    if method == "UMAP":
        weighted = neighbours.fuzzy_weights(found).withColumnRenamed("w", "weight")
    else:
        weighted = neighbours.perplexity_affinities(found, n, neighbours.tsne_perplexity(n)).withColumnRenamed("p", "weight")
    # Each unordered pair once; its force acts on both ends.
    edges = cut_lineage(weighted.filter(F.col("src") < F.col("dst")).select("src", "dst", F.col("weight").alias("w")))
    ends = F.explode(F.array(F.struct(F.col("src").alias("key"), "w"), F.struct(F.col("dst").alias("key"), "w"))).alias("e")
    degrees = edges.select(ends).groupBy("e.key").agg(F.sum("e.w").alias("degree"))
    fixed = cut_lineage(_fixed_parts(edges, places.select("key", "block")).repartition(blocks, "block"))
    levels = levels_for(width)
    state = places.join(degrees, "key", "left").select("block", F.lit(OWN).alias("kind"), "key", F.coalesce("degree", F.lit(0.0)).alias("degree"), "at")
    state = cut_lineage(state.repartition(blocks, "block").groupBy("block").applyInArrow(_start_cells(levels), _STATE))
    total = iterations * STEPS
    for turn in range(iterations):
        pyramid, moved = _pyramid(state, width, levels)
        # Early rounds of t-SNE pull harder; they do not end the layout.
        if turn > iterations // 4 and moved < TOLERANCE * pyramid.half:
            break
        held = state.filter(F.col("kind") != CELL).select(F.col("block").alias("of"), "block", "kind", "key", "degree", "at")
        step = _round(method, pyramid, n, turn * STEPS, STEPS, total)
        met = held.repartition(blocks, "of").groupBy("of").cogroup(fixed.groupBy("block"))
        state = cut_lineage(met.applyInArrow(step, _STATE))
    return _named(state.filter(F.col("kind") == OWN), rows, id_col if key_col is None else key_col, names)


def _named(places: DataFrame, rows: DataFrame, name: str, axes: list[str] | tuple[str, ...]) -> DataFrame:
    """Coordinates under the names asked for, and the id of each row."""
    points: list[Column] = [F.col("at")[i].alias(axis) for i, axis in enumerate(axes)]
    return rows.select("key", F.col("id").alias(name)).join(places.select("key", *points), "key").drop("key") if name != "key" else places.select("key", *points)
