"""Product codes of vectors in whole numbers: four parts, each named by one entry of a codebook.

Components become ``floor(1024 x)``. Nearest entries are found through an integer Walsh-Hadamard transform: parts and
entries are padded with zeros to a power of two ``P``, and with rows ordered by their number of sign changes,
``P |x - e|^2`` is the sum of the squared differences of the transforms. The sum grows coefficient by coefficient, so an
entry whose sum already exceeds the whole of another one is out. All numbers are 64-bit integers; nothing is rounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorlens.llm.tables import kept

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
# Labels with more than this share of all rows meet their sum by broadcast; there can be no more than its inverse.
HEAVY_SHARE = 1 / 1000
# Differences held at once while entries are compared.
CELLS = 1 << 21


def sequency(size: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, rows by ascending number of sign changes."""
    matrix = np.ones((1, 1), dtype=np.int64)
    while len(matrix) < size:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return matrix[np.argsort((np.diff(matrix, axis=1) != 0).sum(axis=1), kind="stable")]


def transformed(parts: np.ndarray) -> np.ndarray:
    """Rows of whole numbers, padded with zeros and transformed by the fast butterfly, in sequency order."""
    rows, width = parts.shape
    size = 1 << max(width - 1, 0).bit_length()
    out = np.zeros((rows, size), dtype=np.int64)
    out[:, :width] = parts
    step = 1
    while step < size:
        pairs = out.reshape(rows, -1, 2, step)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(rows, size)
        step *= 2
    # The butterfly leaves rows in natural order; the order by sign changes is that of the matrix built the same way.
    return out[:, _order(size)]


def _order(size: int) -> np.ndarray:
    """Natural index of each sequency: its Gray code with the bits reversed."""
    bits = size.bit_length() - 1
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    return sum(((gray >> b) & 1) << (bits - 1 - b) for b in range(bits)) if bits else np.zeros(1, dtype=np.int64)


def largest_component(part_width: int) -> int:
    """Components up to this size keep ``P |x - e|^2`` within 62 bits: ``P * P * (2 m)^2 <= 2^62``."""
    size = 1 << max(part_width - 1, 0).bit_length()
    return (1 << 30) // size


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest entry of every part, ties to the lower index.

    The third value counts the squared differences that were taken, against ``rows * entries * P`` without elimination.
    """
    book = transformed(entries)
    size = book.shape[1]
    best, error, taken = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=np.int64), 0
    block = max(1, CELLS // max(len(book), 1))
    for start in range(0, len(parts), block):
        points = transformed(parts[start : start + block])
        rows = np.repeat(np.arange(len(points)), len(book))
        cols = np.tile(np.arange(len(book)), len(points))
        sums, done, step = np.zeros(len(rows), dtype=np.int64), 0, 1
        while done < size:
            upto = min(done + step, size)
            for k in range(done, upto):
                gap = points[rows, k] - book[cols, k]
                sums += gap * gap
            taken += len(rows) * (upto - done)
            done, step = upto, min(2 * step, 8)
            if done == size:
                break
            # The whole sum of each row's leader so far bounds what may still win; equal sums stay in.
            lead = _leaders(rows, cols, sums, len(points))
            gaps = points[:, done:] - book[lead[1], done:]
            bound = lead[0] + (gaps * gaps).sum(axis=1)
            taken += gaps.size
            alive = sums <= bound[rows]
            rows, cols, sums = rows[alive], cols[alive], sums[alive]
        value, index = _leaders(rows, cols, sums, len(points))
        best[start : start + block], error[start : start + block] = index, value // size
    return best, error, taken


def _leaders(rows: np.ndarray, cols: np.ndarray, sums: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the least sum and the lowest column that has it. ``rows`` ascend, and columns ascend inside a row."""
    starts = np.searchsorted(rows, np.arange(n))
    least = np.minimum.reduceat(sums, starts)
    first = np.where(sums == least[rows], cols, np.iinfo(np.int64).max)
    return least, np.minimum.reduceat(first, starts)


def whole_numbers(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part (mask), and their components as whole numbers."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fits = lengths == width
    chosen = vectors.filter(pa.array(fits))
    values = chosen.flatten()
    finite = np.nan_to_num(values.to_numpy(zero_copy_only=False).astype(np.float64), nan=np.nan, posinf=np.nan, neginf=np.nan)
    if values.null_count:
        finite[values.is_null().to_numpy(zero_copy_only=False)] = np.nan
    scaled = np.floor(finite * SCALE).reshape(int(fits.sum()), width) if width else np.zeros((int(fits.sum()), 0))
    limit = largest_component(-(-width // PARTS))
    good = (np.abs(scaled) <= limit).all(axis=1)
    mask = fits.copy()
    mask[fits] = good
    return mask, scaled[good].astype(np.int64)


def split(rows: np.ndarray) -> np.ndarray:
    """``PARTS`` equal consecutive parts of each row, by part; a width that does not divide is filled up with zeros."""
    n, width = rows.shape
    part = -(-width // PARTS)
    out = np.zeros((n, part * PARTS), dtype=np.int64)
    out[:, :width] = rows
    return out.reshape(n, PARTS, part).swapaxes(0, 1)


def _sums(books: np.ndarray, width: int):
    """Per task and codebook entry: how many parts it is nearest to, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(books.shape[:2], dtype=np.int64), np.zeros_like(books)
        for batch in batches:
            _, rows = whole_numbers(batch.column(0), width)
            for p, part in enumerate(split(rows)):
                near, _, _ = nearest_entries(part, books[p])
                np.add.at(counts[p], near, 1)
                np.add.at(total[p], near, part)
        p, e = np.nonzero(counts)
        if len(p):
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * books.shape[2]), pa.array(total[p, e].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), sums], ["part", "entry", "n", "sums"])

    return run


def sizes(vectors: DataFrame) -> DataFrame:
    """``(vec_id, width, largest)`` of the vectors without null or non-finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            widths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            values = np.abs(np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE))
            ends = np.cumsum(np.maximum(widths, 0))
            # An empty vector has no component; the value put in its place is taken back below.
            largest = np.maximum.reduceat(np.append(values, 0.0), ends - np.maximum(widths, 0)) if len(widths) else np.empty(0)
            largest[widths == 0] = 0.0
            good = (widths >= 0) & np.isfinite(largest)
            ids = batch.column(0).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([ids, pa.array(widths[good], pa.int32()), pa.array(largest[good])], ["vec_id", "width", "largest"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, width int, largest double")


def vector_width(vectors: DataFrame) -> int:
    """Width of the vector with the smallest id (among equals the smallest width); -1 if there is none."""
    row = sizes(vectors).orderBy(F.col("vec_id").asc_nulls_last(), "width").first()
    return -1 if row is None else row["width"]


def first_vectors(vectors: DataFrame, width: int, n: int) -> np.ndarray:
    """The vectors with the ``n`` smallest ids as whole numbers; equal ids are ordered by their vectors.

    The ids are found first, so only ids travel from all tasks. Rows up to the largest of them are then cut to ``n``
    in every task and every bucket: a small id may repeat any number of times.
    """
    from pyspark.sql import Window

    fits = sizes(vectors).filter((F.col("width") == width) & (F.col("largest") <= largest_component(-(-width // PARTS))))
    ids = [r[0] for r in fits.select("vec_id").orderBy(F.col("vec_id").asc_nulls_last()).limit(n).collect()]
    if not ids:
        return np.zeros((0, width), dtype=np.int64)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    if ids[-1] is not None:
        rows = rows.filter(F.col("vec_id") <= ids[-1])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(whole_numbers(batch.column(1), width)[0]))

    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    held = rows.mapInArrow(take, "vec_id long, embedding array<double>")
    bucket = F.pmod(F.xxhash64("embedding"), F.lit(16))
    cut = held.withColumn("rank", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).filter(F.col("rank") <= n)
    found = cut.orderBy(*order).limit(n).select("embedding").toArrow().column(0).combine_chunks()
    return whole_numbers(found, width)[1]


def fit_codebooks(vectors: DataFrame, width: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray:
    """``PARTS`` codebooks of at most ``entries`` entries; the driver holds these and one row for each component of them."""
    books = split(first_vectors(vectors, width, entries))
    rows = vectors.select(F.col("embedding").cast("array<double>").alias("embedding"))
    start = books.shape[1]
    for _ in range(rounds if start else 0):
        partial = rows.mapInArrow(_sums(books, width), "part int, entry int, n long, sums array<long>")
        spread = partial.select("part", "entry", "n", F.posexplode("sums").alias("pos", "s"))
        merged = spread.groupBy("part", "entry", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        books = books.copy()
        for part, entry, pos, s, n in merged.collect():  # one row for each component of a codebook
            books[part, entry, pos] = s // n
    return books


def codebooks_hash(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """``(vec_id, label, code, error, taken)`` of every vector that takes part.

    ``taken`` is the share of the squared differences that the search of the row's batch could not avoid.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, rows = whole_numbers(batch.column("embedding"), width)
            if not len(rows):
                continue
            codes, error, taken = np.zeros((len(rows), PARTS), dtype=np.uint8), np.zeros(len(rows), dtype=np.int64), 0
            for p, part in enumerate(split(rows)):
                near, distance, cost = nearest_entries(part, books[p])
                codes[:, p], taken = near, taken + cost
                error += distance
            size = transformed(books[0][:1]).shape[1]
            share = taken / (len(rows) * PARTS * books.shape[1] * size)
            names = [c.tobytes().hex() for c in codes]
            given = batch.filter(pa.array(mask))
            yield pa.RecordBatch.from_arrays(
                [given.column("vec_id"), given.column("label"), pa.array(names), pa.array(error), pa.array(np.full(len(rows), share))],
                ["vec_id", "label", "code", "error", "taken"],
            )

    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {label}, code string, error long, taken double")


def code_report(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per vector that takes part: vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null, or hold null or non-finite components, take no part; nor do those of another width than the
    vector with the smallest id, and those with components beyond 2**30 / P in whole numbers, whose squares do not fit
    64 bits (65,536 and more for parts of 16). A width that four does not divide is filled up with zeros. Null ids come
    last, repeated ids are rows of their own. With fewer vectors than entries the codebooks are smaller. An empty table
    gives no row. Columns besides vec_id, embedding and label are not read.

    Errors are summed per label before they meet the rows again, those of labels with many rows by broadcast.
    """
    width = vector_width(vectors)
    if width < 0:
        schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], schema)
    books = fit_codebooks(vectors, width, rounds)
    coded = kept(encode(vectors, books, width), "codes")
    totals = kept(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    many = (totals.agg(F.sum("n")).first()[0] or 0) * HEAVY_SHARE
    sums = totals.select(F.col("label").alias("of"), "label_error", (F.col("n") > many).alias("heavy"))
    same = F.col("label").eqNullSafe(F.col("of"))
    heavy = F.broadcast(sums.filter("heavy"))
    joined = coded.join(heavy, same).unionByName(coded.join(heavy, same, "left_anti").join(sums.filter("not heavy"), same))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_hash(books)).alias("codebooks_sha256"))
