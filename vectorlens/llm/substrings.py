"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: the least of the 8-word hashes that start within a 20-word window, the leftmost one on a
tie. Equal windows choose the same anchor at the same place, so every repeat of ``WINDOW`` words or more meets at the
anchor of each of its windows. The windows that share one anchor follow each other: an occurrence of the anchor
extends to the left and to the right as far as those windows reach, and the words of that reach are its context.

1. Occurrences meet by anchor. Those whose whole context occurs earlier are repeats in full length.
2. Of each context the first occurrence is left. Where an anchor has several contexts, as at the edge of a shared
   passage, these are extended window by window: their windows meet by content, and all but the first are repeats.
3. The repeats of a document are joined into maximal covered stretches, and the words outside are kept.

A frequent anchor goes to step 2 at once, keyed by the content of each window, so that the many different contexts at
the edge of a very common line do not meet in one task. Copies of a context inside a piece of input never leave it.
Words, order and comparison use 64-bit hashes of words and of word sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorlens.llm.tables import kept
from vectorlens.llm.words import Words, find_words, mixed, pieces, ranges, rolling

WINDOW, SEED = 20, 8
# Occurrences that one task takes.
ROWS_PER_TASK = 500_000
# Frequent anchors held by every task: at most so many, 8 bytes each. Which ones they are changes cost, not results.
FREQUENT_ANCHORS = 65_536
FREQUENT_IN_TASK, FREQUENT_IN_ALL = 8, 2_000
# Different anchors that a task counts before it passes the frequent ones on.
COUNTED = 2_000_000
LAST = (1 << 63) - 1

_UNITS = "key long, ctx long, doc long, tag int, start int, n int"
_FIELDS = ["key", "ctx", "doc", "tag", "start", "n"]


def anchor_units(found: Words) -> tuple[np.ndarray, ...]:
    """Runs of windows with a common anchor: ``(row, start in row, number of windows, anchor hash, context hash,
    window hashes)``; the window hashes are for all positions of the piece, by absolute word position."""
    hashes = found.hashes()
    counts = found.counts
    windows = np.maximum(counts - WINDOW + 1, 0)
    at = ranges(found.rows[:-1], windows)
    none = np.empty(0, dtype=np.int64)
    if len(at) == 0:
        return none, none, none, np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    grams, whole = rolling(hashes, SEED), rolling(hashes, WINDOW)
    best, place = grams[at], at.copy()
    for j in range(1, WINDOW - SEED + 1):
        other = grams[at + j]
        better = other < best
        best[better] = other[better]
        place[better] = at[better] + j
    row = np.repeat(np.arange(len(counts)), windows)
    fresh = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (row[1:] != row[:-1]))))
    size = np.diff(np.concatenate((fresh, [len(at)])))
    first = at[fresh]
    context = mixed(mixed(whole[first]) + whole[first + size - 1] + size.astype(np.uint64))
    return row[fresh], first - found.rows[row[fresh]], size, best[fresh], context, whole


def _columns(key, ctx, doc, tag, start, n) -> pa.RecordBatch:
    kinds = [np.int64, np.int64, np.int64, np.int32, np.int32, np.int32]
    values = [np.ascontiguousarray(v).view(np.int64) if v.dtype == np.uint64 else v.astype(k) for v, k in zip((key, ctx, doc, tag, start, n), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(v) for v in values], _FIELDS)


def _identified(docs: DataFrame) -> DataFrame:
    """``doc`` orders documents (a null id last), ``tag`` tells texts apart that repeat an id."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
        F.hash("text").alias("tag"),
        "text",
    )


def _frequent(docs: DataFrame) -> np.ndarray:
    def often(keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
        chosen = n >= FREQUENT_IN_TASK
        return pa.RecordBatch.from_arrays([pa.array(key[chosen].view(np.int64)), pa.array(n[chosen])], ["key", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counted over all pieces of a task: pieces of small partitions may hold a common line a few times each.
        keys, counts, held = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)], 0
        for batch in batches:
            for piece in pieces(batch):
                anchors, n = np.unique(anchor_units(find_words(piece.column("text")))[3], return_counts=True)
                keys.append(anchors)
                counts.append(n)
                held += len(anchors)
                if held > COUNTED:
                    yield often(keys, counts)
                    keys, counts, held = keys[:1], counts[:1], 0
        yield often(keys, counts)

    seen = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = seen.filter(F.col("n") >= FREQUENT_IN_ALL).orderBy(F.desc("n"), "key").limit(FREQUENT_ANCHORS).collect()
    return np.sort(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))


def _units(docs: DataFrame) -> DataFrame:
    """Occurrences to be compared, of each piece only the first and the repeats found on the spot (key null)."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value
        for batch in batches:
            for piece in pieces(batch):
                found = find_words(piece.column("text"))
                row, start, n, anchor, context, whole = anchor_units(found)
                if len(row) == 0:
                    continue
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
                    apart = hot[at] == anchor
                    if apart.any():
                        each = ranges(start[apart], n[apart])
                        of = np.repeat(row[apart], n[apart])
                        content = whole[found.rows[of] + each]
                        stay = ~apart
                        row, start = np.concatenate((row[stay], of)), np.concatenate((start[stay], each))
                        n = np.concatenate((n[stay], np.ones(len(of), dtype=np.int64)))
                        anchor, context = np.concatenate((anchor[stay], content)), np.concatenate((context[stay], content))
                doc, tag = (piece.column(c).to_numpy()[row] for c in ("doc", "tag"))
                order = np.lexsort((start, doc, context, anchor))
                batch_out = [v[order] for v in (anchor, context, doc, tag, start, n)]
                a, c, d, _, s, _ = batch_out
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
                head = np.flatnonzero(new)[np.cumsum(new) - 1]
                keep = new | ((d == d[head]) & (s == s[head]))
                yield _columns(*[v[keep] for v in batch_out])
                yield _nameless(_columns(*[v[~keep] for v in batch_out]))

    return docs.select("doc", "tag", "text").mapInArrow(run, _UNITS)


def _meeting(taken: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all units of some keys: repeats (key null), and first occurrences of contexts whose key has others."""
    if not sum(batch.num_rows for batch in taken):
        return
    columns = []
    for c in range(len(_FIELDS)):
        columns.append(np.concatenate([batch.column(c).to_numpy() for batch in taken]))
    taken.clear()
    key, ctx, doc, tag, start, n = columns
    order = np.lexsort((start, doc, ctx, key))
    # One column after the other, so that no two whole sets of columns exist at once.
    for c in range(len(columns)):
        columns[c] = columns[c][order]
    key, ctx, doc, tag, start, n = columns
    new_key = np.concatenate(([True], key[1:] != key[:-1]))
    new = new_key | np.concatenate(([True], ctx[1:] != ctx[:-1]))
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    repeat = (doc != doc[head]) | (start != start[head])
    contexts = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))
    several = contexts[np.cumsum(new_key) - 1] > 1
    yield _nameless(_columns(*[v[repeat] for v in (key, ctx, doc, tag, start, n)]))
    yield _columns(*[v[~repeat & several] for v in (key, ctx, doc, tag, start, n)])


def _nameless(units: pa.RecordBatch) -> pa.RecordBatch:
    gone = pa.nulls(units.num_rows, pa.int64())
    return pa.RecordBatch.from_arrays([gone, gone, *units.columns[2:]], _FIELDS)


def _meet(units: DataFrame, parts: int) -> DataFrame:
    """Units meet by key in tasks of about ``ROWS_PER_TASK``. Repeats known already (key null) are passed on; they
    share the pass over the texts and are spread by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = []
        for batch in batches:
            batch = batch.select(_FIELDS)
            known = pc.is_null(batch.column("key"))
            # What is kept is copied out of the batch, which can then be given back.
            yield batch.filter(known)
            taken.append(batch.filter(pc.invert(known)))
        yield from _meeting(taken)

    spot = F.when(F.col("key").isNull(), F.xxhash64("doc", "start")).otherwise(F.col("key"))
    return units.withColumn("spot", spot).repartition(parts, "spot").mapInArrow(run, _UNITS)


def _stretches(units: DataFrame) -> DataFrame:
    """The stretches of each document in one row; their number is bounded by the document's words."""
    return units.groupBy(F.col("doc").alias("d"), F.col("tag").alias("t")).agg(F.collect_list(F.struct("start", "n")).alias("stretches"))


def _found_again(docs: DataFrame, stretches: DataFrame, how: str) -> DataFrame:
    return docs.join(stretches, (F.col("doc") == F.col("d")) & (F.col("tag") == F.col("t")), how)


def _windows(docs: DataFrame, units: DataFrame) -> DataFrame:
    """One unit for each window of the given units, keyed by its content."""
    texts = _found_again(docs, _stretches(units), "inner").select("doc", "tag", "stretches", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                found = find_words(piece.column("text"))
                whole = rolling(found.hashes(), WINDOW)
                lists = piece.column("stretches")
                counts = lists.value_lengths().to_numpy()
                flat = lists.flatten()
                start, n = (flat.field(c).to_numpy().astype(np.int64) for c in ("start", "n"))
                row = np.repeat(np.repeat(np.arange(piece.num_rows), counts), n)
                each = ranges(start, n)
                content = whole[found.rows[row] + each]
                doc, tag = (piece.column(c).to_numpy()[row] for c in ("doc", "tag"))
                yield _columns(content, content, doc, tag, each, np.ones(len(each), dtype=np.int64))

    return texts.mapInArrow(run, _UNITS)


def repeats(docs: DataFrame) -> DataFrame:
    """``(doc, tag, start, n)``: runs of ``n`` windows from word ``start`` that all occur earlier."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # An anchor stands for some 35 bytes of text.
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).first()[0] or 0
    met = kept(_meet(_units(docs), max(least, -(-size // (ROWS_PER_TASK * 35)))), "anchors")
    firsts = met.filter("key is not null")
    n_windows = firsts.agg(F.sum("n")).first()[0] or 0
    again = _meet(_windows(docs, firsts), max(least, -(-n_windows // ROWS_PER_TASK))).filter("key is null")
    return met.filter("key is null").unionByName(again).select("doc", "tag", "start", "n")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text.

    Words are taken unchanged from the whole text. A word goes if a window of ``WINDOW`` words around it starts
    earlier too: in a document with a smaller id, or earlier in its own. Null ids come last. Rows that repeat an id
    count as one document: a window at the same place in both is not earlier than itself. A null text has no words and
    gives an empty kept text, as does a text of which nothing is left. Other columns are ignored.
    """
    docs = _identified(docs)
    joined = _found_again(docs, _stretches(repeats(docs)), "left").select("doc_id", "stretches", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                found = find_words(piece.column("text"))
                lists = piece.column("stretches")
                flat = lists.flatten()
                start, n = (flat.field(c).to_numpy().astype(np.int64) for c in ("start", "n"))
                row = np.repeat(np.arange(piece.num_rows), lists.value_lengths().fill_null(0).to_numpy())
                # Covered words: each run reaches WINDOW - 1 words beyond its last window.
                depth = np.zeros(len(found.starts) + 1, dtype=np.int64)
                first = found.rows[row] + start
                np.add.at(depth, first, 1)
                np.add.at(depth, first + n + WINDOW - 1, -1)
                keep = np.cumsum(depth[:-1]) == 0
                counts = found.counts
                total = np.concatenate(([0], np.cumsum(keep)))
                left = np.diff(total[found.rows])
                texts = kept_texts(found, keep)
                columns = [piece.column("doc_id"), pa.array(counts), pa.array(counts - left), texts]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def kept_texts(found: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    data = found.data.copy()
    starts, ends = found.starts[keep], found.ends[keep]
    total = np.concatenate(([0], np.cumsum(keep)))[found.rows]
    step = np.zeros(len(data) + 1, dtype=np.int8)
    step[starts] += 1
    step[ends] -= 1
    stay = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    leads = np.ones(len(starts), dtype=bool)
    leads[total[:-1][np.diff(total) > 0]] = False
    # A kept word that is not the first of its row has a separator before it, which becomes the joining space.
    data[starts[leads] - 1] = 32
    stay[starts[leads] - 1] = True
    lengths = np.concatenate(([0], np.cumsum((ends - starts) + leads)))
    offsets = lengths[total].astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data[stay]))


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of :func:`deduplicated`."""
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
