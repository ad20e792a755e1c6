"""Language-model scores from a Brown class-based bigram model that is trained on the documents themselves.

Every word belongs to one class. The probability of a word is that of its class after the class of the word before,
times that of the word in its class. Classes come from exchange clustering: a word moves to the class with which the
likelihood of the class bigrams is largest.

Exchange runs in rounds over the ``CONTEXT`` most frequent words, whose bigrams are counted over all training texts;
that table is bounded by their number squared. A round decides for every second word at once, from the counts of the
round before. A round that lowers the likelihood is not taken, and fewer words move at once from then on. All other words, however many,
then enter the class that gains most from them, given their neighbours' classes over all training texts.

Texts are read piece by piece. Each piece sends every word that it holds once, with its count and neighbours, to the
bucket of the word, where its counts of all pieces meet; the class and the count go back to the piece. No vocabulary is
held whole anywhere. Pieces are those of one written table, so a repeated task finds them as they were.

Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorlens.llm.tables import kept
from vectorlens.llm.words import find_words, mixed, pieces
from vectorlens.session import fresh_path

# Words whose classes are found in rounds of exchange, the end of a text among them.
CONTEXT = 4096
CLASSES = 64
ROUNDS = 16
# Different words whose counts a task holds before it passes them on.
WORDS_HELD = 1_000_000
# Words of pieces that meet in one bucket, on average.
WORDS_PER_BUCKET = 500_000
# Tokens of documents in one row of the encoded pieces; a longer document has a row of its own.
TOKENS_PER_ROW = 1 << 17
# Pairs that a task holds before it passes them on.
PAIRS_HELD = 4_000_000
# Neighbours by plain class frequency that every class has when words enter it.
PRIOR = 100.0
# Sums of a bucket that are taken at once.
CHUNK = 50_000
# Class of a word that training has not seen.
UNKNOWN = 255

END = np.uint64(0)
# Fixed places: the end of a text is word 0 and class 0; words outside the context count as one word of class 1.
END_CLASS, REST_CLASS = 0, 1


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of known types as one compressed value."""
    lengths = np.array([a.nbytes for a in arrays], dtype=np.int64)
    raw = b"".join([lengths.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(value: bytes, *types: str) -> list[np.ndarray]:
    raw = pa.decompress(value[8:], int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True)
    lengths, at, out = np.frombuffer(raw, np.int64, len(types)), 8 * len(types), []
    for size, kind in zip(lengths.tolist(), types, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def tokens_of(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts with an end after each text, and the number of tokens of each row."""
    found = find_words(piece.column("text"), fold=True)
    rows = np.repeat(np.arange(piece.num_rows), found.counts)
    tokens = np.full(len(rows) + piece.num_rows, END, dtype=np.uint64)
    tokens[np.arange(len(rows)) + rows] = found.hashes()
    return tokens, found.counts + 1


def training_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, held)``; a null id is learned from."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held"))


def _learned(piece: pa.RecordBatch, counts: np.ndarray) -> np.ndarray:
    return np.repeat(~piece.column("held").to_numpy(zero_copy_only=False), counts)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every word with its count, summed over the pieces of a task, and under a null word how many different words each piece holds."""

    def batch_of(words: np.ndarray, n: np.ndarray, different: int) -> pa.RecordBatch:
        names = pa.array(np.append(words.view(np.int64), 0), mask=np.append(np.zeros(len(words), bool), True))
        return pa.RecordBatch.from_arrays([names, pa.array(np.append(n, different))], ["word", "n"])

    words, counts, different = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), 0
    for batch in batches:
        for piece in pieces(batch):
            tokens, lengths = tokens_of(piece)
            learned = tokens[_learned(piece, lengths)]
            found, n = np.unique(learned[learned != END], return_counts=True)
            different += len(np.unique(tokens))
            words, where = np.unique(np.concatenate((words, found)), return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate((counts, n)), minlength=len(words)).astype(np.int64)
            if len(words) > WORDS_HELD:
                yield batch_of(words, counts, different)
                words, counts, different = words[:0], counts[:0], 0
    yield batch_of(words, counts, different)


def context_words(rows: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Hashes of the context, the end of a text first and the others by falling count; and all words of all pieces.

    Every word of the training texts is counted, so these are the most frequent ones. The others are not left out: their
    counts meet in buckets, and each enters the class that gains most from it (:func:`_classify`).
    """
    found = kept(rows.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    total = found.filter("word IS NULL").agg(F.sum("n")).first()[0] or 0
    words = found.filter("word IS NOT NULL").orderBy(F.col("n").desc(), "word").limit(size - 1).collect()
    return np.array([END, *[np.int64(r["word"]).view(np.uint64) for r in words]], dtype=np.uint64), total


def places(words: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Place of each word in the context, ``len(context)`` outside it."""
    order = np.argsort(context)
    at = np.minimum(np.searchsorted(context, words, sorter=order), len(context) - 1)
    found = order[at]
    return np.where(context[found] == words, found, len(context))


def _pairs(context: np.ndarray):
    """Bigrams of context words, all others as one word, summed per task."""
    size = len(context) + 1

    def flush(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(where, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)

    def batch_of(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((key // size).astype(np.int32)), pa.array((key % size).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for piece in pieces(batch):
                tokens, lengths = tokens_of(piece)
                at = places(tokens, context)
                key = np.concatenate(([0], at[:-1])) * size + at
                key, n = np.unique(key[_learned(piece, lengths)], return_counts=True)
                keys.append(key)
                counts.append(n)
                held += len(key)
                if held > PAIRS_HELD:
                    key, n = flush(keys, counts)
                    keys, counts, held = [key], [n], len(key)
                    if held > PAIRS_HELD // 2:
                        yield batch_of(key, n)
                        keys, counts, held = [], [], 0
        if held:
            yield batch_of(*flush(keys, counts))

    return run


def entropy(x: np.ndarray) -> np.ndarray:
    """``x log x``, 0 at 0."""
    return x * np.log(np.maximum(x, 1.0))


def likelihood(matrix: np.ndarray) -> float:
    """Log-likelihood of the class bigrams, up to what no exchange changes."""
    return float(entropy(matrix).sum() - entropy(matrix.sum(axis=0)).sum() - entropy(matrix.sum(axis=1)).sum())


def best_class(matrix: np.ndarray, own: int, left: np.ndarray, right: np.ndarray, twice: float) -> int:
    """Where a word belongs: it is taken out of its class, and put where the likelihood becomes largest.

    ``left`` and ``right`` count its neighbours by class, itself included; ``twice`` counts it next to itself.
    """
    without = matrix.copy()
    without[own] -= right
    without[:, own] -= left
    without[own, own] += twice
    left, right = left.copy(), right.copy()
    left[own] -= twice
    right[own] -= twice
    size = right.sum() + twice
    rows, cols = without, without.T
    gain = (entropy(rows + right) - entropy(rows)).sum(axis=1) + (entropy(cols + left) - entropy(cols)).sum(axis=1)
    own_pair = np.diag(without)
    gain += entropy(own_pair + left + right + twice) - entropy(own_pair)
    gain -= entropy(own_pair + right) - entropy(own_pair) + entropy(own_pair + left) - entropy(own_pair)
    for totals in (matrix.sum(axis=1), matrix.sum(axis=0)):
        totals[own] -= size
        gain -= entropy(totals + size) - entropy(totals)
    gain[END_CLASS] = -np.inf
    best = int(gain.argmax())
    return best if gain[best] > gain[own] + 1e-9 else own


def _neighbours(row: dict, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray, float]:
    sides = np.zeros((2, n_classes))
    np.add.at(sides, (np.array(row["side"]), classes[np.array(row["other"])]), np.array(row["n"], dtype=float))
    twice = sum(n for side, other, n in zip(row["side"], row["other"], row["n"]) if side == 1 and other == row["word"])
    return sides[0], sides[1], float(twice)


def _exchange(classes: np.ndarray, matrix: np.ndarray, groups: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, found = [], []
            for row in batch.to_pylist():
                word = row["word"]
                if word == 0 or word == len(classes) - 1 or word % groups != turn:
                    continue
                left, right, twice = _neighbours(row, classes, len(matrix))
                words.append(word)
                found.append(best_class(matrix, int(classes[word]), left, right, twice))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), pa.array(found, pa.int32())], ["word", "class"])

    return run


def _class_matrix(adjacent: DataFrame, classes: np.ndarray, n_classes: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_classes, n_classes))
        for batch in batches:
            for row in batch.to_pylist():
                total[classes[row["word"]]] += _neighbours(row, classes, n_classes)[1]
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b].astype(np.int64))], ["a", "b", "n"])

    return _matrix(adjacent.mapInArrow(run, "a int, b int, n long"), n_classes)


def _matrix(counts: DataFrame, n_classes: int) -> np.ndarray:
    out = np.zeros((n_classes, n_classes))
    for a, b, n in counts.groupBy("a", "b").agg(F.sum("n")).collect():  # at most n_classes squared
        out[a, b] = n
    return out


@dataclass(frozen=True)
class Context:
    """The frequent words: their hashes, counts and classes (the last entry stands for all other words)."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    matrix: np.ndarray
    likelihoods: list[float]


def cluster_context(rows: DataFrame, context: np.ndarray, n_classes: int = CLASSES, rounds: int = ROUNDS) -> Context:
    """Exchange clustering of the context. The most frequent words start in a class each, the others with the rest."""
    pairs = kept(rows.mapInArrow(_pairs(context), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "lm-pairs")
    counts = np.zeros(len(context) + 1, dtype=np.int64)
    for word, n in pairs.groupBy("b").agg(F.sum("n")).collect():  # one row for each word of the context
        counts[word] = n
    right = pairs.select(F.col("a").alias("word"), F.lit(1).alias("side"), F.col("b").alias("other"), "n")
    left = pairs.select(F.col("b").alias("word"), F.lit(0).alias("side"), F.col("a").alias("other"), "n")
    entry = F.array_sort(F.collect_list(F.struct("side", "other", "n"))).alias("e")
    lists = left.unionByName(right).repartition(16, "word").groupBy("word").agg(entry)
    adjacent = kept(lists.select("word", "e.side", "e.other", "e.n"), "lm-adjacent")
    classes = np.full(len(context) + 1, REST_CLASS)
    first = min(n_classes - 2, len(context) - 1)
    classes[1 : first + 1] = np.arange(2, first + 2)
    classes[0] = END_CLASS
    matrix = _class_matrix(adjacent, classes, n_classes)
    seen = [likelihood(matrix)]
    groups = 2
    for turn in range(rounds):
        moved = classes.copy()
        found = adjacent.mapInArrow(_exchange(classes, matrix, groups, turn % groups), "word int, class int")
        for word, best in found.collect():  # the context
            moved[word] = best
        after = _class_matrix(adjacent, moved, n_classes)
        if likelihood(after) < seen[-1]:
            groups *= 2
            continue
        classes, matrix = moved, after
        seen.append(likelihood(after))
    return Context(context, counts, classes, matrix, seen)


_DEALT = "kind int, block long, bucket int, data binary, doc_id array<long>, held array<boolean>, length array<int>"
_DEALT_ARROW = pa.schema(
    [
        ("kind", pa.int32()),
        ("block", pa.int64()),
        ("bucket", pa.int32()),
        ("data", pa.binary()),
        ("doc_id", pa.list_(pa.int64())),
        ("held", pa.list_(pa.bool_())),
        ("length", pa.list_(pa.int32())),
    ]
)


def _deal(context: Context, buckets: int, n_classes: int):
    """Each piece as rows of token numbers (kind 0), and its words outside the context by bucket (kind 1).

    A token below the size of the context is a place in it; above, the place of a word in the piece, by bucket and hash.
    """
    size = len(context.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch):
                tokens, lengths = tokens_of(piece)
                words, token = np.unique(tokens, return_inverse=True)
                at = places(words, context.words)
                outside = np.flatnonzero(at == size)
                bucket = (mixed(words[outside]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                outside, bucket = outside[order], bucket[order]
                number = at.copy()
                number[outside] = size + np.arange(len(outside))
                code = number[token].astype(np.int32)
                rows = [*_document_rows(piece, code, lengths, block), *_word_rows(piece, code, lengths, words[outside], bucket, block)]
                yield pa.RecordBatch.from_pylist(rows, schema=_DEALT_ARROW)
                block += 1

    def _document_rows(piece, code, lengths, block):
        ends = np.cumsum(lengths)
        ids, held = piece.column("doc_id").to_pylist(), piece.column("held").to_pylist()
        first = 0
        while first < len(ids):
            start = int(ends[first] - lengths[first])
            last = max(first + 1, int(np.searchsorted(ends, start + TOKENS_PER_ROW, side="right")))
            part = slice(first, last)
            data = pack(code[start : int(ends[last - 1])])
            yield {"kind": 0, "block": block, "data": data, "doc_id": ids[part], "held": held[part], "length": lengths[part].tolist()}
            first = last

    def _word_rows(piece, code, lengths, words, bucket, block):
        learned = _learned(piece, lengths)
        here = np.flatnonzero((code >= size) & learned)
        local = code[here] - size
        counts = np.bincount(local, minlength=len(words)).astype(np.int32)
        kind = np.append(context.classes[:size], np.full(len(words), REST_CLASS))[code]
        # The end of the text before stands at the left of a first word; a word always has a right neighbour.
        sides = [np.where(here > 0, kind[here - 1], END_CLASS), n_classes + kind[np.minimum(here + 1, len(kind) - 1)]]
        key, n = np.unique(np.concatenate([local.astype(np.int64) * (2 * n_classes) + side for side in sides]), return_counts=True)
        owner = key // (2 * n_classes)
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, dtype=np.int64)
        ends = np.append(starts[1:], len(bucket))
        entries = np.searchsorted(owner, np.append(starts, len(bucket)))
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            e = slice(int(entries[i]), int(entries[i + 1]))
            data = pack(words[a:b], counts[a:b], (owner[e] - a).astype(np.int32), (key[e] % (2 * n_classes)).astype(np.uint8), n[e].astype(np.int32))
            yield {"kind": 1, "block": block, "bucket": int(bucket[a]), "data": data}

    return run


def insertion(matrix: np.ndarray, owner: np.ndarray, side: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """Class that gains most from each word, the words taken one by one against the same counts.

    The gain is that of an exchange to first order, which a word that is rare against its class comes close to: the
    logarithms of the class's neighbours, summed over those of the word. ``PRIOR`` neighbours by class frequency are
    added to each class, so that an empty or small one does not draw all words. Entries (``owner`` ascending) say how
    often a word stands beside a class; ``side`` is the class, plus the number of classes if it stands to the right.
    """
    n_classes = len(matrix)
    frequency = (matrix.sum(axis=0) + 1.0) / (matrix.sum() + n_classes)
    before, after = (
        np.log((m + PRIOR * frequency[:, None]) / (m.sum(axis=0) + PRIOR)) for m in (matrix, matrix.T)
    )
    table = np.concatenate((before, after))  # row: class beside the word; column: class of the word
    best = np.full(words, REST_CLASS, dtype=np.uint8)
    for start in range(0, words, CHUNK):
        stop = min(start + CHUNK, words)
        gain = np.zeros((stop - start, n_classes))
        a, b = np.searchsorted(owner, (start, stop))
        for e in range(a, b, CHUNK):
            part = slice(e, min(e + CHUNK, b))
            rows, first = np.unique(owner[part], return_index=True)
            gain[rows - start] += np.add.reduceat(table[side[part]] * n[part, None], first, axis=0)
        gain[:, END_CLASS] = -np.inf
        best[start:stop] = gain.argmax(axis=1)
    return best


def _classify(context: Context, n_classes: int):
    """One bucket: counts of its words over all pieces, their classes, and both back to every piece."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        found = [unpack(v, "u8", "i4", "i4", "u1", "i4") for v in table["data"].to_pylist()]
        sizes = np.array([len(f[0]) for f in found])
        words, which = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        counts = np.bincount(which, weights=np.concatenate([f[1] for f in found]), minlength=len(words)).astype(np.int64)
        owner = which[np.concatenate([f[2] + s for f, s in zip(found, starts)])]
        key = owner * (2 * n_classes) + np.concatenate([f[3] for f in found])
        key, where = np.unique(key, return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([f[4] for f in found]), minlength=len(key)).astype(np.int64)
        classes = insertion(context.matrix, key // (2 * n_classes), key % (2 * n_classes), n, len(words))
        classes[counts == 0] = UNKNOWN
        sent = [pack(classes[which[s : s + k]], counts[which[s : s + k]]) for s, k in zip(starts.tolist(), sizes.tolist())]
        known = counts > 0
        totals = np.bincount(classes[known], weights=counts[known], minlength=n_classes).astype(np.int64)
        stats = [int(known.sum()), int((counts == 1).sum()), *totals.tolist()]
        blocks = [*table["block"].to_pylist(), None]
        bucket = table["bucket"][0].as_py()
        columns = [pa.array(blocks, pa.int64()), pa.array([bucket] * len(blocks), pa.int32()), pa.array([*sent, None], pa.binary())]
        return pa.table([*columns, pa.array([None] * len(sent) + [stats], pa.list_(pa.int64()))], ["block", "bucket", "data", "stats"])

    return run


@dataclass(frozen=True)
class Vocabulary:
    """Totals of training: tokens, different tokens, those seen once, and tokens of each class."""

    tokens: int
    size: int
    once: int
    classes: np.ndarray

    @property
    def unseen(self) -> float:
        """Probability that a token is none of the vocabulary: the share of tokens seen once, kept off 0 and 1."""
        return (self.once + 1) / (self.tokens + 2)


def _vocabulary(context: Context, found: DataFrame, n_classes: int) -> Vocabulary:
    counts = context.counts[:-1]
    totals = np.bincount(context.classes[:-1], weights=counts, minlength=n_classes).astype(np.int64)
    size, once = int((counts > 0).sum()), int((counts == 1).sum())
    stats = found.filter("block IS NULL").select(F.posexplode("stats").alias("at", "n")).groupBy("at").agg(F.sum("n"))
    added = dict(map(tuple, stats.collect()))  # one row for each class and two more
    totals = totals + np.array([added.get(i + 2, 0) for i in range(n_classes)])
    return Vocabulary(int(totals.sum()), size + added.get(0, 0), once + added.get(1, 0), totals)


_CLASSED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emission double, classes binary"


def _meet(context: Context, vocabulary: Vocabulary):
    """Documents of a piece with what came back for its words: counts become scores, tokens become classes."""
    size = len(context.words)
    base = np.log10(vocabulary.tokens + vocabulary.size + 1.0)
    totals = np.maximum(vocabulary.classes, 1).astype(float)
    own_counts = context.counts[:-1]
    own_classes = np.where(own_counts > 0, context.classes[:-1], UNKNOWN)

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        back = [unpack(v, "u1", "i8") for v in found.sort_by("bucket")["data"].to_pylist()] if found.num_rows else []
        classes = np.concatenate([own_classes.astype(np.uint8), *[b[0] for b in back]])
        counts = np.concatenate([own_counts, *[b[1] for b in back]])
        plain = np.log10(counts + 1.0) - base
        inside = np.where(counts > 0, np.log10(np.maximum(counts, 1) / np.append(totals, np.ones(256))[classes]), 0.0)
        out = []
        for row in docs.to_pylist():
            (code,) = unpack(row["data"], "i4")
            starts = np.cumsum(row["length"]) - row["length"]
            known = np.add.reduceat((counts > 0)[code].astype(np.int64), starts)
            sums = [np.add.reduceat(v[code], starts) for v in (plain, inside)]
            kind = classes[code]
            for i, (s, n) in enumerate(zip(starts.tolist(), row["length"])):
                out.append((row["doc_id"][i], row["held"][i], n, int(known[i]), sums[0][i], sums[1][i], kind[s : s + n].tobytes()))
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "emission", "classes"]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names)

    return run


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens of a batch, those before them (an end before each text), and where each text starts."""
    texts = batch.column("classes")
    lengths = np.array([len(t) for t in texts.to_pylist()], dtype=np.int64)
    kind = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    before = np.concatenate(([END_CLASS], kind[:-1])).astype(np.uint8)
    starts = np.cumsum(lengths) - lengths
    before[starts] = END_CLASS
    return kind, before, starts


def _transitions(n_classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_classes * n_classes, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                kind, before, _ = _sequences(batch)
                total += np.bincount(before.astype(np.int64) * n_classes + kind, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array((at // n_classes).astype(np.int32)), pa.array((at % n_classes).astype(np.int32)), pa.array(total[at])], ["a", "b", "n"]
        )

    return run


def smoothed(matrix: np.ndarray) -> np.ndarray:
    """Class probabilities after each class, and after an unknown word in the last row.

    Each row gives as many of its counts to the plain class frequencies as it has different followers.
    """
    frequency = matrix.sum(axis=0) / max(matrix.sum(), 1.0)
    kinds = (matrix > 0).sum(axis=1, keepdims=True)
    rows = (matrix + kinds * frequency) / np.maximum(matrix.sum(axis=1, keepdims=True) + kinds, 1.0)
    return np.vstack([rows, frequency])


def _score(matrix: np.ndarray, vocabulary: Vocabulary):
    n_classes = len(matrix)
    with np.errstate(divide="ignore"):
        table = np.log10(smoothed(matrix))
    new, old = np.log10(vocabulary.unseen), np.log10(1.0 - vocabulary.unseen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, before, starts = _sequences(batch)
            known = kind != UNKNOWN
            each = np.full(len(kind), new)
            each[known] = old + table[np.minimum(before[known], n_classes), kind[known]]
            score = np.add.reduceat(each, starts) + batch.column("emission").to_numpy()
            given = [batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")]
            tokens = pa.array(np.full(batch.num_rows, vocabulary.tokens))
            names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
            yield pa.RecordBatch.from_arrays([*given, tokens, batch.column("base_score"), pa.array(score)], names)

    return run


@dataclass(frozen=True)
class Model:
    """A trained model, and the documents it was given in classes: what scores are taken from."""

    context: Context
    vocabulary: Vocabulary
    transitions: np.ndarray
    documents: DataFrame

    def scores(self) -> DataFrame:
        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return self.documents.mapInArrow(_score(self.transitions, self.vocabulary), schema)


def train(docs: DataFrame, context_size: int = CONTEXT, n_classes: int = CLASSES, rounds: int = ROUNDS) -> Model:
    """Learn from all documents that are not held out, and bring all documents into classes."""
    spark = docs.sparkSession
    rows = training_rows(docs)
    words, total = context_words(rows, context_size)
    context = cluster_context(rows, words, n_classes, rounds)
    buckets = max(1, -(-total // WORDS_PER_BUCKET))
    path = fresh_path(spark, "lm-pieces")
    rows.mapInArrow(_deal(context, buckets, n_classes), _DEALT).write.partitionBy("kind").parquet(path)
    dealt = spark.read.schema(_DEALT).parquet(path)
    # The number of tasks is given: rows are few and packed, and adaptive execution would merge them by size.
    asked = dealt.filter("kind = 1").select("block", "bucket", "data").repartition(buckets, "bucket").groupBy("bucket")
    found = kept(asked.applyInArrow(_classify(context, n_classes), "block long, bucket int, data binary, stats array<long>"), "lm-words")
    vocabulary = _vocabulary(context, found, n_classes)
    texts = dealt.filter("kind = 0").select("block", "data", "doc_id", "held", "length")
    back = found.filter("block IS NOT NULL").select("block", "bucket", "data")
    left, right = (side.repartition(buckets, "block").groupBy("block") for side in (texts, back))
    classed = kept(left.cogroup(right).applyInArrow(_meet(context, vocabulary), _CLASSED), "lm-classes")
    learned = classed.filter("NOT held_out").select("classes")
    matrix = _matrix(learned.mapInArrow(_transitions(n_classes), "a int, b int, n long"), n_classes)
    return Model(context, vocabulary, matrix, classed)


def score_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end alone. A null id is not held out; repeated ids and rows are documents of their own.
    The score sums the logarithms of class transition times word emission. Words that training has not seen count as
    one unknown word, whose probability is the share of training tokens seen once; after it, classes have their plain
    frequencies. Without any document to learn from, every token has probability 1 in the base and 1/2 in the score.
    Columns other than doc_id and text are not read. An empty table gives no row.
    """
    return train(docs, **options).scores()
