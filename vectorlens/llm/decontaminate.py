"""Benchmark decontamination by latent semantic retrieval.

1. Statistics: over all texts, in how many blocks of words each benchmark word occurs, for inverse frequencies.
2. Passages: all texts are read as overlapping passages of twice an item class's length, so that an item of the class
   lies whole in one of them. Every passage goes on, by its benchmark words; one without any has a row of zeros.
3. A randomised singular value decomposition of the TF-IDF rows of all passages and of the items: tasks multiply their
   passages with a random matrix and back, the products are added up over tasks, and a second pass refines them.
4. Each passage is held against the answer words of the items of its class: an item's rarest words, which carry
   ``ANSWER_WEIGHT`` of its weight. A pair is left out only if so much of them is missing that it fails step 5 whatever
   the other words are.
5. Of every other pair the longest common subsequence, weighted by inverse frequency, must cover ``MATCH_SHARE`` of the
   item. Changed, added or dropped words leave the rest in order, so paraphrases that keep most of an item are found.
   Such a pair is reported with its cosine in the latent space. The cosine drops no pair: a space of fixed rank keeps
   little of short items among many.

Items of fewer than ``LEAST_WORDS`` words are matched exactly, as words in a row. A letter of a script without spaces
counts as a word.

The benchmark is taken in parts of at most ``PART_BYTES``, each held by every task; the corpus is read once more for
each part. Words are compared without case and punctuation, by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorlens.llm.tables import kept, with_text_key, without
from vectorlens.llm.words import Words, find_words, pieces, ranges, rolling

PART_BYTES = 8 << 20
# Bytes of corpus text whose words a task holds at once.
READ_BYTES = 1 << 20
# Words of a statistics block, and of the smallest item class; classes double.
BLOCK_WORDS = 32
FEATURES, RANK, EXTRA = 8192, 32, 8
ANSWER_WEIGHT = 0.7
MATCH_SHARE = 0.6
# Passages whose rows are multiplied at once, their words, and the meetings of a passage's word with an item.
SLICE_ROWS, SLICE_WORDS, SLICE_MEETINGS = 512, 1 << 16, 1 << 20
# A feature of at least one row in so many is multiplied as a dense column.
DENSE = 96
# Items shorter than this are matched exactly.
LEAST_WORDS = 5
# Letters of scripts that set no spaces between words, and the least first byte of one of them.
UNSPACED, UNSPACED_BYTE = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])", 0xE0


@dataclass(frozen=True)
class Items:
    """Benchmark items of one part: ids, word hashes, and the sorted vocabulary of all of them; ``short`` holds the
    items under ``LEAST_WORDS`` words, sorted hashes and ids by their number of words."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: np.ndarray
    short: dict[int, tuple[np.ndarray, list[int]]]


@dataclass(frozen=True)
class Asked:
    """Items of one class and their answer words, sorted by word: each with its item, as a number within the class, and
    the weight that it has there; those of a word begin at ``first``. A leak of an item holds answer words of at least the
    weight ``need``."""

    members: np.ndarray
    first: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    need: np.ndarray


@dataclass(frozen=True)
class Weighted:
    """Items with inverse frequencies of the vocabulary, and the items of each class by answer word."""

    items: Items
    idf: np.ndarray
    classes: dict[int, Asked]


def normalized_words(texts: pa.Array) -> Words:
    """Words in lower case without ASCII punctuation; a letter of a script without spaces is a word."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, where, data = texts.buffers()
    if len(texts) and data is not None:
        offsets = np.frombuffer(where, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]].max(initial=0) >= UNSPACED_BYTE:
            texts = pc.replace_substring_regex(texts, UNSPACED, r" \1 ")
    return find_words(texts, fold=True, punctuation=False)


def _parts(benchmark: DataFrame) -> Iterator[Items]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = -(-total // PART_BYTES)
    for part in range(parts):
        found = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).toArrow()
        words = normalized_words(found["text"].combine_chunks())
        hashes = words.hashes()
        each = [hashes[a:b] for a, b in zip(words.rows[:-1], words.rows[1:], strict=True)]
        ids = found["item_id"].to_pylist()
        short: dict[int, tuple[list, list]] = {}
        for i, w in enumerate(each):
            if 0 < len(w) < LEAST_WORDS:
                hashed, of = short.setdefault(len(w), ([], []))
                hashed.append(rolling(w, len(w))[0]), of.append(ids[i])
        shorts = {}
        for n, (hashed, of) in short.items():
            order = np.argsort(np.array(hashed, dtype=np.uint64), kind="stable")
            shorts[n] = (np.array(hashed, dtype=np.uint64)[order], [of[i] for i in order])
        keep = [i for i, w in enumerate(each) if len(w) >= LEAST_WORDS]
        if keep or shorts:
            vocabulary = np.unique(np.concatenate([each[i] for i in keep])) if keep else np.empty(0, dtype=np.uint64)
            yield Items([ids[i] for i in keep], [each[i] for i in keep], vocabulary, shorts)


def _short_leaks(docs: DataFrame, shorts: dict, schema: str) -> DataFrame:
    """Texts that hold the words of a short item in a row."""
    shared = docs.sparkSession.sparkContext.broadcast(shorts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, limit=READ_BYTES):
                found = normalized_words(piece.column("text"))
                hashes, row = found.hashes(), np.repeat(np.arange(piece.num_rows), found.counts)
                hits = set()
                for n, (items, ids) in shared.value.items():
                    grams = rolling(hashes, n)
                    if len(grams) == 0:
                        continue
                    low, high = np.searchsorted(items, grams, side="left"), np.searchsorted(items, grams, side="right")
                    for at in np.flatnonzero((high > low) & (row[: len(grams)] == row[n - 1 :])).tolist():
                        hits.update((int(row[at]), ids[i]) for i in range(low[at], high[at]))
                hits = list(hits)
                at, ones = pa.array([h[0] for h in hits], pa.int64()), pa.array([1.0] * len(hits), pa.float64())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(at), piece.column("text_key").take(at), pa.array([h[1] for h in hits], pa.int64()), ones, ones], ["doc_id", "text_key", "item_id", "cosine", "matched"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, schema)


def _positions(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in the vocabulary, or -1. Hashes with the same first bits stand together, few of them."""
    if len(hashes) == 0 or len(vocabulary) == 0:
        return np.full(len(hashes), -1, dtype=np.int64)
    shift = np.uint64(64 - min(20, len(vocabulary).bit_length() + 4))
    counts = np.bincount((vocabulary >> shift).astype(np.int64), minlength=1 << (64 - int(shift)))
    first = np.minimum(np.cumsum(counts) - counts, len(vocabulary) - 1)
    bucket = (hashes >> shift).astype(np.int64)
    out = first[bucket]
    out = np.where(vocabulary[out] == hashes, out, -1)
    left, step = np.flatnonzero((out < 0) & (counts > 1)[bucket]), 1
    while len(left):
        at = first[bucket[left]] + step
        same = vocabulary[at] == hashes[left]
        out[left[same]] = at[same]
        step += 1
        left = left[~same & (counts[bucket[left]] > step)]
    return out


def _weighted(docs: DataFrame, items: Items) -> Weighted:
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One row per word and task, not per piece.
        vocabulary = shared.value
        df, blocks = np.zeros(len(vocabulary), dtype=np.int64), 0
        for batch in batches:
            for piece in pieces(batch, limit=READ_BYTES):
                found = normalized_words(piece.column("text"))
                at = _positions(vocabulary, found.hashes())
                inside = np.arange(len(at)) - np.repeat(found.rows[:-1], found.counts)
                fresh = (inside % BLOCK_WORDS == 0).cumsum()
                known = at >= 0
                _, word, _ = _different(fresh[known], at[known], len(vocabulary))
                df += np.bincount(word, minlength=len(vocabulary))
                blocks += int(fresh[-1]) if len(fresh) else 0
        place = np.append(np.flatnonzero(df), -1)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.append(df[df > 0], blocks))], ["at", "n"])

    rows = docs.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n")).collect()
    df = np.zeros(len(items.vocabulary) + 1)
    for at, n in rows:
        df[at] = n
    idf = np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1e-3
    classes: dict[int, list[int]] = {}
    for i, words in enumerate(items.words):
        size = BLOCK_WORDS
        while size < len(words):
            size *= 2
        classes.setdefault(size, []).append(i)
    return Weighted(items, idf, {size: _asked(items, idf, members) for size, members in classes.items()})


def _asked(items: Items, idf: np.ndarray, members: list[int]) -> Asked:
    words, weights, need = [], [], []
    for i in members:
        own, counts = np.unique(_positions(items.vocabulary, items.words[i]), return_counts=True)
        weight = idf[own] * counts
        rare = np.argsort(-idf[own], kind="stable")
        total = np.cumsum(weight[rare])
        rare = rare[: int(np.searchsorted(total, ANSWER_WEIGHT * total[-1])) + 1]
        words.append(own[rare])
        weights.append(weight[rare])
        # Words that are not there weigh at most what a match may lack; the rest is room for rounding.
        need.append(weight[rare].sum() - (1.0 - MATCH_SHARE + 1e-9) * total[-1])
    item = np.repeat(np.arange(len(members)), [len(w) for w in words])
    words, weights = np.concatenate(words), np.concatenate(weights)
    order = np.argsort(words, kind="stable")
    first = np.searchsorted(words[order], np.arange(len(idf) + 1))
    return Asked(np.array(members), first, item[order], weights[order], np.array(need))


def _meetings(asked: Asked, passage: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a passage and a number within the class that share answer words of enough weight; ``passage`` and
    ``word`` are the different words of each passage, in passage order."""
    low = asked.first[word]
    of = asked.first[word + 1] - low
    passage, low, of = passage[of > 0], low[of > 0], of[of > 0]
    total, found, start = np.cumsum(of), [], 0
    while start < len(of):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + SLICE_MEETINGS, side="right")))
        # Whole passages, so that the weight of a pair is added up at once.
        first = int(np.searchsorted(passage, passage[end - 1])) if end < len(of) else end
        end = first if first > start else int(np.searchsorted(passage, passage[start], side="right"))
        at = ranges(low[start:end], of[start:end])
        cell, where = np.unique(np.repeat(passage[start:end], of[start:end]) * len(asked.members) + asked.item[at], return_inverse=True)
        found.append(cell[np.bincount(where, asked.weight[at], len(cell)) >= asked.need[cell % len(asked.members)]])
        start = end
    found = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
    return found // len(asked.members), found % len(asked.members)


def _windows(blocks: np.ndarray, per_text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of all passages for items of a class; ``blocks`` has the benchmark words in each
    block of the texts, ``per_text`` the blocks of each text. Passages without such words have rows of zeros and are not
    among them."""
    before, step = np.concatenate(([0], np.cumsum(blocks))), size // BLOCK_WORDS
    ends = np.cumsum(per_text)
    counts = -(-per_text // step)
    text = np.repeat(np.arange(len(counts)), counts)
    start = (ends - per_text)[text] + (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
    first = before[start]
    held = before[np.minimum(start + 2 * step, ends[text])] - first
    return text[held > 0], first[held > 0], held[held > 0]


def _read(texts: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary places of the benchmark words of some texts, how many there are in each block, and the blocks of each text."""
    found = normalized_words(texts)
    at = _positions(vocabulary, found.hashes())
    known = at >= 0
    before = np.concatenate(([0], np.cumsum(known)))
    per_text = -(-found.counts // BLOCK_WORDS)
    inside = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    start = np.repeat(found.rows[:-1], per_text) + inside * BLOCK_WORDS
    end = np.minimum(start + BLOCK_WORDS, np.repeat(found.rows[1:], per_text))
    return at[known].astype(np.int32), before[end] - before[start], per_text


def _texts(docs: DataFrame, weighted: Weighted) -> DataFrame:
    """``(doc_id, text_key, words, blocks, first, held, item, matched)``: the benchmark words of every text as vocabulary
    places, and how many stand in each block, which is all that its passages are cut from; and the matches among these:
    where a passage begins among the words, its words, the item and the share found."""
    own = [_positions(weighted.items.vocabulary, w) for w in weighted.items.words]
    shared = docs.sparkSession.sparkContext.broadcast((weighted, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted, own = shared.value
        for batch in batches:
            for piece in pieces(batch, limit=READ_BYTES):
                words, blocks, per_text = _read(piece.column("text"), weighted.items.vocabulary)
                ends = np.cumsum(per_text)
                before = np.concatenate(([0], np.cumsum(blocks)))
                start, end = before[ends - per_text], before[ends]
                text, first, held, item, matched = _matches(weighted, own, words, blocks, per_text)
                order = np.argsort(text, kind="stable")
                per_hit = np.bincount(text, minlength=len(per_text))
                columns = [piece.column("doc_id"), piece.column("text_key"), _lists(words, end - start), _lists(blocks.astype(np.int32), per_text)]
                columns += [_lists((first - start[text])[order], per_hit), _lists(held[order], per_hit), _lists(item[order], per_hit), _lists(matched[order], per_hit)]
                yield pa.RecordBatch.from_arrays(columns, _TEXTS)

    schema = "doc_id long, text_key long, words array<int>, blocks array<int>, first array<long>, held array<long>, item array<long>, matched array<double>"
    return docs.select("doc_id", "text_key", "text").mapInArrow(run, schema)


_TEXTS = ["doc_id", "text_key", "words", "blocks", "first", "held", "item", "matched"]


def _matches(weighted: Weighted, own: list[np.ndarray], words: np.ndarray, blocks: np.ndarray, per_text: np.ndarray):
    """Text, first word and number of words of the passages that match an item; number of the item and share found."""
    hits = []
    for size, asked in weighted.classes.items():
        text, first, held = _windows(blocks, per_text, size)
        asks = np.diff(asked.first) > 0
        for rows, _ in _slices(held):
            passage = np.repeat(np.arange(rows.start, rows.stop), held[rows])
            word = words[ranges(first[rows], held[rows])]
            passage, word, _ = _different(passage[asks[word]], word[asks[word]], len(asks))
            passage, item = _meetings(asked, passage, word)
            for j, i in zip(passage.tolist(), asked.members[item].tolist(), strict=True):
                weight = weighted.idf[own[i]]
                share = weighted_lcs(own[i], words[first[j] : first[j] + held[j]], weight) / weight.sum()
                if share >= MATCH_SHARE:
                    hits.append((text[j], first[j], held[j], i, min(share, 1.0)))
    return tuple(np.array([h[k] for h in hits], dtype=np.float64 if k == 4 else np.int64) for k in range(5))


def _passages(docs: DataFrame, weighted: Weighted) -> DataFrame:
    """``(doc_id, text_key, size, words)``: all passages with a benchmark word, one row each; ``words`` are the vocabulary
    places of these in the order of the text."""
    sizes = list(weighted.classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (words, _), (blocks, per_text) = _list_values(batch.column("words")), _list_values(batch.column("blocks"))
            for size in sizes:
                text, first, held = _windows(blocks, per_text, size)
                columns = [batch.column(c).take(pa.array(text)) for c in ("doc_id", "text_key")]
                columns += [pa.array(np.full(len(text), size, dtype=np.int32)), _lists(words[ranges(first, held)], held)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "size", "words"])

    return _texts(docs, weighted).mapInArrow(run, "doc_id long, text_key long, size int, words array<int>")


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values))


def tfidf(words: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit TF-IDF rows as ``(row, feature, value)``; vocabulary places fall into ``FEATURES`` features."""
    flat, lengths = _flat(words)
    return _entries(np.repeat(np.arange(len(words)), lengths), flat, len(words), idf)


def _flat(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(words) if words else np.empty(0, dtype=np.int64), np.array([len(w) for w in words], dtype=np.int64)


def _entries(row: np.ndarray, word: np.ndarray, rows: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    known = word >= 0
    row, word, counts = _different(row, word, len(idf)) if known.all() else _different(row[known], word[known], len(idf))
    value = (1.0 + np.log(counts)) * idf[word]
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=rows))
    return row, word % FEATURES, value / np.where(norm > 0, norm, 1.0)[row]


def _different(row: np.ndarray, word: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of a row and a vocabulary place, in row order, and how often each occurs."""
    first = int(row[0]) if len(row) else 0
    kind = np.int32 if len(row) and (int(row[-1]) - first + 1) * vocabulary < 1 << 31 else np.int64
    # Numbers of 32 bits are sorted in half the time.
    cell, counts = np.unique((row - first).astype(kind) * kind(vocabulary) + word.astype(kind), return_counts=True)
    row = cell // kind(vocabulary)
    return row.astype(np.int64) + first, cell - row * kind(vocabulary), counts


def _slices(lengths: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Rows that are taken at once, and their words."""
    ends = np.concatenate(([0], np.cumsum(lengths)))
    start = 0
    while start < len(lengths):
        end = int(np.searchsorted(ends, ends[start] + SLICE_WORDS, side="right")) - 1
        end = min(max(start + 1, end), start + SLICE_ROWS, len(lengths))
        yield slice(start, end), slice(int(ends[start]), int(ends[end]))
        start = end


class _Rows:
    """TF-IDF rows for products: common features as a dense matrix, the others as entries; in single or double precision."""

    def __init__(self, entries: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int, kind: np.dtype):
        row, feature, value = entries
        value = value.astype(kind)
        per = np.bincount(feature, minlength=FEATURES)
        self.common = np.flatnonzero((per > 0) & (per * DENSE >= rows))
        place = np.full(FEATURES, -1)
        place[self.common] = np.arange(len(self.common))
        at = place[feature]
        rare = at < 0
        self.dense = np.zeros((rows, len(self.common)), dtype=kind)
        # Several words of a row may share a feature.
        np.add.at(self.dense.ravel(), row[~rare] * len(self.common) + at[~rare], value[~rare])
        self.row, self.feature, self.value = row[rare], feature[rare], value[rare]

    def times(self, right: np.ndarray) -> np.ndarray:
        out = self.dense @ right[self.common]
        _add_runs(out, self.row, right[self.feature] * self.value[:, None])
        return out

    def add_back(self, left: np.ndarray, total: np.ndarray) -> None:
        """Add the transposed rows times ``left`` to ``total``."""
        total[self.common] += self.dense.T @ left
        order = np.argsort(self.feature.astype(np.uint16), kind="stable")
        _add_runs(total, self.feature[order], left[self.row[order]] * self.value[order, None])


def _add_runs(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add rows to the places ``at``, which are in order."""
    if len(at):
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        out[at[starts]] += np.add.reduceat(rows, starts, axis=0)


def _parts_of(words: np.ndarray, first: np.ndarray, held: np.ndarray, idf: np.ndarray, kind: np.dtype) -> Iterator[_Rows]:
    """TF-IDF rows of passages, given by their first word and number of words."""
    for rows, _ in _slices(held):
        n = rows.stop - rows.start
        row, word = np.repeat(np.arange(n), held[rows]), words[ranges(first[rows], held[rows])]
        yield _Rows(_entries(row, word, n, idf), n, kind)


def _add_products(words: np.ndarray, first: np.ndarray, held: np.ndarray, idf: np.ndarray, right: np.ndarray, total: np.ndarray) -> None:
    """Add ``A' A right`` to ``total``, with the TF-IDF rows ``A`` of passages, in the precision of ``right``."""
    for part in _parts_of(words, first, held, idf, right.dtype):
        part.add_back(part.times(right), total)


def _latent(words: np.ndarray, first: np.ndarray, held: np.ndarray, idf: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit rows of passages in the latent space."""
    parts = [part.times(axes) for part in _parts_of(words, first, held, idf, axes.dtype)]
    return _unit(np.concatenate(parts)) if parts else np.empty((0, axes.shape[1]))


def _list_values(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _gathered(texts: DataFrame, weighted: Weighted, right: np.ndarray) -> np.ndarray:
    """``A' A right`` over all passages, added up over tasks; FEATURES x columns numbers reach the driver.

    Rows of ``texts`` are cut into their passages by their blocks; without these each row is a passage.
    """
    cut = "blocks" in texts.columns
    shared = texts.sparkSession.sparkContext.broadcast((weighted.idf, list(weighted.classes) if cut else [], right.astype(np.float32)))
    width = right.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, sizes, right = shared.value
        total = np.zeros((FEATURES, width))
        for batch in batches:
            words, held = _list_values(batch.column("words"))
            if not cut:
                _add_products(words, np.cumsum(held) - held, held, idf, right, total)
            for size in sizes:
                _, first, held = _windows(*_list_values(batch.column("blocks")), size)
                _add_products(words, first, held, idf, right, total)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), _lists(total[used].ravel(), np.full(len(used), width))], ["f", "v"])

    sums = texts.select("words", *(["blocks"] if cut else [])).mapInArrow(run, "f long, v array<double>").groupBy("f")
    found = sums.agg(F.array(*[F.sum(F.col("v")[c]) for c in range(width)]).alias("v")).toArrow()
    out = np.zeros((FEATURES, width))
    if found.num_rows:
        out[found["f"].to_numpy()] = found["v"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    return out


def latent_axes(texts: DataFrame, weighted: Weighted) -> np.ndarray:
    """Orthonormal features-to-latent matrix spanning the main right singular vectors of passages and items."""
    own, held = _flat([_positions(weighted.items.vocabulary, w) for w in weighted.items.words])

    def product(right: np.ndarray) -> np.ndarray:
        out = _gathered(texts, weighted, right)
        _add_products(own, np.cumsum(held) - held, held, weighted.idf, right, out)
        return out

    axes = np.random.RandomState(8).standard_normal((FEATURES, RANK + EXTRA))
    for _ in range(2):
        axes, _ = np.linalg.qr(product(axes))
    # Within the range found, the singular vectors are those of a small symmetric matrix.
    small = axes.T @ product(axes)
    _, turn = np.linalg.eigh((small + small.T) / 2)
    return axes @ turn[:, ::-1][:, :RANK]


def weighted_lcs(item: np.ndarray, passage: np.ndarray, weight: np.ndarray) -> float:
    """Largest weight of a common subsequence; ``weight`` belongs to the item's words."""
    best = np.zeros(len(passage) + 1)
    for word, w in zip(item, weight, strict=True):
        take = np.where(passage == word, best[:-1] + w, 0.0)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], take))
    return float(best[-1])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, text_key, item_id, cosine, matched)``: documents that hold a benchmark item, and the share found.

    A null or empty text matches nothing; items of fewer than ``LEAST_WORDS`` words have cosine and share 1. Rows that repeat an id are
    told apart by their text; equal rows are reported once. Other columns are ignored. Without documents or items
    the result is empty.
    """
    session = docs.sparkSession
    docs = with_text_key(docs)
    schema = "doc_id long, text_key long, item_id long, cosine double, matched double"
    found = session.createDataFrame([], schema)
    for items in _parts(benchmark):
        if items.short:
            found = found.unionByName(_short_leaks(docs, items.short, schema))
        if not items.words:
            continue
        weighted = _weighted(docs, items)
        texts = kept(_texts(docs, weighted), "passages")
        axes = latent_axes(texts, weighted)
        own, held = _flat([_positions(items.vocabulary, w) for w in items.words])
        latent = _latent(own, np.cumsum(held) - held, held, weighted.idf, axes)
        shared = session.sparkContext.broadcast((items.ids, weighted.idf, axes, latent))

        def report(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, idf, axes, latent = shared.value
            for batch in batches:
                words, lengths = _list_values(batch.column("words"))
                (first, hits), (held, _), (item, _), (matched, _) = (_list_values(batch.column(c)) for c in ("first", "held", "item", "matched"))
                text = np.repeat(np.arange(batch.num_rows), hits)
                places = _latent(words, (np.cumsum(lengths) - lengths)[text] + first, held, idf, axes)
                columns = [batch.column(c).take(pa.array(text)) for c in ("doc_id", "text_key")]
                columns += [pa.array([ids[i] for i in item], pa.int64()), pa.array((places * latent[item]).sum(axis=1)), pa.array(matched)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "item_id", "cosine", "matched"])

        matches = texts.select("doc_id", "text_key", "words", "first", "held", "item", "matched").filter(F.size("item") > 0)
        found = found.unionByName(matches.mapInArrow(report, schema))
    return found.groupBy("doc_id", "text_key", "item_id").agg(F.max("cosine").alias("cosine"), F.max("matched").alias("matched"))


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1.0)


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, matched of every leak."""
    return leaks(docs, benchmark).select("doc_id", "item_id", F.round("cosine", 6).alias("cosine"), F.round("matched", 6).alias("matched"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item, all columns kept; rows with a null text stay."""
    return without(docs, leaks(docs, benchmark))
