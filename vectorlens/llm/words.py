"""Words, word hashes and n-gram hashes of whole texts, as numpy kernels over Arrow batches.

A word is ``[^\\x20\\x09-\\x0D]+``. Those separators are single bytes in UTF-8, so texts are cut as bytes and no
Python string is made per word. Hashes are 64 bits wide; two different words or n-grams meet in one hash with a
probability of 2**-64 for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The separators, as a class for Java and Python patterns.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"

# Text bytes that a kernel takes at once. One longer text is still taken whole.
PIECE_BYTES = 8 << 20
# Text bytes whose words are found at once where only their shingles are kept: finding them takes about 12 bytes for each.
SHINGLED_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BARE = _FOLD.copy()
_BARE[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_count(text: Column) -> Column:
    """Number of words as a long, by built-in functions; null counts 0."""
    marks = F.translate(F.regexp_replace(text, WORD.replace("]+", "]++"), "x"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` text bytes, or one row."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit value (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i]+1, ...`` with ``counts[i]`` values each, one after another."""
    total = int(counts.sum())
    if total == 0:
        return np.empty(0, dtype=np.int64)
    shift = np.concatenate(([0], np.cumsum(counts)[:-1]))
    return np.repeat(starts - shift, counts) + np.arange(total)


@dataclass
class Words:
    """Words of the texts of one piece: byte spans, and where the words of each row begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word: eight bytes at a time, then its length."""
        lengths = self.ends - self.starts
        padded = np.concatenate((self.data, np.zeros(8, dtype=np.uint8)))
        eight = np.ndarray(shape=(len(self.data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
        out = mixed((eight[self.starts] & _KEEP[np.minimum(lengths, 8)]) + _BASE)
        longer, done = np.flatnonzero(lengths > 8), 8
        while len(longer):
            part = eight[self.starts[longer] + done] & _KEEP[np.minimum(lengths[longer] - done, 8)]
            out[longer] = mixed(out[longer] * _BASE + part)
            done += 8
            longer = longer[lengths[longer] > done]
        return mixed(out + lengths.astype(np.uint64) * _BASE)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def find_words(texts: pa.Array, fold: bool = False, punctuation: bool = True) -> Words:
    """Words of every text; a null text has none. ``fold`` lower-cases A to Z; without ``punctuation``, that of ASCII
    separates words too, and A to Z are lower-cased."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if fold or not punctuation:
        raw = (_FOLD if punctuation else _BARE)[raw]
    if len(raw) == 0:
        none = np.empty(0, dtype=np.int64)
        return Words(raw, none, none, np.zeros(len(texts) + 1, dtype=np.int64))
    space = _SPACE[raw]
    before = np.concatenate(([True], space[:-1]))
    before[offsets[:-1][offsets[:-1] < len(raw)]] = True
    after = np.concatenate((space[1:], [True]))
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return Words(raw, starts, ends, np.searchsorted(starts, offsets))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of ``n`` consecutive values starting at each position (empty if there are fewer)."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    size = len(hashes) - n + 1
    out = hashes[:size].copy()
    for j in range(1, n):
        out *= _BASE
        out += hashes[j : j + size]
    return mixed(out)


def shingle_sets(found: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word hashes of each row; a shorter row is one shingle, a row without words has none."""
    hashes = found.hashes()
    grams = rolling(hashes, n)
    out = []
    for start, end in zip(found.rows[:-1].tolist(), found.rows[1:].tolist(), strict=True):
        if end - start >= n:
            out.append(np.unique(grams[start : end - n + 1]))
        elif end > start:
            out.append(rolling(hashes[start:end], end - start) ^ np.uint64(end - start))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def folded_shingles(texts: pa.Array, n: int) -> list[np.ndarray]:
    """``shingle_sets`` of lower-cased texts, from the words of ``SHINGLED_BYTES`` of text at once: beside the sets of
    many texts, the words of few are held."""
    out = []
    for piece in pieces(pa.RecordBatch.from_arrays([texts], ["text"]), limit=SHINGLED_BYTES):
        out += shingle_sets(find_words(piece.column("text"), fold=True), n)
    return out
