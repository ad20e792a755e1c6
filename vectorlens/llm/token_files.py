"""Token-ID files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file holds one frame per document, in order, then two skippable frames that any zstandard reader passes over:

* the document ids, as a zstandard frame of little-endian int64 values and one byte per id that marks a null;
* the seek table of the public seekable format: for each frame its compressed size, its content size and the low
  32 bits of the XXH64 of its content, then the number of frames, a flag byte and the closing magic number.

Frame content is the document's ids as little-endian unsigned 32-bit integers. A reader takes the tail of a file,
then only the bytes of the documents it is asked for, and checks each frame against the table.

Files are written below the shared folder under names of their own. A task reports its file only after it is closed,
and the written list of reported files names the data set: a file left by a lost or repeated task is never read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorlens.llm.tables import kept
from vectorlens.llm.words import find_words, pieces, ranges
from vectorlens.session import fresh_path

# Fixed values of the public format.
SKIPPABLE_IDS, SKIPPABLE_TABLE, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUM_FLAG = 0x80

LEVEL = 3
# Text bytes of one file, about; the number of files grows with the input.
BYTES_PER_FILE = 64 << 20
# Text bytes encoded at once: words and their parts are Python strings for a moment, many times as large.
ENCODED_BYTES = 2 << 20
# Words, and ids of words and of their parts, that a task remembers; the memory is emptied when one of them is full.
REMEMBERED_WORDS, REMEMBERED_IDS = 300_000, 4_000_000
LARGEST_ID = (1 << 63) - 1
# Bytes of frames that a reader of whole files takes at once; a larger frame is taken alone.
RUN_BYTES = 4 << 20

# Letters that lower-case alone and stay as they are under composition: those of Latin-1.
_LATIN = "".join(chr(i) for i in range(0xDF, 0x100) if chr(i).isalpha())
_PLAIN = re.compile(rf"[!-~À-ÖØ-Þ{_LATIN}]+\Z")
# Fixed pattern: how the public word vocabulary splits such words in lower case.
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+")
# The same over many words, one in a line.
_LINES = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}\n]+")
# Words given to the whole pipeline of the library at once.
_WORDS_AT_ONCE = 2000


class WordEncoder:
    """Ids of whole texts by a tokenizer that never looks across white space, one distinct word at a time.

    Words already seen are looked up by their 64-bit hash. A word of printable ASCII and Latin-1 letters is further
    cut into the parts that this vocabulary treats alone, and each part goes straight to the library's model: so a
    word with other capitals or punctuation is not encoded again. All other words, and those that may hold a special
    token, go through the library's whole pipeline as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.mapped = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in _LATIN}
        self.splits = self._splits_like_parts()
        self._forget()

    def _splits_like_parts(self) -> bool:
        """Whether this vocabulary lower-cases, splits and maps bytes as assumed, tried on words that tell."""
        tries = ["It's", "WE'LL!", "a1b22c", "x--y''z", "don't.", "'S", "(Q)'re", "ÀÉîõüß,ÿ", "l'été2"]
        return all(self._library(w) == [i for p in _PARTS.findall(w.lower()) for i in self._model(p)] for w in tries)

    def _model(self, part: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(part if part.isascii() else part.translate(self.mapped))]

    def _library(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.places: dict[int, int] = {}
        self.words = _Lists()
        self.parts: dict[str, int] = {}
        self.part_ids = _Lists()

    def _plain(self, word: str) -> bool:
        return _PLAIN.match(word) is not None and not any(s in word for s in self.special)

    def _learn(self, keys: list[int], words: list[str]) -> None:
        """Remember the ids of new words: those of printable letters through their parts, all at once."""
        if self.splits and any(s in "\n".join(words) for s in self.special):
            plain = [self._plain(w) for w in words]
        else:
            plain = [self.splits and _PLAIN.match(w) is not None for w in words]
        chosen = [w for w, is_plain in zip(words, plain, strict=True) if is_plain]
        if chosen:
            cut = _LINES.findall("\n".join(chosen).lower())
            cut.append("\n")
            codes, distinct = pd.factorize(np.array(cut, dtype=object))
            known, model = self.parts, self._model
            fresh = [p for p in distinct if p not in known]
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            self.part_ids.add([model(p) if p != "\n" else [] for p in fresh])
            at = np.fromiter((known[p] for p in distinct), dtype=np.int64, count=len(distinct))[codes]
            ids, sizes = self.part_ids.take(at)
            ends = np.flatnonzero(codes == codes[-1])
            total = np.cumsum(sizes)[ends]
            self.words.add_flat(ids, np.diff(total, prepend=0))
        whole = [w for w, is_plain in zip(words, plain, strict=True) if not is_plain]
        for i in range(0, len(whole), _WORDS_AT_ONCE):
            found = self.library.encode_batch_fast(whole[i : i + _WORDS_AT_ONCE], add_special_tokens=False)
            self.words.add([f.ids for f in found])
        order = [k for k, is_plain in zip(keys, plain, strict=True) if is_plain]
        order += [k for k, is_plain in zip(keys, plain, strict=True) if not is_plain]
        self.places.update(zip(order, range(len(self.places), len(self.places) + len(order)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each text; a null text has none."""
        if len(self.places) > REMEMBERED_WORDS or self.words.used + self.part_ids.used > REMEMBERED_IDS:
            self._forget()
        found = find_words(texts)
        codes, distinct = pd.factorize(found.hashes())
        keys = distinct.tolist()
        known = self.places
        unknown = [i for i, k in enumerate(keys) if k not in known]
        if unknown:
            first = np.full(len(keys), -1, dtype=np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            self._learn([keys[i] for i in unknown], _texts(found, first[unknown]))
        at = np.fromiter((known[k] for k in keys), dtype=np.int64, count=len(keys))[codes]
        ids, sizes = self.words.take(at)
        total = np.concatenate(([0], np.cumsum(sizes)))
        return ids, np.diff(total[found.rows])


def _texts(found, which: np.ndarray) -> list[str]:
    """Words as text: their bytes one after another, a line each, decoded once. No word holds a line end."""
    sizes = found.ends[which] - found.starts[which]
    raw = np.append(found.data, np.uint8(10))[ranges(found.starts[which], sizes + 1)]
    raw[np.cumsum(sizes + 1) - 1] = 10
    return raw.tobytes().decode().split("\n")[:-1]


class _Lists:
    """Id lists in one growing array."""

    def __init__(self):
        self.ids = np.empty(1 << 16, dtype=np.uint32)
        self.starts, self.sizes = np.empty(1 << 12, dtype=np.int64), np.empty(1 << 12, dtype=np.int64)
        self.used = self.count = 0

    def add(self, lists: list) -> None:
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        self.add_flat(np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(sizes.sum())), sizes)

    def add_flat(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids = self._room(self.ids, self.used, len(ids))
        self.starts, self.sizes = self._room(self.starts, self.count, len(sizes)), self._room(self.sizes, self.count, len(sizes))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[self.count : self.count + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.count : self.count + len(sizes)] = sizes
        self.used, self.count = self.used + len(ids), self.count + len(sizes)

    @staticmethod
    def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
        if used + more <= len(array):
            return array
        return np.concatenate((array[:used], np.empty(max(used, more), dtype=array.dtype)))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[at]
        return self.ids[ranges(self.starts[at], sizes)], sizes


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class FrameWriter:
    """Writes the frames of one file to an open binary sink."""

    def __init__(self, sink):
        self.sink = sink
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        content = tokens.astype("<u4").tobytes()
        frame = self.compressor.compress(content)
        self.sink.write(frame)
        self.entries.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        ids = np.array([0 if i is None else i for i in self.ids], dtype="<i8").tobytes()
        nulls = bytes(i is None for i in self.ids)
        self.sink.write(_skippable(SKIPPABLE_IDS, self.compressor.compress(ids + nulls)))
        table = np.array(self.entries, dtype="<u4").tobytes()
        self.sink.write(_skippable(SKIPPABLE_TABLE, table + struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEK_MAGIC)))


@dataclass
class FrameReader:
    """Random access to one file through an open binary source."""

    source: object

    def __post_init__(self):
        size = self.source.seek(0, 2) or self.source.tell()
        count, _, magic = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end of the file")
        table_at = size - 9 - 12 * count - 8
        self.entries = np.frombuffer(self._bytes(table_at + 8, 12 * count), dtype="<u4").reshape(count, 3).astype(np.int64)
        self.places = np.concatenate(([0], np.cumsum(self.entries[:, 0])))
        ids_at = int(self.places[-1])
        self.decompressor = zstandard.ZstdDecompressor()
        raw = self.decompressor.decompress(self._bytes(ids_at + 8, table_at - ids_at - 8))
        values = np.frombuffer(raw[: 8 * count], dtype="<i8").tolist()
        self.ids = [None if gone else v for v, gone in zip(values, raw[8 * count :], strict=True)]

    def _bytes(self, at: int, size: int) -> bytes:
        self.source.seek(int(at))
        return self.source.read(int(size))

    def tokens(self, i: int) -> np.ndarray:
        """Ids of the i-th document; a frame that does not fit its checksum is an error."""
        return self._content(i, self._bytes(self.places[i], self.entries[i, 0]))

    def every(self) -> Iterator[np.ndarray]:
        """Ids of all documents in order; frames are read in runs of ``RUN_BYTES``."""
        first = 0
        while first < len(self.entries):
            last = max(first + 1, int(np.searchsorted(self.places, self.places[first] + RUN_BYTES, side="right")) - 1)
            run = memoryview(self._bytes(self.places[first], self.places[last] - self.places[first]))
            for i in range(first, last):
                at = int(self.places[i] - self.places[first])
                yield self._content(i, run[at : at + int(self.entries[i, 0])])
            first = last

    def _content(self, i: int, frame: bytes | memoryview) -> np.ndarray:
        _, size, check = self.entries[i].tolist()
        content = self.decompressor.decompress(frame, max_output_size=max(size, 1))
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"damaged frame {i}")
        return np.frombuffer(content, dtype="<u4")


def _open(path: str, mode: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    if mode == "w":
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(name, compression=None)
    return system.open_input_file(name)


def vocabulary(name: str = "word_bpe_49k.json") -> Callable[[], str]:
    """Finds the public vocabulary file where a task runs."""

    def find() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return find


def write_token_files(docs: DataFrame, folder: str, path: Callable[[], str], end_id: int = 2, files: int | None = None) -> DataFrame:
    """Encode every text, append ``end_id`` to each, and write files in ascending doc_id order.

    Returns the written list of files: ``(part, file, n_docs, n_tokens)``; part numbers ascend with the ids. A null
    or empty text is the end id alone. A null id sorts after all others and is kept as null. Rows that repeat an
    id stand next to each other, ordered by text. Other columns are ignored. An empty table gives no file.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LARGEST_ID)).alias("at"),
        F.col("doc_id").isNull().alias("no_id"),
        F.xxhash64("text").alias("tie"),
    )
    if files is None:
        total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8)).first()[0] or 0
        files = max(1, -(-total // BYTES_PER_FILE))
    order = ["at", "no_id", "tie", "text"]
    # Ranges are split on short columns only, so no text is sampled to the driver.
    dealt = sized.repartitionByRange(files, "at", "no_id", "tie").sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path()).encode
        writer = sink = None
        n_tokens = 0
        for batch in batches:
            for piece in pieces(batch, limit=ENCODED_BYTES):
                if writer is None:
                    name = f"{folder}/tokens-{uuid.uuid4().hex}.zst"
                    sink = _open(name, "w")
                    writer = FrameWriter(sink)
                ids, counts = encode(piece.column("text"))
                at = 0
                for doc_id, n in zip(piece.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                    writer.add(doc_id, np.append(ids[at : at + n], np.uint32(end_id)))
                    at += n
                n_tokens += len(ids) + len(counts)
        if writer is not None:
            writer.close()
            sink.close()
            # The process goes on to other tasks; what this one has learnt need not stay.
            encoder(path())._forget()
            row = [[TaskContext.get().partitionId()], [name], [len(writer.ids)], [n_tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1]), *map(pa.array, row[2:])], ["part", "file", "n_docs", "n_tokens"])

    return kept(dealt.mapInArrow(run, "part int, file string, n_docs long, n_tokens long"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document of the listed files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it; files are few, so their running total is one small window.
    """
    from pyspark.sql import Window

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("part", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))
    dealt = placed.repartition(max(1, files.count()), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["file"], "r") as source:
                    reader = FrameReader(source)
                    sizes = reader.entries[:, 1] // 4
                    starts = row["first"] + np.concatenate(([0], np.cumsum(sizes)[:-1]))
                    checks = [zlib.crc32(ids) for ids in reader.every()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.ids, pa.int64()), pa.array(starts), pa.array(sizes), pa.array(checks, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, path: Callable[[], str], end_id: int = 2) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and describe every document as read back."""
    session: SparkSession = docs.sparkSession
    return read_token_files(write_token_files(docs, fresh_path(session, "tokens"), path, end_id))
