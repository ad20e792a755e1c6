import io
import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from vectorlens.llm import token_files
from vectorlens.llm.token_files import FrameReader, FrameWriter, WordEncoder, vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary()())


def test_words_encode_as_whole_texts(library, corpus):
    texts = [r[1] for r in corpus if r[1] is not None and len(r[1]) < 5000]
    texts += ["It's DON'T we'll 'S x'y", "a1b2 3.14, (e.g.) --- _ ~", "Éa ß İI Σας ẛ̣ é", "<|endoftext|>a x<|startoftext|>", "a b c　d\x1ce\x85f"]
    import pyarrow as pa

    encode = WordEncoder(vocabulary()())
    assert encode.splits
    for _ in range(2):
        ids, counts = encode.encode(pa.array([*texts, None, ""]))
        assert counts[-2:].tolist() == [0, 0]
        at = 0
        for text, n in zip(texts, counts.tolist(), strict=False):
            assert ids[at : at + n].tolist() == library.encode(text, add_special_tokens=False).ids, text
            at += n
        encode._forget()


def test_digest(documents, corpus, library, monkeypatch):
    rows = [*[r for r in corpus if len(r[1] or "") < 5000], (None, "no id"), (3, "repeated id"), (-4, "below zero")]
    random_order = sorted(rows, key=lambda r: zlib.crc32(repr(r).encode()))
    monkeypatch.setattr(token_files, "BYTES_PER_FILE", 6000)
    found = sorted(map(tuple, token_files.token_digest(documents(random_order), vocabulary()).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [*sorted(r[0] for r in rows if r[0] is not None), None]
    start = 0
    texts = {r[0]: r[1] for r in rows}
    for doc_id, at, n, check in found:
        assert at == start
        start += n
        if doc_id != 3:
            ids = np.array([*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2], dtype="<u4")
            assert (n, check) == (len(ids), zlib.crc32(ids.tobytes()))


def test_frames_are_independent_and_checked():
    sink = io.BytesIO()
    writer = FrameWriter(sink)
    documents = [np.arange(n, dtype=np.uint32) for n in (5, 1, 1000, 0)]
    for i, tokens in enumerate(documents):
        writer.add(None if i == 1 else i * 7, tokens)
    writer.close()
    data = sink.getvalue()
    reader = FrameReader(io.BytesIO(data))
    assert reader.ids == [0, None, 14, 21]
    assert reader.tokens(2).tolist() == documents[2].tolist() and reader.tokens(3).tolist() == []
    whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)
    assert whole == b"".join(d.astype("<u4").tobytes() for d in documents)
    broken = bytearray(data)
    broken[int(reader.places[2]) + 8] ^= 0xFF
    bad = FrameReader(io.BytesIO(bytes(broken)))
    assert bad.tokens(0).tolist() == documents[0].tolist()
    with pytest.raises((ValueError, zstandard.ZstdError)):
        bad.tokens(2)
    with pytest.raises(ValueError):
        FrameReader(io.BytesIO(data[:-1]))


def test_empty(documents):
    assert token_files.token_digest(documents([]), vocabulary()).collect() == []
