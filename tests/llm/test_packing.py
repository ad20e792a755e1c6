import random
import zlib

import pytest

from vectorlens.llm import packing, tables


def plain_best_fit(runs, capacity):
    rooms = []
    for size in sorted((s for s, c in runs for _ in range(c)), reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= size]
        if fits:
            rooms[min(fits)[1]] -= size
        else:
            rooms.append(capacity - size)
    return rooms


@pytest.mark.parametrize("seed", range(8))
def test_runs_place_as_one_by_one(seed):
    random.seed(seed)
    runs = [(s, random.randint(1, 9)) for s in random.sample(range(1, 90), 25)]
    placed = packing.best_fit_decreasing(runs, 100)
    rooms = plain_best_fit(runs, 100)
    filled = [100] * len(rooms)
    for size, place, count in placed:
        filled[place] -= size * count
    assert filled == rooms and sum(c for _, _, c in placed) == sum(c for _, c in runs)


def test_too_few_bins_and_too_large_groups():
    assert packing.best_fit_decreasing([(6, 3)], 10, 2) is None
    assert packing.best_fit_decreasing([(11, 1)], 10) is None


def test_report(documents, corpus, monkeypatch):
    rows = [*corpus, (None, "no id"), (5, "again"), (5, "again"), (191, None)]
    found = packing.shard_report(documents(rows)).collect()
    assert len(found) == len(rows)
    texts = {r[0]: r[1] for r in rows if r[0] not in (None, 5)}
    home, shards = {}, {}
    for r in found:
        if r["doc_id"] in texts:
            raw = (texts[r["doc_id"]] or "").encode()
            assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
            assert home.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]
        shards.setdefault(r["shard"], []).append(r)
    assert set(shards) <= set(range(8))
    for members in shards.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    total = {s: sum(r["size"] for r in members) for s, members in shards.items()}
    largest = 20_000 * 9
    assert max(total.values()) <= max(sum(total.values()) / 8 * 1.01, largest)
    monkeypatch.setattr(tables, "ROWS_PER_BUCKET", 5)
    again = packing.shard_report(documents(rows)).collect()
    assert sorted((repr(r["doc_id"]), r["text_crc32"], r["size"]) for r in again) == sorted((repr(r["doc_id"]), r["text_crc32"], r["size"]) for r in found)
    for s in range(8):
        assert sorted(r["slot"] for r in again if r["shard"] == s) == list(range(sum(r["shard"] == s for r in again)))


def test_fixed_capacity_uses_few_shards(documents):
    rows = [(i, "w" * (10 + i % 50)) for i in range(300)]
    found = packing.shard_documents(documents(rows), capacity=1000).groupBy("shard").sum("size").collect()
    total = sum(r[1] for r in found)
    assert max(r[1] for r in found) <= 1000 and len(found) <= total / 1000 * 1.25 + 1


def test_equal_sizes_on_even_input(documents):
    found = packing.shard_report(documents([(i, f"text {i:05d}") for i in range(800)])).groupBy("shard").sum("size").collect()
    assert len(found) == 8 and max(r[1] for r in found) - min(r[1] for r in found) <= 11


def test_empty(documents):
    assert packing.shard_report(documents([])).collect() == []
