import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from vectorlens.llm import ngram_join
from vectorlens.llm.words import WORD, find_words, folded_shingles, shingle_sets


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width=4):
    words = re.findall(WORD, fold(text))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_force(rows, percent=85):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    links = set()
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                links.add((frozenset(sets[i]), frozenset(sets[j])))
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    firsts = {}
    for g, r in zip(group, rows, strict=True):
        if r[0] is not None:
            firsts[g] = min(firsts.get(g, r[0]), r[0])
    return sorted(((r[0], len(s), firsts.get(g) if s else r[0]) for r, s, g in zip(rows, sets, group, strict=True)), key=repr)


def result(df, percent=85):
    found = ngram_join.near_classes(df, 4, percent).select("doc_id", "n_shingles", "component_id")
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_same_components_as_all_pairs(documents, corpus):
    rows = [*corpus, (60, corpus[60][1]), (7, corpus[3][1]), (None, corpus[4][1]), (None, "only here")]
    assert result(documents(rows)) == brute_force(rows)


def test_long_lists_and_heavy_tokens(documents, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL_LIST", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "WORDS_PER_TASK", 3000)
    monkeypatch.setattr(ngram_join, "BROADCAST_TEXT_KEYS", 0)
    for percent in (85, 60, 95):
        assert result(documents(corpus), percent) == brute_force(corpus, percent)


def test_pairs_inside_a_group_are_not_all_emitted(documents, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL_LIST", 4)
    found = ngram_join.ngram_join(documents(corpus[60:150]), 4, 60)
    assert found.links.count() < 90 * 89 / 4


def numbers_of_links(rows, percent):
    sets = {frozenset(shingles(r[1])) for r in rows} - {frozenset()}
    linked = {x: sum(x != y and 100 * len(x & y) >= percent * len(x | y) for y in sets) for x in sets}
    return sorted(((r[0], linked.get(frozenset(shingles(r[1])), 0)) for r in rows), key=repr)


def test_every_link_of_a_group_is_counted(documents, corpus, monkeypatch):
    rows = [*corpus, (60, corpus[60][1]), (7, corpus[3][1]), (None, corpus[4][1])]
    # Blocks of the given size, and of a few nodes; all lists short, and all long.
    for small, block, cells, percent in ((64, 512, 4_000_000, 85), (4, 16, 500, 85), (4, 16, 500, 60), (1, 512, 500, 60)):
        monkeypatch.setattr(ngram_join, "SMALL_LIST", small)
        monkeypatch.setattr(ngram_join, "COUNT_BLOCK", block)
        monkeypatch.setattr(ngram_join, "COUNT_CELLS", cells)
        found = ngram_join.near_classes(documents(rows), 4, percent).select("doc_id", "n_links").collect()
        assert sorted((tuple(r) for r in found), key=repr) == numbers_of_links(rows, percent)


def test_overlaps_against_sets(monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNT_CELLS", 50)
    random = np.random.RandomState(6)
    draw = lambda: np.unique(np.concatenate((np.arange(5), random.randint(0, 4000, random.randint(1, 300))))).astype(np.uint64)
    left, right = [draw() for _ in range(30)], [draw() for _ in range(40)]
    assert ngram_join.overlaps(left, right).tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]
    assert ngram_join.overlaps(left, []).shape == (30, 0)


def test_empty_table(documents):
    assert result(documents([])) == []


def test_prefix_needs_more_matches_where_postings_are_costly():
    cheap, costly = np.ones(100), np.concatenate((np.ones(10), np.full(90, 1000.0)))
    assert ngram_join.choose_prefix(cheap, 100, 85) == (1, 16)
    need, length = ngram_join.choose_prefix(costly, 100, 85)
    assert need > 1 and length == 15 + need


def test_words_are_those_of_the_pattern():
    import pyarrow as pa

    texts = ["a  b\x0bc", "", None, " x", "y ", "\xa0z \x1c é漢 ", "longer-than-eight-bytes longer-than-eight-bytez"]
    found = find_words(pa.array(texts))
    expected = [re.findall(WORD, t or "") for t in texts]
    assert found.counts.tolist() == [len(w) for w in expected]
    flat = [w for row in expected for w in row]
    assert [found.text(i).decode() for i in range(len(flat))] == flat
    assert len(set(found.hashes().tolist())) == len(set(flat))


def test_few_edges_are_joined_without_an_exchange(spark, monkeypatch):
    """A chain over many batches takes no star rounds while a task can hold its edges; beyond, both ways agree."""
    from vectorlens.llm import components

    edges = spark.range(1, 400, numPartitions=16).selectExpr("id AS a", "id % 130 AS b").filter("a <> 131")
    stars, large_star = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda e: stars.append(1) or large_star(e))

    def labels():
        return sorted(map(tuple, components.connected_components(edges).collect()))

    found = labels()
    assert not stars and {n for n, _ in found} == set(range(400)) - {131}
    assert all(c == n % 130 for n, c in found if n >= 130)
    monkeypatch.setattr(components, "EDGES_PER_TASK", 3)
    assert labels() == found and stars


def test_words_of_a_piece_are_not_found_at_once():
    """A worker holds the sets of a piece and the words of a part of it, not all its words."""
    random.seed(8)
    some = [" ".join(str(random.random())[2:8] for _ in range(3000)) for _ in range(20)]
    texts = pa.array([some[i % 20] + f" {i}" for i in range(360)] + [None, "", "One"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(363)), pa.array(range(363)), texts], ["doc_id", "text_key", "text"])
    sets = folded_shingles(texts, 5)
    assert [s.tolist() for s in sets] == [s.tolist() for s in shingle_sets(find_words(texts, fold=True), 5)]

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            tracemalloc.start()
            sizes = [n for part in run(iter([batch])) for n in part.column("n").to_pylist()]
            return sizes, tracemalloc.get_traced_memory()[1], tracemalloc.stop()

    sizes, peak, _ = ngram_join._members(Docs(), 5)
    assert sizes == [len(s) for s in sets] and peak < 40 << 20
