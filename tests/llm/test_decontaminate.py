import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from vectorlens.llm import decontaminate
from vectorlens.llm.words import rolling


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(["ka", "lo", "mi", "ru", "te", "so", "an", "el"]) for _ in range(rng.randint(1, 5))) for _ in range(n)]


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string, node string, words string")


@pytest.fixture(scope="module")
def case():
    items = [(i, " ".join(words(12 + 5 * i, 1000 + i)), "x", "y") for i in range(12)]
    rng = random.Random(1)
    rows, planted = [], set()
    for i in range(120):
        text = words(rng.randint(60, 300), i)
        kind = i % 6
        if kind < 4:
            leak = items[i % 12][1].split()
            if kind == 1:  # capitals and punctuation
                leak = [w.upper() + "," for w in leak]
            if kind == 2:  # one word in eight changed, one in ten added
                leak = [x for w in leak for x in ([w] if rng.random() > 0.125 else ["other"]) + (["um"] if rng.random() < 0.1 else [])]
            if kind == 3:  # the same words in another order
                rng.shuffle(leak)
            else:
                planted.add((i, i % 12))
            at = rng.randint(0, len(text))
            text[at:at] = leak
        rows.append((i, " ".join(text)))
    return items, rows, planted


def test_planted_items_are_found_and_others_left(spark, documents, case):
    items, rows, planted = case
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leak_report(documents(rows), bench(spark, items)).collect()}
    assert found == planted


def test_parts_and_odd_rows(spark, documents, case, monkeypatch):
    items, rows, planted = case
    monkeypatch.setattr(decontaminate, "PART_BYTES", 900)
    odd = [(None, "pre " + items[3][1]), (900, None), (901, ""), (0, "clean words"), rows[1], rows[1], (902, "long " * 30_000 + items[2][1])]
    more = [*items, (50, None, "x", "y"), (51, "", "x", "y"), (52, "too short", "x", "y"), items[0], (None, items[5][1], "x", "y")]
    df = documents(rows + odd)
    found = [(r["doc_id"], r["item_id"]) for r in decontaminate.leak_report(df, bench(spark, more)).collect()]
    known = {f for f in found if f[1] is not None}
    assert known == planted | {(None, 3), (902, 2)} and len(found) == len(set(found))
    assert {d for d, i in found if i is None} == {d for d, i in planted if i == 5}
    kept = decontaminate.without_leaks(df, bench(spark, more))
    assert kept.columns == df.columns
    dirty = {d for d, _ in planted}
    left = sorted((r["doc_id"], r["text"] or "") for r in kept.collect() if r["doc_id"] is not None)
    assert left == sorted((d, t or "") for d, t in rows + odd if d is not None and (d not in dirty or t == "clean words") and d != 902)


def test_every_verbatim_item_is_found(spark, documents):
    # Many short items against the fixed rank, items under five words, and items in a script without spaces.
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(600)]
    items = [(i, " ".join(rng.sample(vocabulary, rng.choice([5, 6, 8]))), "x", "y") for i in range(1500)]
    items += [(2000, "zeta Eta", "x", "y"), (2001, "theta", "x", "y"), (2002, "漢字仮名交", "x", "y"), (2003, "漢字", "x", "y")]
    rows = [(i, " ".join([*rng.choices(vocabulary, k=25), items[i][1], *rng.choices(vocabulary, k=25)])) for i in range(300)]
    rows += [(5000, "a zeta, eta b"), (5001, "a eta zeta"), (5002, "z theta-z"), (5003, "前漢字仮名交後"), (5004, "zeta"), (5005, "eta")]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leak_report(documents(rows), bench(spark, items)).collect()}
    assert {(i, i) for i in range(300)} <= found
    assert {f for f in found if f[1] >= 2000} == {(5000, 2000), (5002, 2001), (5003, 2002), (5003, 2003)}


def test_empty(spark, documents, case):
    items, rows, _ = case
    assert decontaminate.leak_report(documents([]), bench(spark, items)).collect() == []
    assert decontaminate.leak_report(documents(rows[:3]), bench(spark, [])).collect() == []


def test_weighted_subsequence_against_recursion():
    rng = np.random.RandomState(3)
    for _ in range(20):
        item, passage = rng.randint(0, 5, 8), rng.randint(0, 5, 12)
        weight = rng.rand(5)[item]

        def best(i, j, item=item, passage=passage, weight=weight):
            if i == len(item) or j == len(passage):
                return 0.0
            same = weight[i] + best(i + 1, j + 1) if item[i] == passage[j] else 0.0
            return max(same, best(i + 1, j), best(i, j + 1))

        assert decontaminate.weighted_lcs(item, passage, weight) == pytest.approx(best(0, 0))


def test_axes_span_the_main_singular_vectors(spark, documents, case):
    items, rows, _ = case
    from vectorlens.llm.tables import with_text_key

    docs = with_text_key(documents(rows))
    part = next(decontaminate._parts(bench(spark, items)))
    weighted = decontaminate._weighted(docs, part)
    passages = decontaminate._passages(docs, weighted)
    axes = decontaminate.latent_axes(passages, weighted)
    texts = [np.array(r["words"]) for r in passages.collect()] + [decontaminate._positions(part.vocabulary, w) for w in part.words]
    row, feature, value = decontaminate.tfidf(texts, weighted.idf)
    dense = np.zeros((len(texts), decontaminate.FEATURES))
    np.add.at(dense, (row, feature), value)
    whole = np.linalg.svd(dense, compute_uv=False)
    assert np.allclose(axes.T @ axes, np.eye(decontaminate.RANK), atol=1e-8)
    held = np.linalg.norm(dense @ axes) ** 2
    assert held >= 0.95 * (whole[: decontaminate.RANK] ** 2).sum()


def test_words_of_few_texts_are_held_at_once():
    """A worker's memory does not grow with the texts of a batch, and what it finds does not depend on the cut."""
    random = np.random.RandomState(4)
    texts = [" ".join(map(str, random.randint(10**5, 10**6, size=3000))) for _ in range(300)] + [None, "", "one two three"]
    vocabulary = decontaminate.normalized_words(pa.array([" ".join(texts[:3])])).hashes()
    batch = pa.RecordBatch.from_arrays([pa.array(range(303)), pa.array(range(303)), pa.array(texts)], ["doc_id", "text_key", "text"])
    grams = np.sort(rolling(vocabulary, 5)[[7, 4000]])

    class Docs:
        class sparkSession:  # noqa: N801
            class sparkContext:  # noqa: N801
                @staticmethod
                def broadcast(value):
                    return type("Shared", (), {"value": value})

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            tracemalloc.start()
            out = sorted((r["doc_id"], r["item_id"]) for part in run(iter([batch])) for r in part.to_pylist())
            return out, tracemalloc.get_traced_memory()[1], tracemalloc.stop()

    out, peak, _ = decontaminate._short_leaks(Docs(), {5: (grams, [1, 2])}, "")
    assert [d for d, _ in out] == [0, 1] and {i for _, i in out} == {1, 2} and peak < 30 << 20


def normal(text):
    return "".join(c if c.isalnum() else " " for c in text).lower().split()


def passages_of(text, size):
    found = normal(text)
    return [found[i : i + 2 * size] for i in range(0, len(found), size)]


def item_class(item):
    size = decontaminate.BLOCK_WORDS
    while size < len(normal(item)):
        size *= 2
    return size


def test_a_leak_without_most_of_the_rarest_words_is_found(spark, documents):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(600)]
    item = rng.sample(vocabulary, 52)
    for i in range(8):
        item.insert(7 * i, f"rare{i}")
    leak = ["other" if w in {f"rare{i}" for i in range(6)} else w for w in item]
    rows = [(i, " ".join(rng.choices(vocabulary, k=100))) for i in range(200)]
    rows += [(500, " ".join([*rng.choices(vocabulary, k=25), *leak, *rng.choices(vocabulary, k=25)]))]
    rows += [(501, " ".join([*rng.choices(vocabulary, k=25), *rng.sample(leak, len(leak))]))]
    found = decontaminate.leak_report(documents(rows), bench(spark, [(1, " ".join(item), "x", "y")])).collect()
    assert [(r["doc_id"], r["item_id"]) for r in found] == [(500, 1)] and 0.7 < found[0]["matched"] < 0.95


def test_leaks_are_those_of_all_passages_and_items(spark, documents):
    """Every pair of a passage and an item of its class compared, without answer words."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([6, 9, 20, 40]))), "x", "y") for i in range(12)]
    rows = []
    for i in range(60):
        kept = [w for w in items[i % 12][1].split() if rng.random() < rng.choice([0.6, 0.7, 0.8])]
        rows.append((i, " ".join([*rng.choices(vocabulary, k=rng.randint(0, 50)), *kept, *rng.choices(vocabulary, k=rng.randint(0, 50))])))
    docs = documents(rows)
    part = next(decontaminate._parts(bench(spark, items)))
    weighted = decontaminate._weighted(docs, part)
    from vectorlens.llm.tables import with_text_key

    idf = dict(zip(part.vocabulary.tolist(), weighted.idf.tolist(), strict=True))
    hashed = lambda found: decontaminate.normalized_words(pa.array([" ".join(found)])).hashes()
    wanted = {}
    for i, text in rows:
        for item, words, _, _ in items:
            own = hashed(normal(words))
            weight = np.array([idf[w] for w in own.tolist()])
            best = max(decontaminate.weighted_lcs(own, hashed(p), weight) / weight.sum() for p in passages_of(text, item_class(words)))
            if best >= decontaminate.MATCH_SHARE:
                wanted[i, item] = min(best, 1.0)
    found = {(r["doc_id"], r["item_id"]): r["matched"] for r in decontaminate.leak_report(docs, bench(spark, items)).collect()}
    assert found.keys() == wanted.keys() and len(wanted) > 40
    assert all(found[k] == pytest.approx(wanted[k], abs=1e-6) for k in wanted)
    # The decomposition takes all passages with a benchmark word: here, all there are.
    sizes = {item_class(words) for _, words, _, _ in items}
    all_passages = sorted((i, size, len(p)) for i, text in rows for size in sizes for p in passages_of(text, size))
    assert sorted((r["doc_id"], r["size"], len(r["words"])) for r in decontaminate._passages(with_text_key(docs), weighted).collect()) == all_passages


def test_products_and_meetings_by_slices(monkeypatch):
    rng = np.random.RandomState(2)
    idf = rng.rand(500) + 0.1
    words = [np.where(rng.rand(n) < 0.5, rng.randint(0, 8, n), rng.randint(0, 500, n)) for n in rng.randint(0, 30, 700)]
    row, feature, value = decontaminate.tfidf(words, idf)
    dense = np.zeros((len(words), decontaminate.FEATURES))
    np.add.at(dense, (row, feature), value)
    flat, lengths = np.concatenate(words), np.array([len(w) for w in words])
    right = rng.rand(decontaminate.FEATURES, 3)
    items = [np.sort(rng.choice(500, n, replace=False)) for n in rng.randint(5, 20, 50)]
    asked = decontaminate._asked(decontaminate.Items(list(range(50)), [i.astype(np.uint64) for i in items], np.arange(500, dtype=np.uint64), {}), idf, list(range(0, 50, 2)))
    row, word, _ = decontaminate._different(np.repeat(np.arange(len(words)), lengths), flat, 500)
    expected = {
        (p, m) for p, own in enumerate(words) for m, i in enumerate(range(0, 50, 2))
        if idf[np.intersect1d(own, items[i])].sum() >= decontaminate.MATCH_SHARE * idf[items[i]].sum()
    }
    for rows, of_words, meetings in ((2000, 1 << 17, 1 << 20), (64, 1 << 17, 100), (700, 200, 1)):
        monkeypatch.setattr(decontaminate, "SLICE_ROWS", rows)
        monkeypatch.setattr(decontaminate, "SLICE_WORDS", of_words)
        monkeypatch.setattr(decontaminate, "SLICE_MEETINGS", meetings)
        total = np.zeros_like(right)
        decontaminate._add_products(flat, np.cumsum(lengths) - lengths, lengths, idf, right, total)
        assert np.allclose(total, dense.T @ (dense @ right))
        assert np.allclose(decontaminate._latent(flat, np.cumsum(lengths) - lengths, lengths, idf, right), decontaminate._unit(dense @ right))
        found = [(p, m) for p, m in zip(*(side.tolist() for side in decontaminate._meetings(asked, row, word)), strict=True)]
        assert len(found) == len(set(found)) and expected <= set(found)
