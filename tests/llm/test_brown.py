import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vectorlens.llm import brown

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = {"context_size": 60, "n_classes": 8, "rounds": 4}


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute_base(rows):
    texts = [(i, WORD.findall((text or "").translate(FOLD)) + [None]) for i, text, *_ in rows]
    counts = Counter()
    for i, words in texts:
        if not is_held(i):
            counts.update(words)
    total, kinds = sum(counts.values()), len(counts)
    return sorted(
        (
            (i, is_held(i), len(w), sum(x in counts for x in w), total, round(sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w), 4))
            for i, w in texts
        ),
        key=repr,
    )


def base_of(rows):
    return sorted(
        ((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows), key=repr
    )


def sentences(n, seed=3):
    """Texts in which a kind of word always follows another kind."""
    draw = random.Random(seed)
    kinds = [[f"{c}{i}" for i in range(40)] for c in "abc"]
    return [(i, " ".join(draw.choice(kinds[j % 3]) for j in range(draw.randint(3, 40))), "xx", "s") for i in range(n)]


def test_base_columns_against_brute_force(documents, corpus):
    rows = corpus[:80] + corpus[150:] + [(None, "no id", None, None), (None, "no id", None, None), corpus[5], (corpus[5][0], "Other", None, None)]
    got = brown.score_report(documents(rows), **SMALL).collect()
    assert base_of(got) == brute_base(rows)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_held_out_texts_are_better_predicted_than_by_the_base(documents):
    got = [r for r in brown.score_report(documents(sentences(400)), **SMALL).collect() if r["held_out"]]
    assert got and sum(r["score"] for r in got) > sum(r["base_score"] for r in got) + 0.3 * sum(r["n_tokens"] for r in got)


def test_model_is_a_distribution_and_scores_follow_it(documents):
    rows = sentences(120, seed=8)
    model = brown.train(documents(rows), **SMALL)
    table = brown.smoothed(model.transitions)
    used = model.vocabulary.classes > 0
    np.testing.assert_allclose(table[np.append(used, True)][:, used].sum(axis=1), 1.0)
    np.testing.assert_array_equal(model.transitions.sum(axis=0), model.vocabulary.classes)
    classes = {}
    docs = {r["doc_id"]: r for r in model.documents.collect()}
    counts = Counter(w for i, t, *_ in rows if not is_held(i) for w in [*t.split(), None])
    for i, text, *_ in rows:
        for word, kind in zip([*text.split(), None], docs[i]["classes"], strict=True):
            assert classes.setdefault(word, kind) == kind  # one class for each word
    new, old = math.log10(model.vocabulary.unseen), math.log10(1 - model.vocabulary.unseen)
    scores = {r["doc_id"]: r["score"] for r in model.scores().collect()}
    for i, text, *_ in rows:
        before, expected = 0, 0.0
        for word in [*text.split(), None]:
            kind = classes[word]
            if kind == brown.UNKNOWN:
                expected += new
            else:
                inside = counts[word] / model.vocabulary.classes[kind]
                expected += old + math.log10(table[min(before, len(table) - 1)][kind] * inside)
            before = kind
        assert scores[i] == pytest.approx(expected, abs=1e-8)


def test_exchange_finds_the_best_class_of_a_word():
    draw = random.Random(1)
    words = list(range(12))
    text = [draw.choice(words) for _ in range(3000)]
    classes = [0, *[1 + w % 4 for w in words[1:]]]
    pairs = Counter(zip(text, text[1:] + text[:1]))

    def matrix(kinds):
        out = np.zeros((5, 5))
        for (a, b), n in pairs.items():
            out[kinds[a], kinds[b]] += n
        return out

    for word in words[1:]:
        now = matrix(classes)
        left, right = np.zeros(5), np.zeros(5)
        for (a, b), n in pairs.items():
            left[classes[a]] += n * (b == word)
            right[classes[b]] += n * (a == word)
        found = brown.best_class(now, classes[word], left, right, float(pairs[word, word]))
        tried = [brown.likelihood(matrix([*classes[:word], c, *classes[word + 1 :]])) for c in range(1, 5)]
        assert tried[found - 1] == pytest.approx(max(tried), rel=1e-12)


def test_rounds_never_lower_the_likelihood(documents):
    seen = brown.train(documents(sentences(200)), **SMALL).context.likelihoods
    assert len(seen) > 1 and seen == sorted(seen)


def test_exchange_separates_the_kinds(documents):
    context = brown.train(documents(sentences(300)), context_size=200, n_classes=8, rounds=8).context
    from vectorlens.llm.words import find_words
    import pyarrow as pa

    names = [f"{c}{i}" for c in "abc" for i in range(40)]
    hashes = dict(zip(find_words(pa.array([" ".join(names)])).hashes().tolist(), names, strict=True))
    by_class = {}
    for word, kind in zip(context.words.tolist()[1:], context.classes[1:-1].tolist(), strict=True):
        by_class.setdefault(kind, []).append(hashes[word][0])
    wrong = sum(len(m) - max(Counter(m).values()) for m in by_class.values())
    assert wrong <= 12


def test_packed_arrays_return():
    given = [np.arange(5, dtype="u8"), np.array([], dtype="i4"), np.array([7, 255], dtype="u1")]
    for a, b in zip(given, brown.unpack(brown.pack(*given), "u8", "i4", "u1"), strict=True):
        np.testing.assert_array_equal(a, b)


def test_no_document_to_learn_from_and_empty_table(documents):
    held = [i for i in range(60) if is_held(i)][:3]
    got = brown.score_report(documents([(i, "a b", None, None) for i in held]), **SMALL).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(0, 0, 0.0)] * 3
    assert all(r["score"] == pytest.approx(3 * math.log10(0.5)) for r in got)
    assert brown.score_report(documents([]), **SMALL).collect() == []


def test_many_pieces_and_buckets(documents, corpus, monkeypatch):
    monkeypatch.setattr(brown, "WORDS_PER_BUCKET", 700)
    docs = documents(corpus[:60] + corpus[180:]).repartition(5)
    assert base_of(brown.score_report(docs, **SMALL).collect()) == brute_base(corpus[:60] + corpus[180:])


def test_context_is_counted_over_all_pieces(spark):
    """A word that is rare in some pieces, or in all of them, counts as often as it occurs."""
    fill = [[f"{side}{i}" for i in range(20_000)] for side in "xy"]
    first, second = fill[0] + ["a"] * 5 + ["b"] * 4 + ["c"] * 6 + ["d"], fill[1] + ["a"] * 2 + ["b"] * 4 + ["d"]
    ids = [i for i in range(50) if not is_held(i)][:2]
    docs = spark.createDataFrame(list(zip(ids, [" ".join(first), " ".join(second)], strict=True)), "doc_id long, text string").repartition(2, "doc_id")
    words, total = brown.context_words(brown.training_rows(docs), 5)
    names = brown.find_words(brown.pa.array(["b a c d"])).hashes()
    assert words.tolist() == [int(brown.END), *names.tolist()]
    assert total >= 40_006
