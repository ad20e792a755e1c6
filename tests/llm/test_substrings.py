import hashlib
import random
import re

import pytest

from vectorlens.llm import substrings
from vectorlens.llm.words import WORD


def brute_force(rows, window=20):
    order = lambda i: (i is None, i)
    words = [re.findall(WORD, r[1] or "") for r in rows]
    first = {}
    for r, w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            place = (*order(r[0]), i)
            first[tuple(w[i : i + window])] = min(place, first.get(tuple(w[i : i + window]), place))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (*order(r[0]), i):
                gone |= set(range(i, i + window))
        text = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, substrings.dedup_digest(df).collect()), key=repr)


@pytest.fixture(scope="module")
def repeating(corpus):
    random.seed(5)
    passage = [f"p{i}" for i in range(60)]
    rows = list(corpus)
    for i in range(200, 240):  # passages cut at both ends, one word changed in some
        a, b = sorted(random.sample(range(61), 2))
        part = passage[a:b]
        if part and i % 3 == 0:
            part[random.randrange(len(part))] = "changed"
        rows.append((i, "\n".join([f"l{i}", *part, f"r{i}", *passage[:a]])))
    rows.append((240, " ".join(["same"] * 90)))
    rows.append((241, " ".join(["u", "v", "w"] * 40)))
    rows.append((-1, corpus[62][1]))
    rows += [(None, corpus[63][1]), (None, "nobody's words"), (61, corpus[61][1])]
    return rows


def test_against_all_windows(documents, repeating):
    assert result(documents(repeating)) == brute_force(repeating)


def test_frequent_anchors_and_many_tasks(documents, repeating, monkeypatch):
    monkeypatch.setattr(substrings, "FREQUENT_IN_TASK", 2)
    monkeypatch.setattr(substrings, "FREQUENT_IN_ALL", 2)
    monkeypatch.setattr(substrings, "ROWS_PER_TASK", 50)
    assert result(documents(repeating)) == brute_force(repeating)


def test_repeated_id_with_another_text(documents, corpus):
    rows = [(1, corpus[62][1]), (1, "x " + corpus[62][1]), (0, "y")]
    found = result(documents(rows))
    assert found == brute_force(rows)


def test_empty(documents):
    assert result(documents([])) == []
    assert result(documents([(1, None), (2, "")])) == brute_force([(1, None), (2, "")])
