import re

import pytest
from pyspark.sql import functions as F

from vectorlens.llm import mixing, tables
from vectorlens.llm.words import WORD


def targets(sizes, budget=1.5):
    """Share, stop at twice the source, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    fixed, total = {}, budget * sum(sizes.values())
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        given = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if given[s] > 2 * sizes[s]]
        if not above:
            return fixed | given
        fixed |= {s: 2.0 * sizes[s] for s in above}


def test_report_against_plain_python(documents, corpus):
    rows = [*corpus, (None, "a b c", None, "s9"), (300, "repeated id", None, "s9"), (300, "repeated id", None, "s9")]
    found = mixing.mix_report(documents(rows)).collect()
    sizes = {}
    for _, text, _, source in ((*r, None)[:4] for r in rows):
        sizes[source] = sizes.get(source, 0) + len(re.findall(WORD, text or ""))
    expected = targets(sizes)
    assert len(found) == len(rows)
    source_of = {r[0]: r[3] for r in corpus}
    taken = dict.fromkeys(sizes, 0)
    for row in found:
        source = source_of.get(row["doc_id"], "s9") if row["doc_id"] is not None else "s9"
        assert row["source_size"] == sizes[source]
        assert row["target"] == pytest.approx(expected[source])
        assert 0 <= row["taken"] <= 2 * row["size"]
        taken[source] += row["taken"]
    for source in sizes:
        assert taken[source] == pytest.approx(expected[source], abs=1)


def test_order_cut_and_rerun(documents, corpus):
    df = documents(corpus)
    first = mixing.mixed_documents(df).collect()
    finish = [r["finish"] for r in first]
    assert finish == sorted(finish)
    assert mixing.mixed_documents(df).collect() == first
    by_doc = {}
    for r in first:
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], 0) + r["taken"]
    report = {r["doc_id"]: r["taken"] for r in mixing.mix_report(df).collect()}
    assert {k: v for k, v in report.items() if v} == by_doc


@pytest.mark.parametrize("most", [0, 1000])
def test_rows_of_the_mix(documents, corpus, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_ENTRIES", most)
    df = documents([*corpus, (None, "no id here", "xx", "s1")])
    whole = mixing.mixed_documents(df, whole_only=True)
    assert whole.filter("taken <> size or finish > 1.0001").isEmpty()
    rows = mixing.mixed_rows(df)
    assert rows.columns == df.columns
    assert [r["doc_id"] for r in rows.collect()] == [r["doc_id"] for r in whole.collect()]
    again = mixing.mixed_rows(df.unionAll(df.filter("doc_id = 3")))
    assert again.filter("doc_id = 3").count() == rows.filter("doc_id = 3").count()


def test_many_buckets_give_the_same(documents, corpus, monkeypatch):
    df = documents(corpus)
    one = sorted(map(repr, mixing.mix_report(df).collect()))
    monkeypatch.setattr(tables, "ROWS_PER_BUCKET", 7)
    assert sorted(map(repr, mixing.mix_report(df).collect())) == one


def test_empty(documents):
    assert mixing.mix_report(documents([])).collect() == []
    assert mixing.mix_report(documents([(1, None), (2, " ")])).agg(F.sum("taken")).first()[0] == 0
