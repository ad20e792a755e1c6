import corpus_pipeline
import pytest
from test_ngram_join import shingles
from tokenizers import Tokenizer

from vectorlens.llm import ngram_join
from vectorlens.llm.token_files import vocabulary

FOLDER = "/root/testdata/sf0.001"


def near(a, b, width=5, percent=80):
    x, y = shingles(a, width), shingles(b, width)
    return bool(x) and 100 * len(x & y) >= percent * len(x | y)


@pytest.mark.parametrize("most", [0, 1000])
def test_one_of_each_component(documents, corpus, monkeypatch, most):
    monkeypatch.setattr("vectorlens.llm.tables.BROADCAST_KEYS", most)
    rows = [*corpus, (None, corpus[62][1]), (None, "alone without an id"), corpus[5], corpus[182]]
    df = documents(rows)
    left = ngram_join.one_of_each(df)
    assert left.columns == df.columns
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near(rows[i][1], rows[j][1]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    expected = [min((i for i in range(len(rows)) if group[i] == g), key=order) for g in set(group)]
    assert sorted(repr(rows[i][0]) for i in expected) == sorted(repr(r["doc_id"]) for r in left.collect())


def test_stages_and_result(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "decontamination", "mixing", "token_files"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.kept(stage(spark, docs, FOLDER), "test")
        assert after.columns == docs.columns
        rows[name] = after.collect()
        docs = after
    library = Tokenizer.from_file(vocabulary()())
    lengths = sorted((r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in rows["mixing"])
    result = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in result) == lengths
    assert {r["doc_id"] for r in rows["near_copies"]} <= {r["doc_id"] for r in rows["language"]}
    texts = [r["text"] for r in rows["near_copies"]]
    assert not any(near(a, b) for i, a in enumerate(texts) for b in texts[:i])
    import pyarrow.parquet as pq

    items = [t for t in pq.read_table(f"{FOLDER}/benchmark.parquet")["text"].to_pylist() if len(t.split()) >= 8]
    assert not any(item in r["text"] for r in rows["decontamination"] for item in items)
    kept = {r["doc_id"] for r in rows["language"]}
    whole = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert all(r["doc_id"] in kept for r in whole if sum(c.isalpha() for c in r["text"] or "") >= 20)
