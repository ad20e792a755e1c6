import hashlib
import zlib

import pytest

from vectorlens.llm import merkle


def joined(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([joined(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def climb(tree, i):
    steps = []
    for row in tree[:-1]:
        steps.append((i ^ 1 < i, row[i ^ 1]) if i ^ 1 < len(row) else None)
        i >>= 1
    return steps


def leaf_of(row, n_chars):
    shown = [None if v is None else str(v) for v in (row["doc_id"], row["source"], row["lang"], n_chars, row["text"])]
    return joined(*["-" if v is None else f"{len(v.encode())}:{v}" for v in shown])


def brute(rows):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row["lang"], []).append(row)
    trees = []
    for lang in sorted(by_lang, key=lambda x: (x is not None, (x or "").encode())):
        members = sorted(by_lang[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["n_chars"])))
        trees.append((members, levels([leaf_of(r, r["n_chars"]) for r in members])))
    top = levels([tree[-1][0] for _, tree in trees])
    out = []
    for k, (members, tree) in enumerate(trees):
        for i, row in enumerate(members):
            steps = climb(tree, i) + climb(top, k)
            chosen = row["doc_id"] is not None and row["n_chars"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            at = leaf_of(row, row["n_chars"] + 1) if chosen else tree[0][i]
            for step in steps:
                at = joined(at) if step is None else joined(step[1], at) if step[0] else joined(at, step[1])
            proof = joined(*[s[1] for s in steps if s])
            out.append((row["doc_id"], tree[0][i], tree[-1][0], top[-1][0], proof, at, at == top[-1][0]))
    return sorted(out, key=repr)


def found(docs, **more):
    return sorted(map(tuple, merkle.tamper_report(docs, **more).collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 21, 64, 77, 255, 256, 513])
def test_positions_are_completion_order(n):
    top, order = merkle.height(n), []
    for m in range(1, n + 1):
        order += [(h, (m >> h) - 1) for h in range(top + 1) if m % (1 << h) == 0]
    order += [(h, merkle.nodes_at(h, n) - 1) for h in range(1, top + 1) if n % (1 << h)]
    assert [merkle.position(h, i, n) for h, i in order] == list(range(len(order)))


@pytest.mark.parametrize("span", [1, 2, 8])
def test_proofs_against_brute_force(spark, documents, corpus, span):
    odd = [(None, "no id", "xx", "s0"), (None, "no id", "xx", "s0"), (None, None, None, None), (0, "x", None, "ä"), (-5, "é", "漢", None)]
    rows = corpus[:70] + corpus[180:] + odd + [corpus[3], corpus[3], (corpus[3][0], "other", "xx", "s1")]
    docs = documents(rows)
    assert found(docs, span=span) == brute([r.asDict() for r in docs.collect()])


def test_null_character_counts_cannot_be_tampered(documents):
    docs = documents([(i, f"t{i}", "xx", "s") for i in range(30)]).selectExpr("* except (n_chars)", "if(doc_id < 15, null, doc_id) as n_chars")
    got = found(docs)
    assert got == brute([r.asDict() for r in docs.collect()])
    assert all(r[-1] for r in got if r[0] < 15) and not all(r[-1] for r in got)


def test_single_document_and_empty_table(documents):
    one = documents([(7, "alone", "xx", "s")])
    assert found(one) == brute([r.asDict() for r in one.collect()])
    none = documents([])
    assert found(none) == [] and merkle.build_manifest(none).root.collect() == []


def test_written_log_is_whole(documents, corpus):
    manifest = merkle.build_manifest(documents(corpus[:60]), span=2)
    n = manifest.documents.roots.agg({"n": "sum"}).first()[0]
    assert n == 60
    sizes = {r["tree"]: r["n"] for r in manifest.documents.roots.collect()}
    written = {}
    for r in manifest.documents.segments().collect():
        written[r["tree"]] = written.get(r["tree"], 0) + len(r["log"]) // 32
    assert written == {t: sum(merkle.nodes_at(h, n) for h in range(merkle.height(n) + 1)) for t, n in sizes.items()}


def test_proof_steps_fold_to_the_root(documents, corpus):
    rows = merkle.build_manifest(documents(corpus[:25])).proofs(siblings_too=True).collect()
    assert len(rows) == 25 and all(merkle.fold(r["leaf"], r["proof"]) == r["root"] == r["folded_root"] for r in rows)
