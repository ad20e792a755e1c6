import random
import tracemalloc

import numpy as np
import pyarrow as pa

from vectorlens.llm import language

SOUNDS = {"aa": ["tion", "the", "ing", "ou", "sh"], "bb": ["eau", "é", "oi", "que", "ux"], "cc": ["sch", "ü", "heit", "ich", "zt"]}


def text(lang, words=60):
    return " ".join("".join(random.choices(SOUNDS[lang], k=random.randint(1, 3))) for _ in range(words))


def made(n=90):
    random.seed(9)
    return [(i, text(lang := "aabbcc"[2 * (i % 3) :][:2], random.choice([8, 60, 200])), lang) for i in range(n)]


def plain_profile(text):
    """Bundle of a text, one trigram after the other."""
    letters = language._letter_vectors().astype(int)
    codes, table = [0], language._letter_codes()
    for c in (text or "").lower():
        code = int(table[ord(c)]) if ord(c) < 1 << 16 else (27 + ord(c) % 37 if c.isalpha() else 0)
        if code or codes[-1]:
            codes.append(code)
    if codes[-1]:
        codes.append(0)
    total = np.zeros(language.WIDTH, dtype=int)
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        if b:
            total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return total


def test_against_plain_profiles(documents):
    rows = made()
    found = {r["doc_id"]: r for r in language.language_report(documents(rows)).collect()}
    import zlib

    protos = {}
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            protos[lang] = protos.get(lang, 0) + plain_profile(t)
    for i, t, _ in rows:
        own = plain_profile(t)
        cosines = {k: own @ p / np.linalg.norm(own) / np.linalg.norm(p) for k, p in protos.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert found[i]["lang_pred"] == best and abs(found[i]["score"] - max(cosines[best], 0)) < 1e-5
    held = [r for r in rows if found[r[0]]["held_out"]]
    assert np.mean([found[i]["lang_pred"] == lang for i, _, lang in held]) > 0.97


def test_defined_results(documents):
    rows = [*made(30), (900, None, "aa"), (901, "", "bb"), (902, "12 !? 34", "aa"), (903, text("bb"), None), (None, text("cc"), "cc"), (3, text("aa"), "aa")]
    found = language.language_report(documents(rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (900, 901, 902):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert next(r for r in found if r["doc_id"] == 903)["lang_pred"] == "bb"
    unlabelled = language.language_report(documents([(i, t) for i, t, _ in rows])).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}
    assert language.language_report(documents([])).collect() == []


def test_filter_keeps_columns_and_known_texts(documents):
    rows = [*made(60), (900, None, "aa"), (901, "12 34", "bb")]
    df = documents(rows)
    kept = language.known_language(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows[:60]}
    assert language.known_language(documents([])).collect() == []


def test_filter_rejects_unknown_languages_and_random_texts(documents):
    rows = made(300)
    random.seed(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    more = {
        "letters": lambda: " ".join("".join(random.choices(letters, k=random.randint(2, 9))) for _ in range(80)),
        "base64": lambda: "".join(random.choices(letters + letters.upper() + "0123456789+/", k=500)),
        "cyrillic": lambda: " ".join("".join(chr(random.randint(0x430, 0x44F)) for _ in range(6)) for _ in range(80)),
        "han": lambda: "".join(chr(random.randint(0x4E00, 0x9FFF)) for _ in range(500)),
        "unknown": lambda: " ".join("".join(random.choices(["zza", "llo", "nni", "pre", "mbu"], k=random.randint(1, 3))) for _ in range(80)),
    }
    odd = [(1000 + 100 * k + i, make(), None) for k, make in enumerate(more.values()) for i in range(40)]
    short = [(5000 + i, text(lang, 4), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    kept = {r["doc_id"] for r in language.known_language(documents(rows + odd + short)).collect()}
    clean = [r[0] for r in rows + short]
    assert sum(i in kept for i in clean) >= 0.99 * len(clean)
    for k in range(len(more)):
        assert sum(1000 + 100 * k + i in kept for i in range(40)) <= 2


def test_trigrams_do_not_cross_texts():
    row, code, has = language.trigrams(pa.array(["ab", None, "", "c", "-", "𝒳é"]))
    assert has.tolist() == [True, False, False, True, False, True]
    assert np.bincount(row, minlength=6).tolist() == [2, 0, 0, 1, 0, 2]


def test_quantiles_are_exact(spark):
    draw = np.random.RandomState(4)
    rows = [("whole", 5, float(x)) for x in draw.beta(5, 2, 3000)] + [("noise", 5, float(x)) for x in draw.randint(0, 4, 500) / 3]
    rows += [("whole", 6, 0.25)] * 30 + [("whole", 7, 0.5)] * (language.FEWEST - 1)
    wanted = {"whole": 0.001, "noise": 0.99}
    found = language._quantiles(spark.createDataFrame(rows, "kind string, c int, score double"), wanted)
    expected = {key: np.quantile([s for k, c, s in rows if (k, c) == key], wanted[key[0]]) for key in [("whole", 5), ("noise", 5), ("whole", 6)]}
    assert found.keys() == expected.keys()
    assert all(abs(found[key] - expected[key]) < 1e-12 for key in expected)


def test_least_cosines_hear_every_labelled_text(spark, monkeypatch):
    """More texts than any sample once held: the lowest scores of all of them set the bound, repeats counted."""
    scores = []
    plain = language._quantiles
    monkeypatch.setattr(language, "_quantiles", lambda rows, wanted: scores.append(rows.groupBy("kind").count().collect()) or plain(rows, wanted))
    random.seed(6)
    texts = [(text("aabbcc"[2 * (i % 3) :][:2], 4), "aa") for i in range(2500)] + [(text("aa", 30), "aa")] * 40
    labelled = spark.createDataFrame(texts, "text string, lang string")
    model = language.prototypes(spark.createDataFrame([(t, lang) for _, t, lang in made(30)], "text string, lang string"))
    assert language.least_cosines(labelled, model)
    assert {r["kind"]: r["count"] for r in scores[0]}["whole"] == 2540


def test_little_text_is_turned_into_letters_at_once(monkeypatch):
    """A worker holds the letters of a small piece, however large its batch is, and the bundles stay the same."""
    texts = ["aa " + "ab cde " * 20_000, "bb " + "fgh i " * 1_000] * 12
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y"] * 12), pa.array(texts)], ["lang", "text"])
    sizes, trigrams = [], language.trigrams

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            parts = {}
            for out in run(iter([batch])):
                for lang, bundle in zip(out.column("lang").to_pylist(), out.column("bundle").to_pylist(), strict=True):
                    parts[lang] = parts.get(lang, 0) + np.array(bundle)
            return parts

    monkeypatch.setattr(language, "trigrams", lambda t: sizes.append(sum(len(x) for x in t.to_pylist())) or trigrams(t))
    found = language._training(Docs())
    assert sum(sizes) == sum(map(len, texts)) and max(sizes) <= 1 << 20
    monkeypatch.setattr(language, "LETTER_BYTES", 1 << 30)
    whole = language._training(Docs())
    assert set(found) == {"x", "y"} and all((found[x] == whole[x]).all() for x in found)


def test_vectors_of_many_trigrams_are_not_held_in_double_at_once(monkeypatch):
    """A worker's memory does not grow with the trigrams of a piece times the width in double precision."""
    random.seed(3)
    texts = ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=20_000)) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y"] * 30), pa.array(texts)], ["lang", "text"])

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            tracemalloc.start()
            out = [row for part in run(iter([batch])) for row in part.to_pylist()]
            return out, tracemalloc.get_traced_memory()[1], tracemalloc.stop()

    out, peak, _ = language._training(Docs())
    assert {r["lang"] for r in out} == {"x", "y"} and peak < 80 << 20
    monkeypatch.setattr(language, "TRIGRAMS_AT_ONCE", 1 << 30)
    assert language._training(Docs())[0] == out


def test_a_filter_on_a_score_does_not_score_texts_again(documents):
    docs = documents([(i, t, lang, None) for i, t, lang in made(30)])
    found = language._class_scores(docs.select("text", "lang").withColumn("kind", docs["lang"]), language.prototypes(docs))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and found.count() == 30
