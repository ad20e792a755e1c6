import random
import re

import numpy as np
import pytest

from vectorlens.llm import personal

PLAIN = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = [
                True,
                kind == 1 and all(int(p) <= 255 for p in m[0].split(".")),
                13 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0,
                9 <= len(digits) <= 15,
            ][kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None,
    "",
    "é漢 a.b+c@x-y.co.uk, then d@e and @f.g and h@i.j@k.l @@ m@n..o p@q.r.",
    "1.2.3.4.5.6.7.8 999.1.1.1 255.255.255.0 00001.002.3.4 1.2.3",
    "4744327020277091 4744 3270-2027 7091 4744327020277092 1234567890123456789012",
    "+1 (886) 555-6812 +49-30-1234567 +1 2 +12345678901234567 ++44 20 7946 0958)",
    "0" * 30_000 + "." + "1" * 30_000,
    "a@" * 5000 + "b.c " + "x" * 50_000 + "@y.z",
    "12٣4.1.1.1 ٤@٥.٦ 𝒳 7.7.7.7",
]


@pytest.mark.parametrize("text", TEXTS)
def test_patterns_as_they_stand(text):
    if text and len(text) > 20_000 and text[0] == "0":
        assert personal.base_spans(text) == []
        return
    assert personal.base_spans(text) == plain(text)


def test_patterns_on_random_texts():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("a.@-+ 0123(9)") for _ in range(rng.randint(0, 40)))
        assert personal.base_spans(text) == plain(text), text


def test_gradients_are_those_of_the_loss():
    rng = np.random.RandomState(1)
    tagger = personal.Tagger.fresh(3)
    tagger.weights["T"] = rng.randn(personal.TAGS, personal.TAGS) * 0.3
    codes, tags = rng.randint(0, personal.CHARS, (3, 7)), rng.randint(0, personal.TAGS, (3, 7))
    _, grads = tagger.loss_and_gradients(codes, tags)
    assert set(grads) == set(tagger.weights)
    for name, weight in tagger.weights.items():
        for _ in range(4):
            at = tuple(rng.randint(0, s) for s in weight.shape)
            if name == "E":
                at = (int(codes[0, 0]), at[1])
            kept = weight[at]
            sides = []
            for move in (1e-5, -1e-5):
                weight[at] = kept + move
                sides.append(tagger.loss_and_gradients(codes, tags)[0])
            weight[at] = kept
            assert grads[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-3, abs=1e-7), name


def test_decoding_is_the_best_path():
    rng = np.random.RandomState(2)
    tagger = personal.Tagger.fresh(5)
    tagger.weights["T"] = rng.randn(personal.TAGS, personal.TAGS)
    codes = rng.randint(0, personal.CHARS, (2, 4))
    scores, _ = tagger.emissions(codes)
    tags, sure = tagger.decode(codes)
    import itertools

    for row in range(2):
        value = lambda p, row=row: sum(scores[t, row, x] for t, x in enumerate(p)) + tagger.weights["S"][p[0]] + sum(tagger.weights["T"][a, b] for a, b in itertools.pairwise(p))
        paths = list(itertools.product(range(personal.TAGS), repeat=4))
        assert tuple(tags[row]) == max(paths, key=value)
        weights = np.exp([value(p) for p in paths])
        for t in range(4):
            share = weights[[p[t] == tags[row][t] for p in paths]].sum() / weights.sum()
            assert sure[row][t] == pytest.approx(share, rel=1e-6)


def sentences(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ru"]) for _ in range(rng.randint(1, 3)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    makers = [
        lambda: f"{word()}.{digits(2)}@mail{digits(1)}.{word()}.com",
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        lambda: f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: f"in {digits(4)} there were {digits(2)}",
    ]
    rows = []
    for i in range(n):
        kind = i % 4
        before = " ".join(word() for _ in range(rng.randint(3, 25)))
        made = makers[kind]()
        rows.append((i, f"{before} {made} {' '.join(word() for _ in range(rng.randint(3, 25)))}", kind, len(before) + 1, len(before) + 1 + len(made)))
    return rows


def test_held_out_accuracy_and_report(spark, documents):
    learn, held = sentences(400, 1), sentences(120, 2)
    tagger = personal.train(documents([r[:2] for r in learn]))
    hits = wrong = wanted = 0
    for _, text, kind, start, end in held:
        grid, codes, _ = personal.tag_windows(text, [])
        found = personal.reconciled(grid, *tagger.decode(codes), text) if len(grid) else []
        true = [] if kind == 3 else [(3 if kind == 2 else kind, start, end)]
        wanted += len(true)
        hits += len(set(found) & set(true))
        wrong += len(set(found) - set(true))
    assert hits >= 0.8 * wanted and wrong <= 0.1 * wanted
    rows = [*enumerate(TEXTS), (None, TEXTS[2]), (2, TEXTS[2]), *[(100 + r[0], r[1]) for r in held]]
    report = personal.scan(documents(rows), tagger).collect()
    assert len(report) == len(rows)
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, text)
    for r in report:
        base = [tuple(s) for s in r["base"]]
        if r["doc_id"] != 6:
            assert base == plain(texts[r["doc_id"]])
        assert set(base) <= {tuple(s) for s in r["spans"]}


def test_digest_and_empty(documents):
    found = personal.personal_report(documents([(1, TEXTS[2]), (2, None)])).collect()
    by = {r["doc_id"]: r for r in found}
    assert by[1]["base_sha256"] == personal.digest(personal.joined(plain(TEXTS[2])))
    assert by[2]["base_sha256"] == personal.digest("") and by[2]["spans"] == "" and by[2]["n_email"] == 0
    assert by[1]["n_email"] == sum(s[0] == 0 for s in plain(TEXTS[2]))
    assert personal.personal_report(documents([])).collect() == []


def card(rng):
    head = [rng.randrange(10) for _ in range(15)]
    total = sum(sum(divmod(d * (2 - i % 2), 10)) for i, d in enumerate(head))
    return "".join(map(str, [*head, -total % 10]))


FORMS = [
    lambda r, w, d: (0, f"{w()}.{w()} [at] {w()}.org"),
    lambda r, w, d: (0, f"{w()}{d(2)}(at){w()}.{w()}.com"),
    lambda r, w, d: (0, f"{w()}@{w()}host"),
    lambda r, w, d: (1, "[.]".join(str(r.randint(1, 255)) for _ in range(4))),
    lambda r, w, d: (2, "/".join(re.findall("....", card(r)))),
    lambda r, w, d: (3, f"({d(3)}) {d(3)} {d(4)}"),
    lambda r, w, d: (3, f"{d(3)}-{d(3)}-{d(4)}"),
    lambda r, w, d: (3, f"{d(3)}.{d(3)}.{d(4)}"),
]


def test_held_out_reworded_spans_and_clean_texts(spark, documents):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ru"]) for _ in range(rng.randint(1, 3)))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    line = lambda: " ".join(word() for _ in range(rng.randint(3, 25)))
    learn = [r[:2] for r in sentences(400, 1)] + [(1000 + i, f"{line()} {card(rng)} {line()}") for i in range(100)]
    rows, true = [], {}
    for i in range(400):
        before, (kind, made) = line(), FORMS[i % len(FORMS)](rng, word, digits)
        rows.append((i, f"{before} {made} {line()}"))
        true[i] = (kind, len(before) + 1, len(before) + 1 + len(made))
    clean = [f"in {digits(4)} there were {digits(2)}", f"on 20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)} at 10:45", f"version 3.{digits(1)}.{digits(2)}", f"for 1,{digits(3)}.50", "look at them"]
    rows += [(1000 + i, f"{line()} {clean[i % len(clean)]} {line()}") for i in range(300)]
    found = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in personal.scan(documents(rows), personal.train(documents(learn))).collect()}
    hits = [sum(true[i][0] == k and any(s[0] == k and s[1] < true[i][2] and true[i][1] < s[2] for s in found[i]) for i in true) for k in range(4)]
    whole = sum(true[i] in found[i] for i in true)
    left = sum(not found[1000 + i] for i in range(300))
    assert whole >= 0.8 * len(true) and left >= 0.99 * 300, (hits, whole, left, [rows[400 + i][1] for i in range(300) if found[1000 + i]][:5])


def test_spans_cross_windows():
    text = "x" * 40 + "a" * 100 + "@b " + "y" * 200
    starts = np.arange(0, len(text), 32)
    tags, sure = np.zeros((len(starts), 64), dtype=int), np.ones((len(starts), 64))
    for i, start in enumerate(starts):
        at = np.arange(start, start + 64)
        tags[i] = np.where((at >= 40) & (at < 142), 2, 0)
        tags[i, (at == 40) | ((at == start) & (at > 40) & (at < 142))] = 1
    assert personal.reconciled(starts, tags, sure, text) == [(0, 40, 142)]
