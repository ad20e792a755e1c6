"""Personal data: fixed patterns, and a character BiLSTM with a CRF on top, written in numpy and trained here.

The network reads windows of characters in both directions; a linear-chain CRF over begin/inside tags of the four
kinds makes the tags of a window fit each other. It is trained on windows of a bounded sample of texts, labelled by the
spans of the patterns, and of the same texts with these spans reworded into forms that no pattern takes (masked at
signs, other separators, numbers without a plus) or replaced by ordinary numbers, by gradient descent on the CRF
likelihood with Adam steps and a fixed seed.

At work, windows of a fixed grid overlap by half. Only windows near a digit, an at sign or a masked one are decoded; all
others can hold no span. Every character takes its tag from the window in which it lies farthest from the edges, and
spans are read from these tags over the whole text, so that a span of any length may cross windows. The network adds
spans that the patterns miss; pattern spans always stay.

Patterns are matched as they stand, but in time linear in the text. Positions are code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorlens.llm.tables import first_by_hash
from vectorlens.llm.words import pieces

# Kinds in their order, and patterns. Lookbehinds and possessive runs only spare repeated attempts.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z", re.ASCII)
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.ASCII)
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}", re.ASCII)
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+", re.ASCII)
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]", re.ASCII)
_TRIGGER = re.compile(r"[0-9@]")
# At signs in words. Bounded runs keep the search linear.
_MASKED = re.compile(r"[\[({<]\x20?at\x20?[\])}>]|\x20at\x20(?=[A-Za-z0-9-]{1,63}\x20dot\x20)", re.ASCII | re.I)
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

WINDOW, STRIDE = 64, 32
TAGS = 1 + 2 * len(KINDS)
CHARS, EMBED, HIDDEN = 98, 12, 16
# Bounds of the training sample: texts with spans, texts with a digit but no span, windows in all, and characters of
# a text that may be in the sample (longer texts are scanned like all others). Windows are taken in these shares: as they
# stand, reworded, with ordinary numbers, and of texts without spans.
SAMPLE_TEXTS, SAMPLE_WINDOWS, SAMPLE_LENGTH = 600, 4500, 20_000
SHARES = (0.25, 0.45, 0.15, 0.15)
# Versions made of a text with spans.
VERSIONS = 8
EPOCHS, BATCH, RATE = 8, 64, 0.015
# A span of the network needs this mean probability per character.
CONFIDENCE = 0.8
_DECODE = 256


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign with the run of local characters before it: what a search from the left finds."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        hit = _DOMAIN.match(text, at) if start < at else None
        if hit:
            yield start, hit.end()
        done = hit.end() if hit else at + 1
        at = text.find("@", done)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind, then start."""
    text = text or ""
    if not _TRIGGER.search(text):
        return []
    spans = [(0, a, b) for a, b in _emails(text)]
    spans += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in (q.lstrip("0")[:4] or "0" for q in m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, m.start(), m.end()))
    spans += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return spans


def char_codes(text: str) -> np.ndarray:
    """Printable ASCII by itself, white space as one code, every other character as one code."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    codes = np.where((points >= 33) & (points < 127), points - 31, 1)
    return np.where((points == 32) | ((points >= 9) & (points <= 13)), 0, codes)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Tagger:
    """Weights by name: ``E`` (embedding), ``W``, ``U``, ``b`` per direction, ``O``, ``c`` (tags), ``T``, ``S``."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 12) -> Tagger:
        rng = np.random.RandomState(seed)
        weights = {"E": rng.randn(CHARS, EMBED) * 0.3, "O": rng.randn(2 * HIDDEN, TAGS) * 0.2, "c": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS)), "S": np.zeros(TAGS)}
        for way in "fb":
            weights |= {f"W{way}": rng.randn(EMBED, 4 * HIDDEN) * 0.3, f"U{way}": rng.randn(HIDDEN, 4 * HIDDEN) * 0.3, f"b{way}": np.zeros(4 * HIDDEN)}
            weights[f"b{way}"][HIDDEN : 2 * HIDDEN] = 1.0
        return Tagger(weights)

    def _direction(self, x: np.ndarray, way: str):
        """States of one direction, ``x`` being (steps, batch, EMBED) in that direction's order."""
        w = self.weights
        given = x @ w[f"W{way}"] + w[f"b{way}"]
        h = c = np.zeros((x.shape[1], HIDDEN))
        states, cells, gates = [], [c], []
        for t in range(len(x)):
            z = given[t] + h @ w[f"U{way}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            c = f * c + i * g
            h = o * np.tanh(c)
            states.append(h), cells.append(c), gates.append((i, f, o, g))
        return np.array(states), cells, gates

    def emissions(self, codes: np.ndarray):
        """Tag scores (steps, batch, TAGS) of code windows (batch, steps), and what training needs of the way."""
        x = self.weights["E"][codes.T]
        ahead, back = self._direction(x, "f"), self._direction(x[::-1], "b")
        both = np.concatenate((ahead[0], back[0][::-1]), axis=2)
        return both @ self.weights["O"] + self.weights["c"], (x, both, ahead, back)

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (batch, steps) and their marginal probabilities."""
        scores, _ = self.emissions(codes)
        moves, steps = self.weights["T"], len(scores)
        best, came = scores[0] + self.weights["S"], []
        for t in range(1, steps):
            each = best[:, :, None] + moves
            came.append(each.argmax(axis=1))
            best = each.max(axis=1) + scores[t]
        tags = [best.argmax(axis=1)]
        for choice in reversed(came):
            tags.append(choice[np.arange(len(best)), tags[-1]])
        tags = np.array(tags[::-1])
        share, _, _ = self._marginals(scores)
        return tags.T, np.take_along_axis(share, tags[:, :, None], axis=2)[:, :, 0].T

    def _marginals(self, scores: np.ndarray):
        moves, steps = self.weights["T"], len(scores)
        ahead, back = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0] + self.weights["S"]
        for t in range(1, steps):
            ahead[t] = _logsum(ahead[t - 1][:, :, None] + moves, 1) + scores[t]
        for t in range(steps - 2, -1, -1):
            back[t] = _logsum(moves[None] + (scores[t + 1] + back[t + 1])[:, None, :], 2)
        total = _logsum(ahead[-1], 1)
        return np.exp(ahead + back - total[None, :, None]), (ahead, back), total

    def loss_and_gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag windows per window, and its gradients."""
        w, batch = self.weights, len(codes)
        scores, (x, both, ahead_states, back_states) = self.emissions(codes)
        gold = tags.T
        share, (ahead, back), total = self._marginals(scores)
        steps, rows = len(scores), np.arange(batch)
        path = np.take_along_axis(scores, gold[:, :, None], axis=2)[:, :, 0].sum(axis=0) + w["S"][gold[0]] + w["T"][gold[:-1], gold[1:]].sum(axis=0)
        loss = float((total - path).mean())
        d_scores = share.copy()
        d_scores[np.arange(steps)[:, None], rows[None, :], gold] -= 1.0
        d_scores /= batch
        grads = {"S": d_scores[0].sum(axis=0)}
        pair = np.zeros((TAGS, TAGS))
        for t in range(1, steps):
            pair += np.exp(ahead[t - 1][:, :, None] + w["T"] + (scores[t] + back[t])[:, None, :] - total[:, None, None]).sum(axis=0)
        np.add.at(pair, (gold[:-1].ravel(), gold[1:].ravel()), -1.0)
        grads["T"] = pair / batch
        flat = both.reshape(-1, 2 * HIDDEN)
        grads["O"], grads["c"] = flat.T @ d_scores.reshape(-1, TAGS), d_scores.sum(axis=(0, 1))
        d_both = d_scores @ w["O"].T
        d_x = self._through(x, ahead_states, d_both[:, :, :HIDDEN], "f", grads)
        d_x = d_x + self._through(x[::-1], back_states, d_both[::-1, :, HIDDEN:], "b", grads)[::-1]
        grads["E"] = np.zeros_like(w["E"])
        np.add.at(grads["E"], codes.T, d_x)
        return loss, grads

    def _through(self, x: np.ndarray, run, d_states: np.ndarray, way: str, grads: dict) -> np.ndarray:
        """Back through one direction in time; returns the gradient of its inputs."""
        states, cells, gates = run
        u = self.weights[f"U{way}"]
        d_z = np.empty((len(x), x.shape[1], 4 * HIDDEN))
        d_h, d_c = np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g = gates[t]
            d_h = d_h + d_states[t]
            squashed = np.tanh(cells[t + 1])
            d_c = d_c + d_h * o * (1.0 - squashed**2)
            parts = (d_c * g * i * (1 - i), d_c * cells[t] * f * (1 - f), d_h * squashed * o * (1 - o), d_c * i * (1 - g**2))
            d_z[t] = np.concatenate(parts, axis=1)
            d_h, d_c = d_z[t] @ u.T, d_c * f
        flat = d_z.reshape(-1, 4 * HIDDEN)
        before = np.concatenate((np.zeros((1, *states[0].shape)), states[:-1]))
        grads[f"W{way}"] = x.reshape(-1, EMBED).T @ flat
        grads[f"U{way}"] = before.reshape(-1, HIDDEN).T @ flat
        grads[f"b{way}"] = flat.sum(axis=0)
        return d_z @ self.weights[f"W{way}"].T


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def tag_windows(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the grid that hold a trigger: ``(starts, codes, tags)``, padded with blanks."""
    codes = char_codes(text)
    tags = np.zeros(len(codes), dtype=np.int64)
    for kind, start, end in reversed(spans):
        tags[start:end] = 2 + 2 * kind
        tags[start] = 1 + 2 * kind
    at = np.flatnonzero(((codes >= ord("0") - 31) & (codes <= ord("9") - 31)) | (codes == ord("@") - 31))
    masked = np.array([m.start() for m in _MASKED.finditer(text)], dtype=np.int64)
    cells = np.unique(np.concatenate((at, masked)) // STRIDE)
    last = max(len(codes) - 1, 0) // STRIDE
    grid = np.unique(np.clip(np.concatenate((cells - 1, cells, cells + 1)), 0, last)) * STRIDE
    reach = grid[:, None] + np.arange(WINDOW)
    inside = reach < len(codes)
    reach = np.minimum(reach, max(len(codes) - 1, 0))
    return grid, np.where(inside, codes[reach], 0), np.where(inside, tags[reach], 0)


_NAME = re.compile(r"(?<![A-Za-z])[A-Za-z]{2,10}(?![A-Za-z])", re.ASCII)


def short_context(text: str, spans: list[tuple[int, int, int]], rng: np.random.RandomState) -> tuple[str, list[tuple[int, int, int]]]:
    """One of the spans with up to 40 characters on either side, as a text of its own."""
    kind, a, b = spans[rng.randint(len(spans))]
    start, end = max(0, a - rng.randint(41)), b + rng.randint(41)
    inside = [(k, max(x, start) - start, min(y, end) - start) for k, x, y in spans if x < end and y > start]
    return text[start:end], inside


def _digits(rng: np.random.RandomState, n: int) -> str:
    return "".join(map(str, rng.randint(0, 10, n)))


def reworded(kind: int, piece: str, words: list[str], rng: np.random.RandomState) -> str:
    """A span of a kind in a form that its pattern does not take; half of the emails are made of ``words``."""
    one = lambda *forms: forms[rng.randint(len(forms))]
    if kind == 0:
        local, domain = piece.split("@", 1)
        if words and rng.randint(2):
            local, domain = one(one(*words), f"{one(*words)}.{one(*words)}", f"{one(*words)}{rng.randint(100)}"), f"{one(*words)}.{one('com', 'org', 'net', 'de', 'co.uk')}"
        form = rng.randint(4)
        if form == 0:
            return f"{local}@{domain.split('.')[0]}"
        if form == 1:
            return f"{local} at {domain.replace('.', ' dot ')}"
        return local + one(" [at] ", "[at]", " (at) ", "(at)") + domain.replace(".", one(".", ".", "[dot]", " [dot] ", " (dot) "))
    if kind == 1:
        return piece.replace(".", one("[.]", "(.)", " . ", "[dot]"))
    digits = "".join(c for c in piece if "0" <= c <= "9")
    if kind == 2:
        return one(".", "/", "_", " - ", ", ").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return one(f"({a}) {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{a[:2]} {b} {a}{c}", f"{a}/{b}{c}")


def ordinary(rng: np.random.RandomState) -> str:
    """Numbers and phrases that are no personal data."""
    n = rng.randint(1, 10_000)
    date = f"{rng.randint(1900, 2100)}-{rng.randint(1, 13):02}-{rng.randint(1, 29):02}"
    clock = f"{rng.randint(24):02}:{rng.randint(60):02}"
    forms = (str(n), f"{n}.{n % 100:02}", date, f"{date}T{clock}", f"{date} {clock}:07", clock, f"{n % 9}.{n % 17}.{n % 23}", f"{n},{_digits(rng, 3)}.50")
    forms += (f"{1900 + n % 99}-{2000 + n % 99}", f"{n % 31}/{n % 12}/{1990 + n % 40}", _digits(rng, 6), _digits(rng, rng.randint(5, 9)), f"A{n}-{_digits(rng, 3)}", f"at {n}", f"{n} dot {n % 7}")
    return forms[rng.randint(len(forms))]


def rewritten(text: str, spans: list[tuple[int, int, int]], rng: np.random.RandomState, same: bool) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its spans reworded, and where they are now; or (not ``same``) with ordinary numbers in their place."""
    parts, marks, done, length = [], [], 0, 0
    words = sorted(set(_NAME.findall(text)))
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < done:
            continue
        piece = reworded(kind, text[a:b], words, rng) if same else ordinary(rng)
        parts += [text[done:a], piece]
        length += a - done
        if same:
            marks.append((kind, length, length + len(piece)))
        length, done = length + len(piece), b
    return "".join([*parts, text[done:]]), marks


def train(docs: DataFrame) -> Tagger:
    """Fit the tagger on windows of a bounded, hash-ordered sample of texts, labelled by the patterns.

    At most ``SAMPLE_TEXTS`` different texts with an at sign, plus or long number and as many without, none longer than
    ``SAMPLE_LENGTH``, and of them ``SAMPLE_WINDOWS`` windows. Windows of a text as it stands, reworded and with ordinary numbers are
    drawn in ``SHARES``. Without any window the fresh network is returned and finds nothing.
    """
    some = docs.select("text").filter(F.length("text") <= SAMPLE_LENGTH)
    likely = some.filter(F.regexp_like("text", F.lit(r"@|\+[0-9]|[0-9][0-9. -]{11}")))
    other = some.filter(F.regexp_like("text", F.lit("[0-9]")) & ~F.regexp_like("text", F.lit(r"@|\+[0-9]|[0-9][0-9. -]{11}")))
    rng = np.random.RandomState(6)
    first = [(t, base_spans(t)) for t in sorted(r[0] for r in first_by_hash(likely, "text", SAMPLE_TEXTS).collect())]
    marked = [(t, s) for t, s in first if s]
    without = [tag_windows(r[0], []) for r in sorted(first_by_hash(other, "text", SAMPLE_TEXTS).collect())]
    near = lambda made: [(c[k], t[k]) for _, c, t in made for k in [t.any(axis=1)] if k.any()]
    versions = lambda same: [rewritten(t, s, rng, same) for t, s in marked for _ in range(VERSIONS if same else 1)]
    cut = lambda made: [short_context(t, s, rng) if i % 2 and s else (t, s) for i, (t, s) in enumerate(made)]
    plain = lambda made: [(c, t) for _, c, t in made if len(c)]
    sets = [plain(tag_windows(t, s) for t, s in first), near(tag_windows(t, s) for t, s in cut(versions(True))), plain(tag_windows(t, []) for t, _ in versions(False)), plain(without)]
    windows = []
    for made, share in zip(sets, SHARES, strict=True):
        if made:
            codes, tags = (np.concatenate(p) for p in zip(*made, strict=True))
            # Windows with a span come first where there are many without.
            pick = rng.permutation(len(codes))
            pick = pick[np.argsort(~tags[pick].any(axis=1), kind="stable")] if made is sets[0] else pick
            pick = pick[: int(SAMPLE_WINDOWS * share)]
            windows.append((codes[pick], tags[pick]))
    tagger = Tagger.fresh()
    if not windows:
        return tagger
    codes, tags = (np.concatenate(p) for p in zip(*windows, strict=True))
    mean = {k: np.zeros_like(v) for k, v in tagger.weights.items()}
    square = {k: np.zeros_like(v) for k, v in tagger.weights.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(codes))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            _, grads = tagger.loss_and_gradients(codes[pick], tags[pick])
            step += 1
            for k, g in grads.items():
                g = np.clip(g, -1.0, 1.0)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                tagger.weights[k] -= RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return tagger


# What a span of the network must hold. Numbers of digits: (least, most) by kind.
_AT = re.compile(r"@|\bat\b", re.ASCII | re.I)
DIGITS = {1: (4, 12), 2: (13, 19), 3: (7, 15)}


def plausible(kind: int, part: str) -> bool:
    """An email holds an at sign or its name, every other kind its digits; those of a card pass Luhn's test."""
    if kind == 0:
        return bool(_AT.search(part))
    digits = "".join(c for c in part if "0" <= c <= "9")
    least, most = DIGITS[kind]
    return least <= len(digits) <= most and (kind != 2 or luhn(digits))


def reconciled(starts: np.ndarray, tags: np.ndarray, sure: np.ndarray, text: str) -> list[tuple[int, int, int]]:
    """Spans of one text from the tags of its windows, without overlaps, by start.

    Every character takes its tag from the window in which it lies farthest from the edges; the ends of a text are no edges.
    A span runs from a begin tag over the inside tags that follow; where another window takes over, a begin tag of the
    same kind goes on with the span. A span counts where it is confident and plausible.
    """
    size = len(text)
    tag, value = np.zeros(size, dtype=np.int8), np.zeros(size, dtype=np.float32)
    source, inside = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int16)
    step = np.arange(WINDOW)
    for parity in (0, 1):  # windows of one parity do not overlap
        pick = np.flatnonzero((starts // STRIDE) % 2 == parity)
        left = np.where(starts[pick, None] == 0, WINDOW, step + 1)
        depth = np.minimum(left, np.where(starts[pick, None] + WINDOW >= size, WINDOW, WINDOW - step))
        place = starts[pick, None] + step
        better = (place < size) & (depth > inside[np.minimum(place, size - 1)])
        at = place[better]
        tag[at], value[at], inside[at] = tags[pick][better], sure[pick][better], depth[better]
        source[at] = np.broadcast_to(pick[:, None], place.shape)[better]
    some = np.flatnonzero(tag)
    if len(some) == 0:
        return []
    kind = (tag[some].astype(np.int64) - 1) // 2
    follows = np.concatenate(([False], (np.diff(some) == 1) & (kind[1:] == kind[:-1])))
    seam = np.concatenate(([False], source[some[1:]] != source[some[:-1]]))
    first = np.flatnonzero(~follows | ((tag[some] % 2 == 1) & ~seam))
    last = np.append(first[1:], len(some)) - 1
    chosen = []
    for i, j in zip(first.tolist(), last.tolist(), strict=True):
        a, b = int(some[i]), int(some[j]) + 1
        if tag[a] % 2 == 1 and value[a:b].mean() >= CONFIDENCE and plausible(int(kind[i]), text[a:b]):
            chosen.append((int(kind[i]), a, b))
    return chosen


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def scan(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """One row per input row: doc_id, ``base`` and ``spans`` as arrays of kind, start, end, by kind, then start.

    A null text is empty and has no spans. Null and repeated ids and repeated rows stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tagger or train(docs)).weights)
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tagger(shared.value)
        for batch in batches:
            for piece in pieces(batch):
                texts = piece.column("text").to_pylist()
                base = [base_spans(t) for t in texts]
                places, starts, codes = [], [], []
                for i, text in enumerate(texts):
                    if text and (_TRIGGER.search(text) or _MASKED.search(text)):
                        grid, window, _ = tag_windows(text, [])
                        places.append((i, len(grid))), starts.append(grid), codes.append(window)
                every = [list(b) for b in base]
                if places:
                    # Windows that read the same are decoded once.
                    codes, again = np.unique(np.concatenate(codes), axis=0, return_inverse=True)
                    decoded = [model.decode(codes[j : j + _DECODE]) for j in range(0, len(codes), _DECODE)]
                    tags, sure = (np.concatenate(d) for d in zip(*decoded, strict=True))
                    at = 0
                    for (i, n), grid in zip(places, starts, strict=True):
                        pick = again[at : at + n]
                        at += n
                        more = reconciled(grid, tags[pick], sure[pick], texts[i])
                        every[i] = sorted(base[i] + _apart(more, base[i]))
                rows = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in base], [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in every]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(r, kind) for r in rows)], ["doc_id", "base", "spans"])

    spans = "array<struct<kind:int,start:int,end:int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, base {spans}, spans {spans}")


def _apart(more: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of ``more`` (by start, without overlaps) that touch no span of ``base``."""
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken], dtype=np.int64)
    reach = np.maximum.accumulate(np.array([b for _, b in taken], dtype=np.int64)) if taken else starts
    out = []
    for kind, a, b in more:
        before = int(np.searchsorted(starts, b, side="left"))
        if before == 0 or reach[before - 1] <= a:
            out.append((kind, a, b))
    return out


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def personal_report(docs: DataFrame) -> DataFrame:
    """Counts of the pattern spans per kind, their digest, and all spans as text."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s.kind + 1)
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", name(s), s.start, s.end)), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return scan(docs).select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
