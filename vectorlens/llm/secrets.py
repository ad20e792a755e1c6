"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

DataFrame functions only. Two first-order Markov chains over characters are counted from labelled samples. Random
strings are the values that the fixed patterns find, and digests in the usual alphabets of keys. Ordinary ones are words
of other places, and paths, addresses of pages and hosts, dates and identifiers put together from such words. Every run
of at least ``LEAST_TOKEN`` characters outside the pattern spans, with or without a digit, is reported when its mean
log-likelihood ratio per transition is above the threshold of its length, which is fitted on held-out samples. Patterns and
scores run over whole texts in one pass without a shuffle.

Positions are code points: the lengths of the gaps between matches and of the matches themselves, added up.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorlens.llm.tables import first_by_hash, kept
from vectorlens.llm.words import WORD

# Kinds in their order, patterns, least lengths (of the value for assign, else of the match).
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

# Tokens offered to the models: whole runs, with single dots inside.
LEAST_TOKEN = 12
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?<![A-Za-z0-9+/_=-]\.)(?=[A-Za-z0-9+/_.=-]{12})[A-Za-z0-9+/_=-]++(?:\.[A-Za-z0-9+/_=-]++)*+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
STATES = len(ALPHABET) + 1

# Bounds of the training sample: random strings of either origin, texts whose words are ordinary, and strings put
# together from those words.
SAMPLE_STRINGS, SAMPLE_TEXTS, SAMPLE_SHAPED = 5_000, 500, 12_000
# Weight, in transitions, of the plain character frequencies against the counts of a state.
BACK_OFF = 50.0
# One string in so many of either sample is held out of the counts, to fit the thresholds.
HELD_OUT = 5
# Least lengths of the classes that have a threshold of their own. It is put halfway between the ratio that this share of
# held-out ordinary strings stays below and the median of random ones.
CLASSES = (12, 16, 20, 28)
ORDINARY_BELOW = 0.999
# Matches, and characters, that are taken together: the work within a text stays near its length.
MATCHES, CELL = 256, 4096


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of all transitions, row after row, and the threshold of every class of lengths."""

    ratios: list[float]
    thresholds: list[float]


_SPANS = "array<struct<start:int,rank:int,end:int,value:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def located(text: Column, pattern: str, rank: int, group: int, least: int) -> Column:
    """Matches of a pattern, leftmost and non-overlapping, whose ``group`` has at least ``least`` characters."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    matches = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value"))
    start = lambda at, kind: F.struct(at.alias("at"), F.lit(None).cast(kind).alias("out"))

    def step(done: Column, m: Column) -> Column:
        begin = done.at + F.length(m.gap)
        end = begin + F.length(m.whole)
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), m.value.alias("value"))
        found = F.coalesce(done.out, F.array().cast(_SPANS))
        return F.struct(end.alias("at"), F.when(F.length(m.value) >= least, F.array_append(found, span)).otherwise(found).alias("out"))

    def begin(done: Column, size: Column) -> Column:
        found = F.coalesce(done.out, F.array().cast("array<int>"))
        return F.struct((done.at + size).alias("at"), F.array_append(found, done.at).alias("out"))

    def spans(blocks: Column) -> Column:
        # An array is copied when it grows, so spans are collected block by block.
        sizes = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, m: n + F.length(m.gap) + F.length(m.whole)))
        starts = F.aggregate(sizes, start(F.lit(0), "array<int>"), begin).out
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), starts.alias("at")), lambda b: F.aggregate(b.block, start(b.at, _SPANS), step).out))

    def in_blocks(m: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / MATCHES).cast("int")), lambda b: F.slice(m, b * MATCHES + 1, MATCHES))

    # The last gap has no match.
    found = bound(bound(F.filter(matches, lambda m: m.whole.isNotNull()), in_blocks), spans)
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(_SPANS))


def apart(tokens: Column, base: Column, length: Column) -> Column:
    """The tokens that overlap no span of ``base``; each is held against the spans near it only."""

    def of_cell(cell: Column, tokens: Column, base: Column) -> Column:
        mine = F.filter(tokens, lambda t: (t.start >= cell * CELL) & (t.start < (cell + 1) * CELL))

        def among(mine: Column) -> Column:
            end = F.try_element_at(mine, F.lit(-1)).end
            near = F.filter(base, lambda b: (b.end > cell * CELL) & (b.start < end))
            return bound(near, lambda near: F.filter(mine, lambda t: ~F.exists(near, lambda b: (b.start < t.end) & (t.start < b.end))))

        return bound(mine, among)

    cells = F.sequence(F.lit(0), F.floor(length / CELL).cast("int"))
    each = bound(tokens, lambda t: bound(base, lambda b: F.flatten(F.transform(cells, lambda cell: of_cell(cell, t, b)))))
    return F.when((F.size(tokens) == 0) | (F.size(base) == 0), tokens).otherwise(each)


def base_spans(text: Column) -> Column:
    assign = located(text, ASSIGN, 0, 1, LEAST["assign"])
    access = located(text, ACCESS + r"(?<=[A-Z0-9]{%d})" % LEAST["access"], 1, 0, LEAST["access"])
    # Only runs that are long enough matter, and a run is matched whole: the shorter ones are passed over.
    hexes = located(text, r"(?<![0-9a-f])[0-9a-f]{%d,}+" % LEAST["hex"], 2, 0, LEAST["hex"])
    return F.concat(assign, access, hexes)


def _transitions(strings: DataFrame, name: str) -> DataFrame:
    """Counts of character pairs over a column of strings."""
    at = F.explode(F.sequence(F.lit(1), F.length(name) - 1))
    pairs = strings.filter(F.length(name) > 1).select(name, at.alias("i"))
    state = lambda i: F.instr(F.lit(ALPHABET), F.substring(name, i, F.lit(1)))
    return pairs.select(state(F.col("i")).alias("x"), state(F.col("i") + 1).alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def shaped(words: DataFrame) -> DataFrame:
    """``(value)``: paths, page and host addresses, dates and identifiers from an array column ``words`` of letter words."""
    at = F.explode(F.when(F.size("words") > 3, F.sequence(F.lit(1), F.size("words") - 2, F.lit(3))))
    three = words.select("words", at.alias("i")).select(F.slice("words", F.col("i"), 3).alias("w"))
    three = three.select(*[F.col("w")[k].alias(f"w{k}") for k in range(3)], F.xxhash64("w").alias("h"))
    lower = [F.lower(f"w{k}") for k in range(3)]
    title = [F.initcap(f"w{k}") for k in range(3)]
    number = lambda shift, below: F.pmod(F.shiftright("h", shift), F.lit(below)).cast("int")
    day = F.date_add(F.lit("1970-01-01").cast("date"), number(3, 25_000))
    shapes = [
        F.concat_ws("/", F.lit("src"), lower[0], lower[1], F.concat(title[2], F.lit(".java"))),
        F.concat(F.lit("/"), F.concat_ws("/", *lower)),
        F.concat(F.lit("//www."), lower[0], F.lit(".com/"), lower[1], F.lit("/"), lower[2]),
        F.concat(lower[0], number(5, 100).cast("string"), F.lit("."), lower[1], F.lit(".org")),
        F.concat_ws("_", *lower),
        F.concat_ws("_", *map(F.upper, lower)),
        F.concat_ws("-", *lower),
        F.concat_ws(".", *lower),
        F.concat(lower[0], title[1], title[2]),
        F.concat(*title, number(7, 100).cast("string")),
        F.concat_ws(".", *[number(8 * k, 256).cast("string") for k in range(4)]),
        F.concat(F.date_format(day, "yyyy-MM-dd'T'"), F.lpad(number(9, 24).cast("string"), 2, "0")),
        F.concat(F.date_format(day, "yyyy/MM/dd/"), lower[0]),
        F.concat(lower[0], F.date_format(day, "-yyyy-MM-dd")),
    ]
    return three.select(F.explode(F.array(*shapes)).alias("value")).filter(F.length("value").between(LEAST_TOKEN, 60))


def digests(seeds: DataFrame) -> DataFrame:
    """``(value)``: a digest of every value, cut to 12 to 40 characters, in one of the usual alphabets of keys."""
    h = F.xxhash64(F.lit("key"), "value")
    text = F.base64(F.unhex(F.sha2(F.concat(F.lit("key "), "value"), 256)))
    text = F.regexp_replace(text, "=", "")
    bare = F.regexp_replace(text, "[+/]", "")
    forms = F.array(text, bare, bare, F.upper(bare), F.lower(bare), F.regexp_replace(text, "[^A-Za-z]", ""), F.concat(F.substring(bare, 1, 9), F.lit("."), F.substring(bare, 10, 20)))
    form = F.element_at(forms, F.pmod(h, F.lit(7)).cast("int") + 1)
    return seeds.select(F.substring(form, F.lit(1), F.pmod(F.shiftright(h, 8), F.lit(29)).cast("int") + 12).alias("value"))


def train(docs: DataFrame) -> Model:
    """Log-likelihood ratios of all transitions (random against ordinary), row after row, and thresholds.

    The labelled samples are bounded. Random are the ``SAMPLE_STRINGS`` pattern values first in hash order and as many
    digests. Ordinary are the words of the ``SAMPLE_TEXTS`` different texts first in hash order among those without a
    pattern span, and the ``SAMPLE_SHAPED`` strings first in hash order of those put together from these words. Only
    counts reach the driver, one per transition at most. Without ordinary strings all ratios are 0 and nothing is reported.

    Strings held out of the counts give the thresholds: for every class of lengths, halfway between the quantile that
    ordinary strings stay below and the median of random ones, or the former where the two overlap.
    """
    texts = docs.select("text").filter("text is not null")
    marked = texts.filter(F.regexp_like("text", F.lit(f"{ASSIGN}|{ACCESS}|[0-9a-f]{{16}}")))
    values = marked.select(F.explode(base_spans(F.col("text"))).alias("s")).select("s.value").distinct()
    plain = texts.filter(~F.regexp_like("text", F.lit(f"{ASSIGN}|{ACCESS}|[0-9a-f]{{16}}")))
    plain = kept(first_by_hash(plain, "text", SAMPLE_TEXTS), "plain")
    words = plain.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("value"))
    made = kept(first_by_hash(shaped(plain.select(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("words"))), "value", SAMPLE_SHAPED), "shaped")
    random_strings = first_by_hash(values, "value", SAMPLE_STRINGS).union(digests(first_by_hash(made, "value", SAMPLE_STRINGS)))
    held = F.pmod(F.xxhash64(F.lit("held out"), "value"), F.lit(HELD_OUT)) == 0
    random_strings, ordinary = kept(random_strings, "random_strings"), kept(words.union(made), "ordinary")
    counts = []
    for strings in (random_strings, ordinary):
        table = [[0] * STATES for _ in range(STATES)]
        for x, y, n in _transitions(strings.filter(~held), "value").collect():
            table[x][y] += n
        counts.append(table)
    if not all(sum(map(sum, t)) for t in counts):
        return Model([0.0] * (STATES * STATES), [0.0] * len(CLASSES))
    random, plain_counts = map(_probabilities, counts)
    ratios = [math.log(random[x][y] / plain_counts[x][y]) for x in range(STATES) for y in range(STATES)]
    low, high = _quantiles(ordinary.filter(held), ratios, ORDINARY_BELOW), _quantiles(random_strings.filter(held), ratios, 0.5)
    return Model(ratios, [_between(low.get(c), high.get(c)) for c in range(len(CLASSES))])


def length_class(value: Column) -> Column:
    """Place of the length of a token in ``CLASSES``."""
    return sum((F.length(value) >= c).cast("int") for c in CLASSES[1:])


def _quantiles(strings: DataFrame, ratios: list[float], share: float) -> dict[int, float]:
    """The quantile of the ratios of the strings of each class of lengths."""
    scored = strings.filter(F.length("value") >= LEAST_TOKEN).select(length_class(F.col("value")).alias("c"), likelihood_ratio(F.col("value"), _table(ratios)).alias("r"))
    return {r["c"]: r["q"] for r in scored.groupBy("c").agg(F.percentile("r", share).alias("q")).collect()}


def _between(low: float | None, high: float | None) -> float:
    """Threshold between the ordinary strings up to ``low`` and the random ones around ``high``; 0 without strings."""
    if low is None or high is None:
        return max(low or 0.0, 0.0)
    return max((low + high) / 2, low)


def _table(ratios: list[float]) -> Column:
    """One literal array, folded once when the plan is made."""
    return F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")


def _probabilities(counts: list[list[int]]) -> list[list[float]]:
    """Transition probabilities, a state seen seldom leaning on the frequency of the character that follows."""
    total = sum(map(sum, counts))
    follows = [(sum(row[y] for row in counts) + 0.5) / (total + 0.5 * STATES) for y in range(STATES)]
    return [[(row[y] + BACK_OFF * follows[y]) / (sum(row) + BACK_OFF) for y in range(STATES)] for row in counts]


def likelihood_ratio(token: Column, ratios: Column) -> Column:
    """Mean log-likelihood ratio per transition of a token."""
    state = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(token) - 1),
        F.lit(0.0),
        lambda done, i: done + F.element_at(ratios, state(i) * STATES + state(i + 1) + 1),
    )
    return total / (F.length(token) - 1)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per input row: doc_id, ``base`` and ``spans`` (arrays of start, rank, end, value).

    ``rank`` is the place of the kind in ``KINDS``; spans stand by start, then kind. A null text is empty. Null and
    repeated ids and repeated rows stay as they are; other columns are ignored. An empty table gives an empty result.
    """
    model = train(docs) if model is None else model
    table = _table(model.ratios)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    length = F.length("text")
    found = texts.select("doc_id", length.alias("length"), base_spans(F.col("text")).alias("base"), located(F.col("text"), TOKEN, 3, 0, LEAST_TOKEN).alias("tokens"))
    least = lambda t: F.element_at(F.array(*map(F.lit, model.thresholds)), length_class(t.value) + 1)
    random = F.filter(apart(F.col("tokens"), F.col("base"), F.col("length")), lambda t: likelihood_ratio(t.value, table) > least(t))
    return found.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", random)).alias("spans"))


def _joined(spans: str) -> Column:
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s.rank + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s.start, s.end)), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the pattern spans, and all spans as text."""
    count = lambda rank: F.size(F.filter("base", lambda s: s.rank == rank)).cast("long")
    return scan(docs).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )
