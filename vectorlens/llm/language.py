"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. Three letters in a row are bound by multiplying their vectors after
rotating the first twice and the second once. A text is the sum (bundle) of its trigram vectors, a language the
bundle of its training texts; texts are compared with the languages by cosine.

The bundle of a language is added up in tasks, one vector per language and piece of input, as whole numbers, so the
sum does not depend on the order. Only the prototypes, one vector per language, reach the driver and the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorlens.llm.tables import kept
from vectorlens.llm.words import pieces

WIDTH = 512
# Letter codes: 0 for everything that is not a letter, 1 to 26 for a to z, the others share the rest.
LETTERS = 64
UNKNOWN = "und"
# Text bytes taken at once: every letter has some fifty bytes of codes, rows and places on its way to a count.
LETTER_BYTES = 1 << 18
# Texts whose trigram counts stand in one dense matrix, and trigrams whose vectors do.
TEXTS_AT_ONCE, TRIGRAMS_AT_ONCE = 128, 4096
# The filtering stage compares texts of a like number of different trigrams, in classes that double. What sets the least
# cosine of a class: all labelled texts of the held-out fold, pieces cut from each, and made random texts.
CLASSES = range(3, 13)
CUTS, NOISE_TEXTS = 2, 200
# Steps of a score in which a quantile is looked for; the values of one step are then told apart.
STEPS = 1 << 14
# Quantiles of whole texts, of pieces, and of random texts; fewest texts that stand for a class.
LOW, LOW_OF_PIECES, HIGH, FEWEST = 0.001, 0.01, 0.99, 20
# A class tells languages from noise if the low quantile is so many times the high one of noise.
TELLING = 1.2


@lru_cache
def _letter_codes() -> np.ndarray:
    """Code of every code point of the basic plane, after lower-casing."""
    codes = np.array([27 + i % (LETTERS - 27) if chr(i).isalpha() else 0 for i in range(1 << 16)], dtype=np.int32)
    codes[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return codes


@lru_cache
def _letter_vectors() -> np.ndarray:
    """Random signs, fixed by a seed: row i for letter code i."""
    return np.random.RandomState(20).choice(np.array([-1, 1], dtype=np.int8), size=(LETTERS, WIDTH))


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors of trigram codes."""
    letters = _letter_vectors()
    first, second, third = codes // (LETTERS * LETTERS), codes // LETTERS % LETTERS, codes % LETTERS
    return np.roll(letters, 2, axis=1)[first] * np.roll(letters, 1, axis=1)[second] * letters[third]


def _bundled(counts: np.ndarray, vectors: np.ndarray, kind: type) -> np.ndarray:
    """Sums of the vectors of trigrams, each as often as counted in a row; ``kind`` is that of the products.

    Vectors stay single bytes but for a slice of them.
    """
    sums = np.zeros((len(counts), WIDTH))
    for first in range(0, len(vectors), TRIGRAMS_AT_ONCE):
        part = slice(first, first + TRIGRAMS_AT_ONCE)
        sums += counts[:, part].astype(kind) @ vectors[part].astype(kind)
    return sums


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, code, has_letter)``: the trigrams of every text, and whether a text has a letter.

    Everything between two letters counts as one blank, as do both ends of a text.
    """
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")).to_pylist()
    joined = " ".join(["", *lower, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = _letter_codes()
    letter = table[np.minimum(points, (1 << 16) - 1)]
    beyond = np.flatnonzero(points >= 1 << 16)
    letter[beyond] = [27 + p % (LETTERS - 27) if chr(p).isalpha() else 0 for p in points[beyond].tolist()]
    sizes = np.array([len(t) + 1 for t in lower], dtype=np.int64)
    row = np.repeat(np.arange(-1, len(lower), dtype=np.int32), np.concatenate(([1], sizes)))
    keep = np.concatenate(([True], (letter[1:] != 0) | (letter[:-1] != 0)))
    letter, row = letter[keep], row[keep]
    has_letter = np.bincount(row[letter != 0], minlength=len(lower)).astype(bool) if len(lower) else np.empty(0, bool)
    if len(letter) < 3:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), has_letter
    code = (letter[:-2] * LETTERS + letter[1:-1]) * LETTERS + letter[2:]
    # A trigram belongs to the text of its middle letter; one around a bare blank joins two words or texts.
    inside = letter[1:-1] != 0
    return row[1:-1][inside], code[inside], has_letter


def _training(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, limit=LETTER_BYTES):
                row, code, _ = trigrams(piece.column("text"))
                names = piece.column("lang").dictionary_encode()
                lang = names.indices.to_numpy()[row]
                distinct, at = np.unique(code, return_inverse=True)
                size = len(names.dictionary)
                counts = np.bincount(lang * len(distinct) + at, minlength=size * len(distinct)).reshape(size, -1)
                sums = np.rint(_bundled(counts, trigram_vectors(distinct), np.float64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([names.dictionary, pa.array(list(sums), pa.list_(pa.int64()))], ["lang", "bundle"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, bundle array<long>")


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Language names in code point order and their unit vectors, from rows with a text and a language."""
    parts = _training(docs.filter("text is not null and lang is not null")).select("lang", F.posexplode("bundle").alias("dim", "v"))
    sums = parts.groupBy("lang", "dim").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "v"))).alias("b"))
    found = sorted((r["lang"], [v for _, v in r["b"]]) for r in sums.collect())
    vectors = np.array([v for _, v in found], dtype=np.float64).reshape(len(found), WIDTH)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return [name for name, _ in found], vectors / np.where(norms > 0, norms, 1.0)


def predicted(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to all columns of ``docs``; reads the column ``text`` only.

    ``score`` is the cosine with the best language, at least 0; ties go to the first name. A text that is null or has
    no letter is ``und`` with score 0, as is every text if no language was learned.
    """
    return _scored(docs, model).drop("trigrams")


def _scored(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``predicted`` with the number of different trigrams of each text."""
    names, vectors = model
    shared = docs.sparkSession.sparkContext.broadcast((names, vectors.T.astype(np.float32)))

    @F.arrow_udf("struct<lang_pred: string, score: double, trigrams: long>")
    def best(texts: pa.Array) -> pa.Array:
        names, protos = shared.value
        langs, scores, counted = [], [], []
        for piece in pieces(pa.RecordBatch.from_arrays([texts], ["text"]), limit=LETTER_BYTES):
            row, code, has_letter = trigrams(piece.column("text"))
            distinct, at = np.unique(code, return_inverse=True)
            vectors = trigram_vectors(distinct)
            edges = np.searchsorted(row, np.arange(0, len(has_letter) + TEXTS_AT_ONCE, TEXTS_AT_ONCE))
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                rows = min(TEXTS_AT_ONCE, len(has_letter) - i * TEXTS_AT_ONCE)
                spot = (row[a:b] - i * TEXTS_AT_ONCE) * len(distinct) + at[a:b]
                counts = np.bincount(spot, minlength=rows * len(distinct)).reshape(rows, -1)
                counted += np.count_nonzero(counts, axis=1).tolist()
                bundle = _bundled(counts, vectors, np.float32)
                norm = np.linalg.norm(bundle, axis=1)
                if names:
                    cosine = (bundle @ protos.astype(np.float64)) / np.where(norm > 0, norm, 1.0)[:, None]
                    pick = cosine.argmax(axis=1)
                    value = np.clip(cosine[np.arange(rows), pick], 0.0, 1.0)
                for j in range(rows):
                    known = bool(names) and has_letter[i * TEXTS_AT_ONCE + j]
                    langs.append(names[pick[j]] if known else UNKNOWN)
                    scores.append(float(value[j]) if known else 0.0)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(counted, pa.int64())], names=["lang_pred", "score", "trigrams"])

    # Said to be nondeterministic so that a filter on a score stays above: moved below, it scores every text once more.
    hit = best.asNondeterministic()("text")
    return docs.select("*", hit.alias("__hit")).select(*[F.col(f"`{c}`") for c in docs.columns], "__hit.lang_pred", "__hit.score", "__hit.trigrams")


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from rows outside the held-out fold only.

    Null and repeated ids and repeated rows stay rows of their own; other columns are ignored.
    """
    rows = docs.select("doc_id", "text", "lang", (fold() == 1).alias("held_out"))
    model = prototypes(rows.filter(~F.col("held_out")))
    return predicted(rows.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def _noise(random: np.random.RandomState, size: int) -> str:
    """Random letters in words of random lengths, about ``size`` characters."""
    letters = "".join(chr(ord("a") + i) for i in random.randint(26, size=size))
    ends = np.cumsum(random.randint(1, 14, size=size))
    return " ".join(letters[a:b] for a, b in zip(np.concatenate(([0], ends)), ends, strict=False) if a < size)


def _quantiles(scores: DataFrame, wanted: dict[str, float]) -> dict[tuple[str, int], float]:
    """The quantile of ``score`` in each ``(kind, c)`` of at least ``FEWEST`` rows, exactly, between neighbours in proportion.

    Counts of ``STEPS`` steps show where the two neighbours lie; of these steps alone all values are counted.
    """
    step = F.least(F.floor(F.col("score") * STEPS), F.lit(STEPS - 1)).cast("int").alias("step")
    counts = {}
    # At most STEPS rows for each kind and class.
    for r in scores.groupBy("kind", "c", step).count().collect():
        counts.setdefault((r["kind"], r["c"]), []).append((r["step"], r["count"]))
    places, looked = {}, []
    for key, held in counts.items():
        steps, n = np.array(sorted(held)).T
        ends = np.cumsum(n)
        if ends[-1] >= FEWEST:
            exact = wanted[key[0]] * (ends[-1] - 1)
            sides = [int(np.floor(exact)), int(np.ceil(exact))]
            at = np.searchsorted(ends, sides, side="right")
            places[key] = (exact - sides[0], sides, [int(ends[i] - n[i]) for i in at], [int(steps[i]) for i in at])
            looked += [(*key, s) for s in set(places[key][3])]
    if not looked:
        return {}
    chosen = F.broadcast(scores.sparkSession.createDataFrame(looked, "kind string, c int, step int"))
    values = {}
    for r in scores.select("kind", "c", step, "score").join(chosen, ["kind", "c", "step"]).groupBy("kind", "c", "step", "score").count().collect():
        values.setdefault((r["kind"], r["c"], r["step"]), []).append((r["score"], r["count"]))
    out = {}
    for key, (share, sides, before, steps) in places.items():
        ends = []
        for place, first, s in zip(sides, before, steps, strict=True):
            score, n = zip(*sorted(values[(*key, s)]), strict=True)
            ends.append(score[int(np.searchsorted(np.cumsum(n), place - first, side="right"))])
        out[key] = ends[0] + share * (ends[1] - ends[0])
    return out


def least_cosines(labelled: DataFrame, model: tuple[list[str], np.ndarray]) -> list[tuple[int, float]]:
    """``(trigrams, cosine)``: what texts of at least so many different trigrams must reach to count as a known language.

    Labelled texts that the model has not seen score with their own likes, all of them; pieces of all that are long enough
    stand in for a class with few texts. Made texts of random letters score as noise. The bound lies halfway between the low
    quantile of the former and the high quantile of noise; a class in which these are not apart says too little to reject a
    text.
    """
    texts = labelled.select("text")
    wholes = _class_scores(texts.withColumn("kind", F.lit("whole")), model)
    random = np.random.RandomState(21)
    noise = [(_noise(random, int(1.1 * 2**c)), "noise") for c in CLASSES for _ in range(NOISE_TEXTS)]
    noise = _class_scores(labelled.sparkSession.createDataFrame(noise, "text string, kind string"), model)
    at = _quantiles(kept(wholes.unionByName(noise), "language-scores"), {"whole": LOW, "noise": HIGH})
    few = [c for c in CLASSES if ("whole", c) not in at]
    if few:
        cuts = texts.select("text", F.length("text").alias("l"), F.explode(F.array(*[F.lit(2**c) for c in few])).alias("z"))
        cuts = cuts.filter("l >= z").select("l", "z", "text", F.explode(F.sequence(F.lit(0), F.lit(CUTS - 1))).alias("i"))
        start = F.pmod(F.xxhash64("text", "z", "i"), F.col("l") - F.col("z") + 1).cast("int") + 1
        cut = cuts.select(F.substring("text", start, (F.col("z") * 1.4).cast("int")).alias("text"), F.lit("piece").alias("kind"))
        at |= _quantiles(kept(_class_scores(cut, model), "language-pieces"), {"piece": LOW_OF_PIECES})
    out = []
    for c in CLASSES:
        own, noisy = at.get(("whole", c), at.get(("piece", c))), at.get(("noise", c))
        if own is not None and noisy is not None:
            out.append((2**c, 0.5 * (own + noisy) if own > TELLING * noisy else 0.0))
    return out


def _class_scores(texts: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    level = F.least(F.floor(F.log2("trigrams")), F.lit(CLASSES[-1])).cast("int").alias("c")
    return _scored(texts, model).filter("trigrams > 0").select("kind", level, "score")


def known_language(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` in a known language, all columns kept; others are rejected.

    Rejected are texts without a letter, and texts whose best cosine is below that of ``least_cosines`` for their
    number of different trigrams: a word repeated many times says as little as the word. With no labelled row there is no language to know, and every text with a letter is kept.
    """
    model = prototypes(docs.filter(fold() != 1))
    if not model[0]:
        return docs.filter(F.regexp_like("text", F.lit(r"\p{L}")))
    least = F.lit(0.0)
    for size, cosine in least_cosines(docs.filter((fold() == 1) & F.expr("text is not null and lang is not null")), model):
        least = F.when(F.col("hit.trigrams") >= size, F.lit(cosine)).otherwise(least)
    found = _scored(docs.select(F.struct("*").alias("row"), "text"), model)
    found = found.select("row", F.struct("lang_pred", "score", "trigrams").alias("hit"))
    return found.filter((F.col("hit.lang_pred") != UNKNOWN) & (F.col("hit.score") >= least)).select("row.*")
