"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source deals its documents in a shuffled order, pass after pass. A document's virtual finish time is the
source's words up to and including it, divided by the source's target. In the global order of finish times every
source advances at its own rate, and at time 1 every source has given its target: there the total budget is used up
and the order is cut. The document that a source is giving at that moment is cut after the last word within the
target, or left out where only whole documents are wanted.

Running totals per source go through buckets of the shuffle, so that a source with any share of the rows is spread
over tasks. The one window over all sources runs on one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorlens.llm.tables import bucket_count, kept, numbered
from vectorlens.llm.words import word_count

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
PASSES = 2
# Entries joined with their texts by broadcast (about 60 bytes each), by a shuffle join beyond.
BROADCAST_ENTRIES = 500_000


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, passes: int = PASSES) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources by code point, null last, take the weights in turn and share ``budget`` times all words. A target stops
    at ``passes`` times its source; the excess goes to the others by weight until none is above. This is the
    level at which all targets add up: sources are filled in the order of limit by weight.
    """
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    limit = F.col("source_size") * float(passes)
    whole = Window.partitionBy()
    named = sizes.withColumn("weight", weight).withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum("limit").over(by_ratio), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    total = F.sum("source_size").over(whole) * budget
    named = named.withColumn("level", (total - filled) / open_weight)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)
    named = named.withColumn("level", level["level"])
    target = F.least("limit", F.coalesce(F.col("weight") * F.col("level"), F.col("limit")))
    return named.select("source", "source_size", target.alias("target"))


def dealt_documents(docs: DataFrame, seed: str = "", **shares) -> DataFrame:
    """One row per document: its place in the shuffled order of its source.

    Columns: ``doc_id``, ``text_key`` (hash of the text), ``source``, ``size``, ``source_size``, ``target``,
    ``before`` (words of the source that come earlier in a pass), ``shuffle``. A null text has no words. A null source
    is a source of its own, a null id is shuffled as the text 'null'. Rows that repeat an id are told apart by text.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(seed)))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("shuffle"), F.xxhash64("text").alias("text_key"))
    rows = kept(rows, "mix-rows")
    sizes = kept(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-sources")
    buckets = bucket_count(sizes.agg(F.sum("n")).first()[0] or 0)
    bucket = F.floor(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("double") / 2**32 * buckets).cast("int")
    placed = numbered(rows.withColumn("bucket", bucket), ["source"], "bucket", [F.col("shuffle"), F.col("text_key")], {"before": F.col("size")})
    targets = source_targets(sizes.select("source", "source_size"), **shares)
    # One row per source; the large side is split by adaptive execution where a source is hot.
    joined = placed.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    return joined.select("d.doc_id", "d.text_key", "d.source", "d.size", "t.source_size", "t.target", "d.before", "d.shuffle")


def _taken(start: Column) -> Column:
    """Words of a document that lie under its source's target when it starts after ``start`` words."""
    return F.least(F.greatest(F.floor("target") - start, F.lit(0)), F.col("size"))


def _entries(dealt: DataFrame, whole_only: bool, passes: int) -> DataFrame:
    entries = dealt.withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    start = F.col("before") + F.col("pass_no") * F.col("source_size")
    entries = entries.withColumn("taken", _taken(start)).withColumn("finish", (start + F.col("size")) / F.col("target"))
    return entries.filter(F.col("taken") == F.col("size") if whole_only else F.lit(True)).filter("taken > 0")


def _delivery(prefix: str = "") -> list[Column]:
    at = lambda c: F.col(prefix + c)
    return [at("finish"), at("source").isNull(), at("source"), at("pass_no"), at("shuffle"), at("text_key")]


def _delivered(dealt: DataFrame, whole_only: bool, passes: int) -> DataFrame:
    """Entries of written ``dealt`` rows by virtual finish time, cut where the total budget is given out.

    ``given`` is the words of all sources that stand before an entry. Each of the buckets of finish times is numbered
    on its own.
    """
    entries = _entries(dealt, whole_only, passes)
    buckets = bucket_count(dealt.count() * passes)
    bucket = F.least(F.floor(F.col("finish") * buckets), F.lit(buckets)).alias("bucket")
    entries = numbered(entries.select("*", bucket), [], "bucket", _delivery(), {"given": F.col("taken")}).drop("bucket")
    total = dealt.select("source", F.floor("target").alias("t")).distinct().agg(F.sum("t")).first()[0] or 0
    taken = F.least("taken", F.lit(total) - F.col("given"))
    return entries.withColumn("taken", taken).filter("taken > 0").orderBy(*_delivery())


def mixed_documents(docs: DataFrame, whole_only: bool = False, passes: int = PASSES, **shares) -> DataFrame:
    """The mix in delivery order: one row per document and pass, range-sorted by virtual finish time.

    The columns of :func:`dealt_documents` with ``pass_no``, ``finish`` (1 is the cut), ``taken`` (words given) and
    ``given`` (words given before). Rows past the cut are not there. Documents without words take no part.
    """
    return _delivered(kept(dealt_documents(docs, passes=passes, **shares), "mix-dealt"), whole_only, passes)


def mixed_rows(docs: DataFrame, passes: int = PASSES, **shares) -> DataFrame:
    """The rows of the mix in delivery order, all columns of ``docs`` kept: whole documents only.

    The mix is made on short keys, and texts move once, for the final range sort. Rows that repeat both an id and a
    text are one document here.
    """
    docs_key = F.struct(F.col("doc_id").isNull(), F.coalesce(F.col("doc_id"), F.lit(0)), F.xxhash64("text"))
    repeated = docs.groupBy(docs_key.alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        docs = docs.dropDuplicates(["doc_id", "text"])
    entries = kept(_entries(dealt_documents(docs, passes=passes, **shares), True, passes), "mix-entries")
    small = entries.count() <= BROADCAST_ENTRIES
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.xxhash64("row.text") == F.col("e.text_key"))
    joined = rows.join((F.broadcast(entries) if small else entries).alias("e"), same)
    return joined.orderBy(*_delivery("e.")).select("row.*")


def mix_report(docs: DataFrame, passes: int = PASSES, **shares) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words over all passes), and its first finish time.

    The mix is written in delivery order, and each document adds up its entries there; documents not taken are
    included. A document with words is known by its source and the words before it.
    """
    dealt = kept(dealt_documents(docs, passes=passes, **shares), "mix-dealt")
    mix = kept(_delivered(dealt, False, passes), "mix")
    given = mix.groupBy("source", "before").agg(F.sum("taken").alias("taken"), F.min("finish").alias("finish"))
    same = F.col("d.source").eqNullSafe(F.col("g.source")) & (F.col("d.before") == F.col("g.before")) & (F.col("d.size") > 0)
    taken = F.coalesce("g.taken", F.lit(0)).cast("long").alias("taken")
    return dealt.alias("d").join(given.alias("g"), same, "left").select("d.doc_id", "d.size", "d.source_size", "d.target", taken, "g.finish")
