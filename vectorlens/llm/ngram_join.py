"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

Every text becomes the set of its distinct n-word shingles. Tokens stand in one global order: ordinary tokens by
hash, then the heaviest tokens by document frequency. For a similarity of at least ``t`` two sets of sizes x and y
share ``need`` tokens within their first ``x - ceil(t*x) + need`` and ``y - ceil(t*y) + need`` tokens. Each
document picks its own ``need``: the longer prefix costs more postings, but a pair must then share as many prefix
tokens before it is verified. A pair is held to the smaller ``need`` of its two sides, for which both prefixes
are long enough.

Copies, and all texts with equal sets, are one class from the start. Posting lists of up to ``SMALL_LIST`` classes
emit their pairs. Longer lists, as a large group of near copies makes, first go through rounds whose cost is linear:
each node stands in its longest list only, the list is dealt into blocks, anew in every round, and a block is compared
with itself. So a group of near copies becomes one component without one block meeting another. Then the members outside
a list's largest component are compared, block by block, with members of other components; lists with the same members
are one. A task returns only a forest of the candidates it sees, which joins them with one pair per member; the last round
returns all candidates that still lie between components. No link between different components is missed, and no group
emits all its pairs.

Numbers of links are exact all the same. Only two nodes that both stand in longer lists can have a link that was not
verified, and it lies inside a component. Such nodes of a component meet once more, block by block, all with all, and
a task returns how many links each of its nodes has, never the pairs.

Before texts are moved to verify a pair, its parity sketches are compared: tokens fall into ``SKETCH_BITS`` cells, a
bit says whether a cell holds an odd number of them, and two sketches never differ in more bits than the sets differ
in tokens. So a pair is dropped only where it cannot be a link; all others are counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorlens.llm.components import connected_components
from vectorlens.llm.tables import kept, with_text_key, without
from vectorlens.llm.words import folded_shingles, mixed, pieces, ranges

# Posting lists up to this length emit all their pairs.
SMALL_LIST = 64
# Members of a block of a longer list that is compared with itself, and rounds of this.
OWN_BLOCK, OWN_ROUNDS = 1024, 2
# Members of a block of a longer list that meets other blocks, and rounds in which its tasks return a forest.
BLOCK, FOREST_ROUNDS = 4096, 1
# Largest number of shared prefix tokens that a document may ask for.
MAX_NEED = 4
# Bits of a parity sketch.
SKETCH_BITS = 2048
# Cost of verifying a candidate against reading one posting, for the choice of a prefix.
VERIFY_COST = 8.0
# Nodes and shingles of a block in which links are counted, and cells of a block pair that are added up at once.
COUNT_BLOCK, COUNT_WORDS, COUNT_CELLS = 512, 1_000_000, 4_000_000
# The token order moves at most so many heavy tokens to its end: 16 bytes each in every task, whatever the input.
HEAVY_TOKENS = 65_536
# A token is offered as heavy where this many texts of a piece hold it, and is heavy from this many texts in all.
HEAVY_IN_PIECE, HEAVY_IN_ALL = 4, 32
# Shingles whose prefixes, or whose texts, one task takes; a task for two blocks of a component takes twice as many.
WORDS_PER_TASK = 2_000_000
# Texts to verify are found by broadcast up to so many keys (about 40 bytes each), by a shuffle join beyond.
BROADCAST_TEXT_KEYS = 500_000


@dataclass(frozen=True)
class Join:
    """``members``: one row per input row (row columns, ``node``, ``n``); ``links``: verified pairs of nodes, all but
    those between two ``hot`` nodes, of which enough stand here to connect them; ``components``: node to component for
    linked nodes; ``hot``: nodes in longer lists, with size and a row that holds the text. A node is the signature of
    a set."""

    members: DataFrame
    links: DataFrame
    components: DataFrame
    hot: DataFrame


def required(n: np.ndarray | int, percent: int):
    """Least overlap of a set of n tokens with any set at least that similar."""
    return -(-percent * n // 100)


def _heavy_tokens(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens and their document frequencies, both in token order.

    The order decides cost only: any order gives the same links. So a token too thinly spread to be offered is
    merely treated as ordinary.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                tokens = np.concatenate(folded_shingles(piece.column("text"), width))
                tokens.sort()
                last = tokens[HEAVY_IN_PIECE - 1 :]
                often = np.unique(last[last == tokens[: len(last)]])
                counts = np.searchsorted(tokens, often, side="right") - np.searchsorted(tokens, often)
                yield pa.RecordBatch.from_arrays([pa.array(often.view(np.int64)), pa.array(counts)], ["token", "n"])

    seen = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = seen.filter(F.col("n") >= HEAVY_IN_ALL).orderBy(F.desc("n"), "token").limit(HEAVY_TOKENS).collect()
    tokens = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)
    counts = np.array([r[1] for r in rows], dtype=np.float64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def choose_prefix(ordered_df: np.ndarray, n: int, percent: int) -> tuple[int, int]:
    """``(need, length)`` of the cheapest prefix; ``ordered_df`` has the frequencies in token order."""
    least = required(n, percent)
    best = None
    for need in range(1, min(MAX_NEED, least) + 1):
        length = n - least + need
        postings = float(ordered_df[:length].sum() - length)
        cost = postings * (1.0 + VERIFY_COST / need)
        if best is None or cost < best[0]:
            best = (cost, need, length)
        if postings == 0:
            break
    return best[1], best[2]


def signature(tokens: np.ndarray) -> int:
    """64 bits that name a set: its size and two sums of differently mixed tokens."""
    size = np.uint64(len(tokens))
    with np.errstate(over="ignore"):
        one = mixed(np.array([tokens.sum(dtype=np.uint64) + size]))
        two = mixed(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
        return int(mixed(one + two).view(np.int64)[0])


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """Bits of the cells that hold an odd number of tokens, as 64-bit integers."""
    cells = mixed(tokens + np.uint64(1)) % np.uint64(SKETCH_BITS)
    odd = (np.bincount(cells.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _members(docs: DataFrame, width: int) -> DataFrame:
    """Each row with the node, size and sketch of its set; no node for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                sets = folded_shingles(piece.column("text"), width)
                nodes = pa.array([signature(s) if len(s) else None for s in sets], pa.int64())
                sizes = pa.array([len(s) for s in sets], pa.int64())
                sketches = pa.array([parity_sketch(s) if len(s) else None for s in sets], pa.list_(pa.int64()))
                columns = [piece.column("doc_id"), piece.column("text_key"), nodes, sizes, sketches]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "node", "n", "sketch"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id long, text_key long, node long, n long, sketch array<long>")


def _sketches_allow(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes whose sketches differ in no more bits than the sets of a link may differ in tokens."""
    side = lambda name: classes.select(F.col("node").alias(name), F.struct("n", "sketch").alias(f"{name}_set"))
    bits = F.aggregate(F.zip_with("a_set.sketch", "b_set.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.filter(bits * (100 + percent) <= (F.col("a_set.n") + F.col("b_set.n")) * (100 - percent)).select("a", "b")


def _shared_postings(docs: DataFrame, width: int, percent: int, heavy: tuple[np.ndarray, np.ndarray], total: int) -> DataFrame:
    """``(token, node, n, pos, need)`` of the prefix tokens that more than one node holds.

    Copies inside a piece of input give one posting. Tasks that meet the postings of a range of tokens keep those
    of repeated tokens. A heavy token is known to be repeated, so its postings are dealt out by node as well.
    """
    session = docs.sparkSession
    shared = session.sparkContext.broadcast(heavy)
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-total // WORDS_PER_TASK))
    fields = ["token", "node", "n", "pos", "need", "salt"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = shared.value
        for batch in batches:
            for piece in pieces(batch):
                seen, out, sizes, needs, lengths = set(), [], [], [], []
                for found in folded_shingles(piece.column("text"), width):
                    n = len(found)
                    node = signature(found) if n else None
                    if node is None or node in seen:
                        continue
                    df = np.ones(n)
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, found), len(tokens) - 1)
                        df = np.where(tokens[at] == found, counts[at], 1.0)
                    order = np.argsort(df, kind="stable")
                    need, length = choose_prefix(df[order], n, percent)
                    seen.add(node)
                    chosen = order[:length]
                    salt = np.where(df[chosen] > 1.0, 1 + (node & 63), 0)
                    out.append((found[chosen].view(np.int64), np.full(length, node), salt, np.arange(length)))
                    sizes.append(n), needs.append(need), lengths.append(length)
                if out:
                    token, node, salt, pos = (np.concatenate(c) for c in zip(*out, strict=True))
                    n, need = np.repeat(sizes, lengths), np.repeat(needs, lengths)
                    kinds = [np.int64, np.int64, np.int32, np.int32, np.int8, np.int8]
                    yield pa.RecordBatch.from_arrays([pa.array(v.astype(t)) for v, t in zip((token, node, n, pos, need, salt), kinds, strict=True)], fields)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or rows.num_rows == 0:
            return
        rows = rows.combine_chunks()
        token, node, salt = (rows[c].to_numpy() for c in ("token", "node", "salt"))
        order = np.lexsort((node, token))
        token, node, salt = token[order], node[order], salt[order]
        fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))
        order, token, salt = order[fresh], token[fresh], salt[fresh]
        same = token[1:] == token[:-1]
        repeated = np.concatenate(([False], same)) | np.concatenate((same, [False])) | (salt > 0)
        yield from rows.select(fields[:5]).take(pa.array(order[repeated])).to_batches()

    schema = "token long, node long, n int, pos int, need byte"
    made = docs.select("text").mapInArrow(emit, schema + ", salt byte")
    return made.repartition(parts, "token", "salt").mapInArrow(meet, schema)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Written ``pairs`` of nodes whose sets are similar enough, counted exactly.

    The pairs of one component of candidates meet in one task, which takes small components up to about
    ``WORDS_PER_TASK``, so each text moves once. The nodes of a component with more words are dealt into blocks, and a
    pair meets in the task of its two blocks; a task holds the texts of two blocks at most.
    """
    labels = connected_components(pairs)
    wanted = kept(labels.join(classes.select("node", "doc_id", "text_key", "n"), "node"), "wanted")
    words, count = wanted.agg(F.sum("n"), F.count(F.lit(1))).first()
    tasks = max(1, -(-(words or 0) // WORDS_PER_TASK))
    blocks = F.ceil(F.sum("n") / F.lit(WORDS_PER_TASK)).cast("int").alias("blocks")
    large = wanted.groupBy("comp").agg(blocks).filter("blocks > 1")
    home = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("comp"), F.lit(tasks))).otherwise(F.col("comp")).alias("home")
    block = F.when(F.col("blocks").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("node"), "blocks")).cast("int").alias("block")
    homes = kept(wanted.join(large, "comp", "left").select("node", home, block, F.col("doc_id").alias("d"), F.col("text_key").alias("k")), "homes")
    placed = pairs.join(homes.select(F.col("node").alias("a"), "home", F.col("block").alias("x")), "a").join(homes.select(F.col("node").alias("b"), F.col("block").alias("y")), "b")
    placed = placed.select("a", "b", "home", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    uses = placed.select("home", "i", "j", F.explode(F.array("a", "b")).alias("node")).distinct()
    sought = uses.join(homes.select("node", "d", "k"), "node")
    sought = sought.groupBy("d", "k", "node").agg(F.collect_list(F.struct("home", "i", "j")).alias("tasks"))
    if count <= BROADCAST_TEXT_KEYS:
        sought = F.broadcast(sought)
    match = (F.col("k") == F.col("text_key")) & F.col("d").eqNullSafe(F.col("doc_id"))
    texts = docs.join(sought, match).select(F.explode("tasks").alias("t"), "node", "text").select("t.*", "node", "text")

    def verify(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        sets: dict[int, np.ndarray] = {}
        for batch in texts.to_batches():
            sets.update(zip(batch.column("node").to_pylist(), folded_shingles(batch.column("text"), width), strict=True))
        pairs = pairs.select(["a", "b"]).combine_chunks()
        keep = []
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
            x, y = sets[a], sets[b]
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(common * (100 + percent) >= (len(x) + len(y)) * percent)
        return pairs.filter(pa.array(keep, pa.bool_()))

    task = ["home", "i", "j"]
    return placed.groupBy(*task).cogroup(texts.groupBy(*task)).applyInArrow(verify, "a long, b long")


def _sizes_match(percent: int):
    return 100 * F.least("p.n", "q.n") >= percent * F.greatest("p.n", "q.n")


def _rest_suffices(percent: int):
    """At the first token that two sets share, what is left of either bounds their overlap: a true pair passes
    there. Later shared tokens may fail, so they are still counted."""
    left = F.least(F.col("p.n") - F.col("p.pos"), F.col("q.n") - F.col("q.pos"))
    return left * (100 + percent) >= (F.col("p.n") + F.col("q.n")) * percent


def _ordered_pairs():
    swap = F.col("p.node") > F.col("q.node")
    return [
        F.when(swap, F.col("q.node")).otherwise(F.col("p.node")).alias("a"),
        F.when(swap, F.col("p.node")).otherwise(F.col("q.node")).alias("b"),
    ]


def _short_list_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Candidates of the short lists that share enough prefix tokens. Tokens of longer lists (``long``) are not
    counted here, so they count in favour of a pair."""
    member = F.struct("node", "n", "pos", "need", "long")
    lists = postings.filter(F.col("m") <= SMALL_LIST).groupBy("token").agg(F.collect_list(member).alias("list"))
    found = (
        lists.select("list", F.posexplode("list").alias("i", "p"))
        .select("p", F.explode(F.slice("list", F.col("i") + 2, F.greatest(F.size("list") - F.col("i") - 1, F.lit(0)))).alias("q"))
        .filter(_sizes_match(percent))
        .select(*_ordered_pairs(), _rest_suffices(percent).alias("first"), F.least("p.need", "q.need").alias("need"), F.least("p.long", "q.long").alias("long"))
    )
    totals = [F.count(F.lit(1)).alias("c"), F.bool_or("first").alias("first"), F.first("need").alias("need"), F.first("long").alias("long")]
    counted = found.groupBy("a", "b").agg(*totals)
    return counted.filter("first").filter(F.col("c") + F.col("long") >= F.col("need")).select("a", "b")


def _compared(left: pa.Table, right: pa.Table, main: int | None, percent: int, forest: bool) -> pa.Table:
    """Pairs of a left and a right node (``node``, ``comp``, ``n``, ``sketch``) in different components that may be links.

    Nodes outside the component ``main`` stand on both sides and are asked once. All pairs are returned, or a ``forest``
    that joins the components seen here as far as all would.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    if left.num_rows == 0 or right.num_rows == 0:
        return schema.empty_table()
    x, y = ({c: t[c].to_numpy() for c in ("node", "comp", "n")} for t in (left, right))
    bits_x, bits_y = (np.array(t["sketch"].combine_chunks().flatten()).reshape(t.num_rows, -1).view(np.uint64) for t in (left, right))
    in_main = np.zeros(right.num_rows, dtype=bool) if main is None else y["comp"] == main
    found = []
    # Components joined so far, as numbers that change together.
    _, now = np.unique(np.concatenate((x["comp"], y["comp"])), return_inverse=True)
    now_x, now_y = now[: left.num_rows], now[left.num_rows :]
    for i in range(left.num_rows):
        apart = now_y != now_x[i] if forest else y["comp"] != x["comp"][i]
        ask = np.flatnonzero(apart & (in_main | (y["node"] > x["node"][i])))
        small, large = np.minimum(y["n"][ask], x["n"][i]), np.maximum(y["n"][ask], x["n"][i])
        ask = ask[100 * small >= percent * large]
        differ = np.bitwise_count(bits_y[ask] ^ bits_x[i]).sum(axis=1, dtype=np.int64)
        ask = ask[differ * (100 + percent) <= (y["n"][ask] + x["n"][i]) * (100 - percent)]
        if forest and len(ask):
            others, first = np.unique(now_y[ask], return_index=True)
            ask = ask[first]
            own = now_x[i]
            now_x[np.isin(now_x, others)] = own
            now_y[np.isin(now_y, others)] = own
        found += [(min(x["node"][i], o), max(x["node"][i], o)) for o in y["node"][ask]]
    if not found:
        return schema.empty_table()
    a, b = zip(*found, strict=True)
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)


def _named(lists: DataFrame, labels: DataFrame) -> DataFrame:
    return lists.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")).select("token", "node", "comp")


def _own_pairs(firsts: DataFrame, classes: DataFrame, labels: DataFrame, percent: int, turn: int) -> DataFrame:
    """A forest of the candidates inside the blocks of each list; ``firsts`` names one list per node.

    Each turn deals the members anew, so what one turn joins inside its blocks the next one joins across them.
    """
    named = _named(firsts, labels)
    lists = firsts.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / F.lit(OWN_BLOCK)).cast("int").alias("blocks"))
    dealt = named.join(lists, "token").withColumn("i", F.pmod(F.xxhash64(F.lit(turn), "node"), "blocks").cast("int"))
    rows = dealt.join(classes.select("node", "n", "sketch"), "node").select("token", "i", "node", "comp", "n", "sketch")
    return rows.groupBy("token", "i").applyInArrow(lambda t: _compared(t, t, None, percent, True), "a long, b long").distinct()


def _cross_pairs(long_lists: DataFrame, classes: DataFrame, labels: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Candidates in the longer lists whose members are in different components.

    Members outside a list's largest component (``left``) meet all its members (``right``). Both are dealt into
    blocks; a task compares the sketches of one block of each and returns only pairs that may be links: all of them,
    or a ``forest`` that joins the components it sees as far as all would.
    """
    named = _named(long_lists, labels)
    sizes = named.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
    lists = sizes.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("most"), F.sum("k").alias("m")).filter("most.k < m")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    lists = lists.select("token", F.col("most.comp").alias("main"), blocks(F.col("m")).alias("rights"), blocks(F.col("m") - F.col("most.k")).alias("lefts"))
    named = named.join(lists, "token").join(classes.select("node", "n", "sketch"), "node")
    spot = F.xxhash64("node")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    right = named.select("token", F.pmod(spot, "rights").cast("int").alias("j"), every(F.col("lefts")).alias("i"), "node", "comp", "n", "sketch")
    left = named.filter("comp <> main").select("token", every(F.col("rights")).alias("j"), F.pmod(spot, "lefts").cast("int").alias("i"), "node", "comp", "n", "sketch", "main")
    right = right.toDF(*right.columns)  # names of its own, since both sides come from one table

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        main = left["main"][0].as_py() if left.num_rows else None
        return _compared(left, right, main, percent, forest)

    met = left.groupBy("token", "i", "j").cogroup(right.groupBy("token", "i", "j")).applyInArrow(compare, "a long, b long")
    return met.distinct()


def _distinct_lists(long_lists: DataFrame) -> DataFrame:
    """``(token, node)`` of the longer lists, one list for each set of members: two lists are the same where their
    lengths and two sums of differently mixed nodes agree."""
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), "node").cast("decimal(38,0)"))
    named = long_lists.groupBy("token").agg(F.count(F.lit(1)).alias("m"), total(1).alias("s"), total(2).alias("t"))
    tokens = named.groupBy("m", "s", "t").agg(F.min("token").alias("token")).select("token")
    return long_lists.select("token", "node").join(tokens, "token")


def ngram_join(docs: DataFrame, width: int = 4, percent: int = 85) -> Join:
    """Join the texts of ``docs`` (``doc_id``, ``text``; other columns are ignored) on shingle similarity.

    A null or empty text has an empty set, no node and no link. Repeated rows and ids are rows of their own with a
    common node. A null id is kept. An empty table gives empty results.
    """
    docs = with_text_key(docs)
    members = kept(_members(docs, width), "members")
    nodes = members.filter("node is not null").groupBy("node")
    classes = kept(nodes.agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).select("node", "rep.*", "n", "sketch"), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    heavy = _heavy_tokens(docs, width)
    postings = kept(_shared_postings(docs, width, percent, heavy, total), "postings")
    lengths = postings.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    postings = postings.join(lengths, "token")
    long_tokens = postings.groupBy("node").agg(F.count_if(F.col("m") > SMALL_LIST).alias("long"))
    postings = kept(postings.join(long_tokens, "node"), "lists")
    long_lists = postings.filter(F.col("m") > SMALL_LIST)

    # Pairs of longer lists have passed the sketches where they were found.
    pairs = kept(_sketches_allow(_short_list_pairs(postings, percent), classes, percent), "pairs")
    links = kept(_verified(pairs, classes, docs, width, percent), "links")
    labels = kept(connected_components(links), "labels")
    firsts = kept(long_lists.groupBy("node").agg(F.max(F.struct("m", "token")).alias("f")).select("f.token", "node"), "firsts")
    each = kept(_distinct_lists(long_lists), "long-lists")
    for round_no in range(OWN_ROUNDS + FOREST_ROUNDS + 1):
        own = round_no < OWN_ROUNDS
        if own:
            rest = _own_pairs(firsts, classes, labels, percent, round_no)
        else:
            rest = _cross_pairs(each, classes, labels, percent, round_no < OWN_ROUNDS + FOREST_ROUNDS)
        rest = kept(rest, "rest")
        if rest.isEmpty():
            if own:
                continue
            break
        more = _verified(rest, classes, docs, width, percent)
        links = kept(links.unionByName(more).distinct(), "links")
        labels = kept(connected_components(links), "labels")
    hot = long_tokens.filter("long > 0").join(classes, "node").select("node", "doc_id", "text_key", "n")
    return Join(members.drop("sketch"), links, labels, hot)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, exactly.

    Tokens that few sets hold add their pairs one by one, the others as products of matrices.
    """
    out = np.zeros((len(left), len(right)))
    if not left or not right:
        return out
    sides = []
    for sets in (left, right):
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        sides.append((tokens[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]))
    (x, row_x), (y, row_y) = sides
    both = np.intersect1d(x, y)
    first_x, first_y = np.searchsorted(x, both), np.searchsorted(y, both)
    many_x, many_y = np.searchsorted(x, both, side="right") - first_x, np.searchsorted(y, both, side="right") - first_y
    dense = many_x * many_y * 200 > out.size
    for at in np.array_split(np.flatnonzero(dense), max(1, -(-int(dense.sum()) // 2048))):
        a, b = np.zeros((len(left), len(at)), dtype=np.float32), np.zeros((len(right), len(at)), dtype=np.float32)
        a[row_x[ranges(first_x[at], many_x[at])], np.repeat(np.arange(len(at)), many_x[at])] = 1.0
        b[row_y[ranges(first_y[at], many_y[at])], np.repeat(np.arange(len(at)), many_y[at])] = 1.0
        out += a @ b.T
    thin = np.flatnonzero(~dense)
    cells = np.cumsum(many_x[thin] * many_y[thin])
    for at in np.split(thin, np.searchsorted(cells, np.arange(COUNT_CELLS, cells[-1] if len(cells) else 0, COUNT_CELLS))):
        held = ranges(first_x[at], many_x[at])
        times = np.repeat(many_y[at], many_x[at])
        cell = np.repeat(row_x[held], times) * len(right) + row_y[ranges(np.repeat(first_y[at], many_x[at]), times)]
        out += np.bincount(cell, minlength=out.size).reshape(out.shape)
    return out


def link_counts(found: Join, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(node, n_links)``: to how many other nodes each linked node has a link, all links counted.

    Pairs of which a node is not ``hot`` are all among the links. Hot nodes of a component are dealt into blocks, and
    every two blocks meet in a task, which counts on the full sets; a text goes to as many tasks as its component has
    blocks.
    """
    docs = with_text_key(docs)
    hot = kept(found.hot.join(found.components, "node"), "hot")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(COUNT_BLOCK)), F.ceil(F.sum("n") / F.lit(COUNT_WORDS))).cast("int").alias("blocks")
    groups = hot.groupBy("comp").agg(blocks, F.count(F.lit(1)).alias("nodes")).filter("nodes > 1").drop("nodes")
    seats = kept(hot.join(groups, "comp").select("node", "comp", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.col("doc_id").alias("d"), F.col("text_key").alias("k")), "seats")
    mark = lambda name: hot.select(F.col("node").alias(name), F.lit(True).alias(f"{name}_hot"))
    known = found.links.join(mark("a"), "a", "left").join(mark("b"), "b", "left").filter("a_hot is null or b_hot is null")
    known = known.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("n_links"))
    # Rows that repeat an id and a text are one text here.
    sought = F.broadcast(seats) if seats.count() <= BROADCAST_TEXT_KEYS else seats
    match = (F.col("k") == F.col("text_key")) & F.col("d").eqNullSafe(F.col("doc_id"))
    task = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"))))
    texts = docs.join(sought, match).select("node", "comp", "block", task.alias("t"), "text").select("node", "comp", "block", "t.i", "t.j", "text")

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        sides: dict[int, dict[int, np.ndarray]] = {i: {}, j: {}}
        for batch in rows.to_batches():
            sets = folded_shingles(batch.column("text"), width)
            for node, block, tokens in zip(batch.column("node").to_pylist(), batch.column("block").to_pylist(), sets, strict=True):
                sides[block][node] = tokens
        left, right = list(sides[i].values()), list(sides[j].values())
        sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] if left and right else np.empty((len(left), len(right)))
        linked = overlaps(left, right) * (100 + percent) >= sizes * percent
        if i == j:
            np.fill_diagonal(linked, False)
            nodes, numbers = list(sides[i]), linked.sum(axis=1)
        else:
            nodes, numbers = [*sides[i], *sides[j]], np.concatenate((linked.sum(axis=1), linked.sum(axis=0)))
        return pa.table([pa.array(nodes, pa.int64()), pa.array(numbers.astype(np.int64))], names=["node", "n_links"])

    inside = texts.groupBy("comp", "i", "j").applyInArrow(count, "node long, n_links long")
    return known.unionByName(inside).groupBy("node").agg(F.sum("n_links").alias("n_links"))


def _with_components(found: Join) -> DataFrame:
    """``(node, component_id)`` of every node."""
    classes = found.members.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    named = classes.join(found.components, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    firsts = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    return named.join(firsts, "comp").select("node", "component_id")


def near_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """``(doc_id, text_key, n_shingles, component_id)``: ``near_classes`` without its numbers of links."""
    found = ngram_join(docs, width, percent)
    named = _with_components(found)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return found.members.join(named, "node", "left").select("doc_id", "text_key", F.col("n").alias("n_shingles"), component)


def near_classes(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """``(doc_id, text_key, n_shingles, n_links, component_id)``, one row per input row.

    ``component_id`` is the smallest doc_id reachable by links, the own one included; a text without words
    keeps its own doc_id. ``n_links`` counts all links of a row's class to other classes.
    """
    found = ngram_join(docs, width, percent)
    named = _with_components(found).join(link_counts(found, docs, width, percent), "node", "left")
    return found.members.join(named, "node", "left").select(
        "doc_id",
        "text_key",
        F.col("n").alias("n_shingles"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, all columns kept: the one with the smallest id, null ids last.

    Rows without words are in no component and stay. Rows that repeat both an id and a text are copies of one another:
    one of them stays.
    """
    found = ngram_join(docs, width, percent)
    named = found.members.filter("node is not null").join(found.components, "node", "left")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    rows = named.groupBy(F.coalesce("comp", "node").alias("comp"), order.alias("o")).agg(F.count(F.lit(1)).alias("copies"))
    rows = kept(rows, "components")
    firsts = rows.groupBy("comp").agg(F.min("o").alias("first"))
    keys = rows.join(firsts, "comp").select("o.doc_id", "o.text_key", (F.col("o") == F.col("first")).alias("stays"), "copies")
    left = without(docs, keys.filter("not stays"))
    again = keys.filter("stays and copies > 1").select("doc_id", "text_key")
    if again.isEmpty():
        return left
    copies = left.join(again.select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k")), (F.xxhash64("text") == F.col("__k")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__d")), "left_semi")
    return without(left, again).unionByName(copies.dropDuplicates(["doc_id", "text"]))
