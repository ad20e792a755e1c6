"""Merkle manifest of a document table: a postorder log of hash nodes, and proofs read from it by position.

Every document is a leaf. The leaves of one language form a tree, in the order of ``doc_id``; the roots of these trees,
in the order of the language, form another one. In a tree every two consecutive nodes of a level become one node of
the next; a last node without a partner becomes a node alone.

A tree is written as an append log in completion order: a node stands right after the second of its children. The
position of a node follows from its level, its index and the number of leaves, so nothing has to be searched for.
With ``m`` leaves appended there are ``2m - popcount(m)`` whole nodes; the whole node that ends with leaf ``m`` at level
``h`` is number ``2(m - 1) - popcount(m - 1) + h``; the nodes cut short by the end of the table, at most one per level,
come last, level by level.

Aligned builders write the log: each takes the ``2**span`` items of a level that make up one node ``span`` levels higher,
and writes the nodes between as one segment. What the builders of one layer end with are the items of the next. Proofs
are taken the other way round: each builder reads the siblings of its items from its own segment, and hands them down
with those it was handed itself. So no node is asked for by many, and no task holds more than one segment at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorlens.llm.tables import bucket_count, kept

# Levels that one builder spans unless told otherwise; it takes 2**span items.
SPAN = 8
# Columns of a document that enter its leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_ITEM = "array<struct<rank long, doc_id long, leaf string, changed string>>"


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return max(n - 1, 0).bit_length()


def position(level: int, index: int, n: int) -> int:
    """Place in the log of node ``index`` of a level in a tree of ``n`` leaves."""
    last = (index + 1) << level
    if last <= n:
        return 2 * (last - 1) - (last - 1).bit_count() + level
    return 2 * n - n.bit_count() + sum(1 for h in range(1, level) if n % (1 << h))


def nodes_at(level: int, n: int) -> int:
    return -(-n >> level) if n else 0


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def segment(items: list[str], first: int, base: int, n: int, span: int) -> list[tuple[int, str]]:
    """``(position, digest)`` of the nodes above consecutive items of level ``base``, in log order.

    ``first`` is the index of the first item, a multiple of ``2**span``. The items themselves are included at level 0 only;
    at higher levels they stand in the log already, as the last nodes of their builders.
    """
    found = [(position(base, first + i, n), d) for i, d in enumerate(items)] if base == 0 else []
    row, start = items, first
    for level in range(base + 1, min(base + span, height(n)) + 1):
        row = [digest(*row[i : i + 2]) for i in range(0, len(row), 2)]
        start >>= 1
        found += [(position(level, start + i, n), d) for i, d in enumerate(row)]
    return sorted(found)


def siblings(index: int, base: int, n: int, span: int, at: Callable[[int], str]) -> list[str]:
    """Steps from item ``index`` of level ``base`` to the top of its builder: side of the sibling and its digest.

    ``at`` gives the digest at a position of the log. A step without a sibling is empty.
    """
    steps = []
    for level in range(base, min(base + span, height(n))):
        other = index ^ 1
        if other >= nodes_at(level, n):
            steps.append("")
        else:
            steps.append(("L" if other < index else "R") + at(position(level, other, n)))
        index >>= 1
    return steps


def fold(leaf: str, steps: list[str]) -> str:
    """The root that a leaf and the steps of its proof lead to."""
    for step in steps:
        leaf = digest(step[1:], leaf) if step[:1] == "L" else digest(leaf, step[1:])
    return leaf


def field(value: Column) -> Column:
    """Decimal or text with its UTF-8 length before it; null is a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**instead: Column) -> Column:
    """Hash of the fields of a document, some of them replaced."""
    return F.sha2(F.concat(*[field(instead.get(name, F.col(name))) for name in FIELDS]), 256)


def numbered_items(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """Add ``rank`` from 0 inside each tree and ``n``, the rows of the tree.

    One sort split by ranges is written with running numbers. The first number and the rows of each tree in each range
    are counted, so that a tree of any size is spread over tasks and only these counts meet in a window.
    """
    parts = bucket_count(rows.count())
    dealt = rows.repartitionByRange(parts, tree, *order).sortWithinPartitions(tree, *order)
    written = kept(dealt.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    counts = written.groupBy(F.col(tree).alias("in_tree"), part.alias("part")).agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("rows")
    )
    before = Window.partitionBy("in_tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("in_tree")
    counts = counts.select(
        "in_tree", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n")
    )
    joined = written.withColumn("p", part).join(counts, (F.col(tree) == F.col("in_tree")) & (F.col("p") == F.col("part")))
    return joined.select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("rank"), "n")


def _builders(base: int, span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``(tree, builder, n, items)`` get the segment that the builder writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, logs, tops = [], [], []
            for builder, n, items in zip(*(batch.column(c).to_pylist() for c in ("builder", "n", "items")), strict=True):
                found = segment([i["leaf"] for i in items], builder << span, base, n, span)
                starts.append(found[0][0] if found else 0)
                logs.append(bytes.fromhex("".join(d for _, d in found)))
                tops.append(found[-1][1] if found else items[0]["leaf"])
            columns = [*batch.columns, pa.array(starts, pa.int64()), pa.array(logs, pa.binary()), pa.array(tops, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "start", "log", "top"])

    return run


def _layer(items: DataFrame, base: int, span: int, name: str) -> DataFrame:
    """``(tree, builder, n, items, start, log, top)``: one row per builder, at most ``2**span`` items each."""
    entry = F.struct("rank", "doc_id", "leaf", "changed")
    grouped = items.groupBy("tree", F.shiftright("rank", span).alias("builder"), "n").agg(F.array_sort(F.collect_list(entry)).alias("items"))
    schema = f"tree string, builder long, n long, items {_ITEM}, start long, log binary, top string"
    return kept(grouped.mapInArrow(_builders(base, span), schema), name)


@dataclass(frozen=True)
class Log:
    """The written segments of all trees, lowest layer first, and the root of every tree."""

    layers: list[DataFrame]
    roots: DataFrame
    span: int

    def segments(self) -> DataFrame:
        """``(tree, layer, start, log)``: the log, 32 bytes for each node, in runs of consecutive positions.

        Runs of the lowest layer are whole; a higher builder's nodes stand between the runs of its items, each at the
        position that :func:`position` gives.
        """
        found = [table.select("tree", F.lit(i).alias("layer"), "start", "log") for i, table in enumerate(self.layers)]
        out = found[0]
        for other in found[1:]:
            out = out.unionByName(other)
        return out


def write_log(items: DataFrame, name: str, span: int = SPAN) -> Log:
    """Build all trees of ``(tree, rank, n, doc_id, leaf, changed)`` layer by layer."""
    layers, roots, base = [], [], 0
    while True:
        layer = _layer(items, base, span, f"{name}-{base}")
        layers.append(layer)
        done = F.pow(F.lit(2.0), F.lit(float(base + span))) >= F.col("n")
        roots.append(layer.filter(done).select("tree", "n", F.col("top").alias("root"), F.lit(len(layers) - 1).alias("layer")))
        above = layer.filter(~done)
        if above.isEmpty():
            break
        none = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("changed")]
        items = above.select("tree", "n", F.col("builder").alias("rank"), F.col("top").alias("leaf"), *none)
        base += span
    found = roots[0]
    for other in roots[1:]:
        found = found.unionByName(other)
    return Log(layers, found, span)


def _reader(row: dict, base: int, span: int) -> Callable[[int], str]:
    """Digest by position, from one segment and the items below it."""
    log, start, n, items = row["log"], row["start"], row["n"], row["items"]
    if base == 0:
        return lambda at: log[32 * (at - start) : 32 * (at - start) + 32].hex()
    first = row["builder"] << span
    known = {position(base, first + i, n): item["leaf"] for i, item in enumerate(items)}
    inside = sorted(
        position(base + up, index, n)
        for up in range(1, min(span, height(n) - base) + 1)
        for index in range(first >> up, -(-(first + len(items)) >> up))
    )
    known |= {p: log[32 * k : 32 * k + 32].hex() for k, p in enumerate(inside)}
    return known.__getitem__


def _steps(base: int, span: int, emit: Callable[[dict, dict, list[str]], tuple], names: list[str], schema: pa.Schema):
    """Rows of a layer with their own path (``path``): one output row per item, with the steps of the item before that path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                at = _reader(row, base, span)
                out = [emit(row, item, siblings(item["rank"], base, row["n"], span, at) + row["path"]) for item in row["items"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], names)

    return run


def _handed_down(row: dict, item: dict, steps: list[str]) -> tuple:
    return row["tree"], item["rank"], row["root"], row["whole"], steps


_PATHS = "tree string, builder long, root string, whole string, path array<string>"
_PATHS_ARROW = pa.schema(
    [("tree", pa.string()), ("builder", pa.int64()), ("root", pa.string()), ("whole", pa.string()), ("path", pa.list_(pa.string()))]
)


def with_paths(log: Log, tops: DataFrame, name: str) -> DataFrame:
    """The lowest layer with ``(root, whole, path)``: what a builder has been handed down from above.

    ``tops`` holds ``(tree, root, whole, path)`` for every tree: its root, the root over all trees, and the steps between.
    """
    homes = log.roots.select("tree", "layer")
    starts = tops.join(homes, "tree").select("tree", F.lit(0).cast("long").alias("builder"), "root", "whole", "path", "layer")
    paths = None
    for at in range(len(log.layers) - 1, -1, -1):
        here = starts.filter(F.col("layer") == at).drop("layer")
        paths = here if paths is None else here.unionByName(paths)
        met = log.layers[at].join(paths, ["tree", "builder"])
        if at == 0:
            return met
        run = _steps(at * log.span, log.span, _handed_down, list(_PATHS_ARROW.names), _PATHS_ARROW)
        paths = kept(met.mapInArrow(run, _PATHS), f"{name}-paths")
    raise ValueError("a log has at least one layer")


@dataclass(frozen=True)
class Manifest:
    """Logs of the language trees and of the tree over their roots."""

    documents: Log
    languages: Log

    @property
    def root(self) -> DataFrame:
        """One row with the root over all documents; no row for an empty table."""
        return self.languages.roots.select("root")

    def proofs(self, siblings_too: bool = False) -> DataFrame:
        """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

        ``folded_root`` is recomputed from the changed leaf where there is one, otherwise from the leaf, and the
        siblings in the log. ``siblings_too`` adds the steps of the proof, each ``L`` or ``R`` and a digest, or empty.
        """
        whole = self.languages.roots.select(F.col("tree").alias("all"), F.col("root").alias("whole"))
        first = whole.select(F.col("all").alias("tree"), F.col("whole").alias("root"), "whole", F.array().cast("array<string>").alias("path"))

        def named(row: dict, item: dict, steps: list[str]) -> tuple:
            return item["changed"], 0, item["leaf"], row["whole"], steps

        run = _steps(0, self.languages.span, named, list(_PATHS_ARROW.names), _PATHS_ARROW)
        # The items of the second tree carry the name of their language tree in place of a changed leaf.
        tops = kept(with_paths(self.languages, first, "merkle-languages").mapInArrow(run, _PATHS).drop("builder"), "merkle-tops")
        met = with_paths(self.documents, tops, "merkle")

        def emit(row: dict, item: dict, steps: list[str]) -> tuple:
            folded = fold(item["changed"] or item["leaf"], steps)
            proof = digest(*[s[1:] for s in steps])
            found = (item["doc_id"], item["leaf"], row["root"], row["whole"], proof, folded, folded == row["whole"])
            return (*found, steps) if siblings_too else found

        fields = [("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())]
        schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        if siblings_too:
            fields.append(("proof", pa.list_(pa.string())))
            schema += ", proof array<string>"
        arrow = pa.schema(fields)
        return met.mapInArrow(_steps(0, self.documents.span, emit, list(arrow.names), arrow), schema)


def build_manifest(docs: DataFrame, changed: dict[str, Column] | None = None, where: Column | None = None, span: int = SPAN) -> Manifest:
    """Write the log of all documents. ``changed`` and ``where`` state fields of documents as a reader finds them later.

    Leaves of a language stand by ascending doc_id, a null id before all others; rows that repeat an id by ascending
    hash. A null language is a language of its own and comes first, the others follow bytewise. Null fields enter the
    leaf as a dash. Only the five fields are read, whatever other columns are called. An empty table has no tree.
    """
    rows = docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf().alias("leaf"),
        (F.when(where, leaf(**changed)) if changed else F.lit(None).cast("string")).alias("changed"),
    )
    documents = write_log(numbered_items(rows, "tree", ["doc_id", "leaf", "changed"], "merkle-leaves"), "merkle", span)
    tops = documents.roots.select(
        F.lit("").alias("tree"), F.lit(None).cast("long").alias("doc_id"), F.col("root").alias("leaf"), F.col("tree").alias("changed")
    )
    return Manifest(documents, write_log(numbered_items(tops, "tree", ["changed"], "merkle-tops"), "merkle-top", span))


def tamper_report(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Proofs of all documents, where those whose checksum of the id is divisible by 7 are read with one character more."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return build_manifest(docs, {"n_chars": more}, chosen, span).proofs()
