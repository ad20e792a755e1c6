"""Hierarchical roll-up of taxonomy columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorlens.functions.predicates import quoted
from vectorlens.operators.ordering import with_group_rank, with_row_index
from vectorlens.session import cut_lineage

# The seven levels, and the name of a missing one.
LEVELS = ["kingdom", "phylum", "class", "order", "family", "genus", "species"]
UNKNOWN = "Unknown"
# Lookups of the upper levels, whose few names lie on the paths of many nodes, are spread over this many keys.
SALTED_LEVELS, SALTS = 3, 16


def leaf_counts(df: DataFrame, levels: list[str] = LEVELS) -> DataFrame:
    """Records per full path. A null top level drops the row; null, empty or absent levels read Unknown."""
    if levels[0] not in df.columns:
        raise ValueError(f"missing top level column {levels[0]!r}")

    def name(level: str) -> Column:
        if level not in df.columns:
            return F.lit(UNKNOWN).alias(level)
        text = quoted(level).cast("string")
        return F.coalesce(F.nullif(text, F.lit("")), F.lit(UNKNOWN)).alias(level)

    kept = df.filter(quoted(levels[0]).isNotNull())
    return kept.groupBy(*[name(level) for level in levels]).agg(F.count(F.lit(1)).alias("n"))


def subtree_totals(df: DataFrame, levels: list[str] = LEVELS) -> DataFrame:
    """``(depth, path, n)`` of every node; depth 0 is the whole table.

    The roll-up runs over leaf counts, not records, so its expansion multiplies the small side.
    """
    leaves = leaf_counts(df, levels)
    rolled = leaves.rollup(*[quoted(level) for level in levels]).agg(
        F.sum("n").alias("n"), F.bit_count(F.grouping_id()).alias("rolled")
    )
    depth = F.lit(len(levels)) - F.col("rolled")
    return rolled.select(
        depth.cast("int").alias("depth"),
        F.slice(F.array(*[quoted(level) for level in levels]), F.lit(1), depth.cast("int")).alias("path"),
        "n",
    )


def statistics(df: DataFrame, levels: list[str] = LEVELS) -> DataFrame:
    """``(name, value)``: total records, and the number of distinct paths down to each level."""
    totals = subtree_totals(df, levels).groupBy("depth").agg(
        F.count(F.lit(1)).alias("paths"), F.sum("n").alias("records")
    )
    names = F.array(F.lit("total_records"), *[F.lit(level) for level in levels])
    value = F.when(F.col("depth") == 0, F.col("records")).otherwise(F.col("paths"))
    return totals.select(F.element_at(names, F.col("depth") + 1).alias("name"), value.alias("value"))


def pruned(
    df: DataFrame, levels: list[str] = LEVELS, max_depth: int | None = None, min_count: int = 1
) -> DataFrame:
    """``(depth, path, n)`` of the nodes shown.

    An inner node stays when at least one child has ``min_count`` records, a leaf when it has them itself;
    counts shown are full totals. Every node meets its children in one grouping, without a join.
    """
    deepest = len(levels)
    shown = deepest if max_depth is None else max_depth
    nodes = subtree_totals(df, levels).filter(F.col("depth") > 0)
    as_self = F.struct("depth", "path", F.col("n").alias("own"), F.lit(None).cast("long").alias("child"))
    as_child = F.struct(
        (F.col("depth") - 1).alias("depth"),
        F.slice("path", F.lit(1), F.col("depth") - 1).alias("path"),
        F.lit(None).cast("long").alias("own"),
        F.col("n").alias("child"),
    )
    roles = nodes.select(F.explode(F.array(as_self, as_child)).alias("r")).select("r.*").filter(F.col("depth") > 0)
    merged = roles.groupBy("depth", "path").agg(F.max("own").alias("n"), F.max("child").alias("child"))
    tested = F.when(F.col("depth") == deepest, F.col("n")).otherwise(F.col("child"))
    return merged.filter((tested >= min_count) & (F.col("depth") <= shown)).select("depth", "path", "n")


def _own_order(levels: list[str]) -> Column:
    """Sort key among siblings: by name, the lowest level by descending count and then name."""
    by_count = F.when(F.col("depth") == len(levels), -F.col("n")).otherwise(F.lit(0).cast("long"))
    return F.struct(by_count.alias("by_count"), F.element_at("path", -1).alias("name"))


def sibling_order(nodes: DataFrame, levels: list[str] = LEVELS) -> DataFrame:
    """Add ``name, rank, is_last``: the place of each node among the children of its parent."""
    keyed = nodes.withColumn("parent", F.array_join(F.slice("path", F.lit(1), F.col("depth") - 1), "\u0000")).withColumn(
        "own", _own_order(levels)
    )
    ranked = with_group_rank(keyed, "parent", [F.col("own")])
    return ranked.select(
        *nodes.columns,
        F.col("own.name").alias("name"),
        F.col("rank").cast("int").alias("rank"),
        (F.col("rank") == F.col("size")).alias("is_last"),
    )


def _salts(level: Column) -> Column:
    return F.when(level <= SALTED_LEVELS, F.lit(SALTS)).otherwise(F.lit(1))


def tree_lines(
    df: DataFrame, levels: list[str] = LEVELS, max_depth: int | None = None, min_count: int = 5
) -> DataFrame:
    """``(line_no, line)``: the pruned tree as text.

    The last child of every parent is found by one grouping. Each node then looks up itself and its ancestors
    among these (at most one entry per level below the top), which gives its prefix. Top-level names carry no
    connector. Many nodes look up the same upper levels, so these entries are salted.
    """
    nodes = cut_lineage(pruned(df, levels, max_depth, min_count))
    depth = F.col("depth")
    parent = F.slice("path", F.lit(1), depth - 1)
    lasts = (
        nodes.groupBy(parent.alias("parent"))
        .agg(F.max_by("path", _own_order(levels)).alias("place"))
        .select("place", F.explode(F.sequence(F.lit(0), _salts(F.size("place")) - 1)).alias("salt"), F.lit(True).alias("is_last"))
    )
    label = F.concat(F.element_at("path", -1), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    looked_up = F.when(depth > 1, F.sequence(F.lit(2), F.greatest(depth, F.lit(2))))
    places = nodes.select("path", "depth", "n", label.alias("label"), F.explode_outer(looked_up).alias("level")).withColumns(
        {
            "place": F.slice("path", F.lit(1), F.col("level")),
            "salt": F.pmod(F.xxhash64("path"), _salts(F.col("level"))).cast("int"),
        }
    )
    entry = F.struct("level", F.coalesce("is_last", F.lit(False)).alias("is_last"))
    lines = (
        places.join(lasts, ["place", "salt"], "left")
        .groupBy("path", "depth", "n", "label")
        .agg(F.array_sort(F.collect_list(entry)).alias("chain"))
    )
    above = F.slice("chain", F.lit(1), F.greatest(depth - 2, F.lit(0)))
    bars = F.array_join(F.transform(above, lambda e: F.when(e["is_last"], "    ").otherwise("│   ")), "")
    connector = F.when(depth == 1, "").when(F.element_at("chain", -1)["is_last"], "└── ").otherwise("├── ")
    ancestors = F.transform(
        F.slice("path", F.lit(1), depth - 1),
        lambda name: F.struct(F.lit(0).cast("long").alias("by_count"), name.alias("name")),
    )
    shown = lines.select(
        F.concat(ancestors, F.array(_own_order(levels))).alias("key"),
        F.concat(bars, connector, F.col("label")).alias("line"),
    )
    return with_row_index(shown, [F.col("key")], "line_no").select("line_no", "line")


def restrict_to_cluster(
    df: DataFrame, frame: DataFrame, label_col: str, cluster: str | None, id_col: str = "uuid"
) -> DataFrame:
    """Records whose id belongs to one cluster of a plot frame; ``None`` or ``All`` keeps every record."""
    if cluster is None or cluster == "All":
        return df
    chosen = frame.filter(quoted(label_col).cast("string") == cluster).select(quoted(id_col))
    return df.join(chosen, id_col, "left_semi")


def cluster_choices(frame: DataFrame, label_col: str) -> DataFrame:
    """``(rank, choice)``: ``All`` and then the cluster labels in numeric order."""
    labels = frame.select(quoted(label_col).cast("string").alias("choice")).distinct()
    ranked = with_row_index(labels, [F.col("choice").cast("long")], "rank")
    first = frame.sparkSession.createDataFrame([(0, "All")], "rank long, choice string")
    return first.unionByName(ranked.select((F.col("rank") + 1).alias("rank"), "choice"))
