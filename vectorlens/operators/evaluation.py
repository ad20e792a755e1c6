"""Agreement of cluster labels with a metadata column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorlens.functions.predicates import quoted
from vectorlens.functions.scalars import MISSING, category, fixed, nan_to_null
from vectorlens.operators.ordering import with_group_rank, with_row_index
from vectorlens.session import cut_lineage

# Fixed value: double rounding unit, below which mutual information counts as zero.
EPSILON = 2.220446049250313e-16


def _category(df: DataFrame, category_col: str) -> Column:
    return category(nan_to_null(quoted(category_col), df.schema[category_col].dataType))


def contingency(df: DataFrame, label_col: str, category_col: str) -> DataFrame:
    """``(cluster, category, n)``; missing metadata, NaN included, is the category ``N/A``."""
    return df.groupBy(
        quoted(label_col).cast("string").alias("cluster"), _category(df, category_col).alias("category")
    ).agg(F.count(F.lit(1)).alias("n"))


def row_counts(df: DataFrame, category_col: str) -> DataFrame:
    """Rows that take part in the agreement metrics and rows left out as ``N/A``."""
    known = _category(df, category_col) != MISSING
    return df.agg(F.count_if(known).alias("evaluated"), F.count_if(~known).alias("excluded"))


def _margins(df: DataFrame, label_col: str, category_col: str) -> DataFrame:
    """One row of sums over the contingency table, its margins and its totals, from a single scan.

    Grouping sets over the small table give cell, row, column and grand counts at once, without a join.
    """
    cells = contingency(df, label_col, category_col).withColumn("known", F.col("category") != MISSING)
    grouped = cells.groupingSets(
        [["known", "cluster", "category"], ["known", "cluster"], ["known", "category"], ["known"]],
        "known", "cluster", "category",
    ).agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    names = {0: "cell", 1: "row", 2: "col"}
    square = F.col("n").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
    sums: list[Column] = []
    for level, name in names.items():
        at = F.col("known") & (F.col("level") == level)
        sums += [
            F.sum(F.when(at, square)).cast("double").alias(f"{name}_sq"),
            F.sum(F.when(at, F.col("n") * F.log(F.col("n").cast("double")))).alias(f"{name}_log"),
            F.count_if(at).alias(f"{name}_groups"),
        ]
    total = F.col("level") == 3
    return grouped.agg(
        F.coalesce(F.sum(F.when(total & F.col("known"), F.col("n"))), F.lit(0)).alias("evaluated"),
        F.coalesce(F.sum(F.when(total & ~F.col("known"), F.col("n"))), F.lit(0)).alias("excluded"),
        *sums,
    )


def agreement(df: DataFrame, label_col: str, category_col: str) -> DataFrame:
    """``evaluated, excluded, ari, nmi``; both metrics are null when no row has a known category.

    ARI is the pair-count form; NMI normalizes by the mean of both entropies.
    """
    n = F.col("evaluated").cast("double")
    tp = F.col("cell_sq") - n
    fp = F.col("col_sq") - F.col("cell_sq")
    fn = F.col("row_sq") - F.col("cell_sq")
    tn = n * n - fp - fn - F.col("cell_sq")
    chance = (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)
    ari = F.when((fp == 0) & (fn == 0), F.lit(1.0)).otherwise(F.try_divide(2.0 * (tp * tn - fn * fp), chance))

    h_row = F.log(n) - F.col("row_log") / n
    h_col = F.log(n) - F.col("col_log") / n
    h_cell = F.log(n) - F.col("cell_log") / n
    shared = h_row + h_col - h_cell
    # The three entropies are sums of rounded terms, so independence shows as a few units of rounding.
    noise = 8 * EPSILON * (1.0 + h_cell)
    trivial = (F.col("row_groups") <= 1) & (F.col("col_groups") <= 1)
    nmi = (
        F.when(trivial, F.lit(1.0))
        .when(shared <= noise, F.lit(0.0))
        .otherwise(F.try_divide(shared, (h_row + h_col) / 2.0))
    )
    known = F.col("evaluated") > 0
    return _margins(df, label_col, category_col).select(
        "evaluated", "excluded", F.when(known, ari).alias("ari"), F.when(known, nmi).alias("nmi")
    )


def _purity_entropy(cells: DataFrame) -> DataFrame:
    n = F.sum("n")
    weighted = F.sum(F.col("n") * F.log2(F.col("n").cast("double")))
    entropy = F.greatest(F.log2(n.cast("double")) - weighted / n, F.lit(0.0))
    return cells.groupBy("cluster").agg(
        n.alias("n"), (F.max("n") / n).alias("purity"), F.when(n > 0, entropy).otherwise(0.0).alias("entropy")
    )


def purity_entropy(df: DataFrame, label_col: str, category_col: str) -> DataFrame:
    """``(cluster, n, purity, entropy)``; ``N/A`` rows count here, unlike in the agreement metrics.

    Entropy is in bits, from sums of ``n log n`` so that one aggregation of the contingency table is enough.
    """
    return _purity_entropy(contingency(df, label_col, category_col))


# Place of the rows without a cluster in a rendered tree.
NO_CLUSTER = (1 << 63) - 1


def _composition(cells: DataFrame) -> DataFrame:
    order = [F.desc("n"), F.col("category")]
    ranked = with_group_rank(cells, "cluster", order, [F.sum("n").alias("total")])
    return ranked.select(
        "cluster",
        "category",
        "n",
        (F.col("n") / F.col("total") * 100.0).alias("pct"),
        F.col("rank").cast("int").alias("rank"),
        (F.col("rank") == F.col("size")).alias("is_last"),
    )


def composition(df: DataFrame, label_col: str, category_col: str) -> DataFrame:
    """``(cluster, category, n, pct, rank, is_last)``: categories by descending count, ties by name."""
    return _composition(contingency(df, label_col, category_col))


def composition_tree(df: DataFrame, label_col: str, category_col: str) -> DataFrame:
    """``(line_no, line)``: the composition rendered as a tree, one block per cluster in numeric order."""
    cells = cut_lineage(contingency(df, label_col, category_col))
    rows = _composition(cells)
    stats = _purity_entropy(cells).withColumn("number", F.col("cluster").cast("long"))
    facts = stats.agg(
        F.sum("n").alias("points"), F.count(F.lit(1)).alias("clusters"), F.max("number").alias("last")
    ).first()
    if not facts["clusters"]:
        return df.sparkSession.createDataFrame([], "line_no long, line string")
    # Rows without a cluster form the last block.
    unnamed = facts["clusters"] > stats.filter("number is not null").count()
    block = F.coalesce("number", F.lit(NO_CLUSTER))
    last_cluster = block == F.lit(NO_CLUSTER if unnamed else facts["last"])
    headline = F.format_string(
        "Cluster %s  [%d pts]  purity: %s%%  entropy: %s",
        F.coalesce(F.col("cluster").cast("string"), F.lit("none")), "n", fixed(F.col("purity") * 100, 0), fixed(F.col("entropy"), 2),
    )
    blocks = stats.select(
        block.alias("block"),
        F.lit(0).alias("row"),
        F.concat(F.when(last_cluster, "└── ").otherwise("├── "), headline).alias("line"),
    )
    details = rows.withColumn("number", F.col("cluster").cast("long")).select(
        block.alias("block"),
        F.col("rank").alias("row"),
        F.concat(
            F.when(last_cluster, "    ").otherwise("│   "),
            F.when(F.col("is_last"), "└─ ").otherwise("├─ "),
            F.format_string("%-20s %4d  %5s%%", F.col("category"), F.col("n"), fixed(F.col("pct"), 1)),
        ).alias("line"),
    )
    title = [
        (-3, 0, f"KMeans Clustering Summary ({facts['points']} points, {facts['clusters']} clusters)"),
        (-2, 0, f"Compared against: {category_col}"),
        (-1, 0, ""),
    ]
    head = df.sparkSession.createDataFrame(title, "block long, row int, line string")
    ordered = with_row_index(head.unionByName(blocks).unionByName(details), [F.col("block"), F.col("row")], "line_no")
    return ordered.select("line_no", "line")
