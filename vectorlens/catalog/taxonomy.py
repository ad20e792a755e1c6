"""Hierarchical roll-up over the star schema: region, nation, segment, order status, priority, line flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorlens.catalog import table
from vectorlens.operators import taxonomy

MIN_COUNT = 5


def _star(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    places = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    # Orders meet the dimensions first, so the lines, the largest table, are shuffled once at most.
    placed = orders.join(places, F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("l_orderkey").alias("uuid"),
        F.nullif("r_name", F.lit("ASIA")).alias("kingdom"),
        F.col("n_name").alias("phylum"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("class"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("order"),
        F.col("o_orderpriority").alias("family"),
        F.col("l_returnflag").alias("genus"),
        F.col("l_linestatus").alias("species"),
    )


def _frame(spark, sf):
    """Orders as a plot frame, labelled by the number of their priority."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("uuid"), F.substring("o_orderpriority", 1, 1).alias("KMeans (k=5)")
    )


def _flat(nodes):
    return nodes.withColumn("path", F.array_join("path", " > "))


def tax_leaf_counts(spark, sf):
    return taxonomy.leaf_counts(_star(spark, sf))


def tax_rollup(spark, sf):
    return _flat(taxonomy.subtree_totals(_star(spark, sf)))


def tax_stats(spark, sf):
    return taxonomy.statistics(_star(spark, sf))


def tax_pruned(spark, sf):
    return _flat(taxonomy.pruned(_star(spark, sf), min_count=MIN_COUNT))


def tax_pruned_shallow(spark, sf):
    return _flat(taxonomy.pruned(_star(spark, sf), max_depth=3, min_count=20 * MIN_COUNT))


def tax_sibling_order(spark, sf):
    nodes = taxonomy.sibling_order(taxonomy.pruned(_star(spark, sf), min_count=MIN_COUNT))
    return _flat(nodes).select("path", "name", "rank", "is_last")


def tax_for_cluster(spark, sf):
    kept = taxonomy.restrict_to_cluster(_star(spark, sf), _frame(spark, sf), "KMeans (k=5)", "2")
    return _flat(taxonomy.pruned(kept, min_count=MIN_COUNT))


def tax_cluster_choices(spark, sf):
    return taxonomy.cluster_choices(_frame(spark, sf), "KMeans (k=5)")


def tax_tree_lines(spark, sf):
    return taxonomy.tree_lines(_star(spark, sf), min_count=MIN_COUNT)


def _leaves(condition: str = "TRUE") -> str:
    return f"""
    star AS (
      SELECT nullif(r_name, 'ASIA') AS l1, n_name AS l2, nullif(c_mktsegment, 'BUILDING') AS l3,
             CASE o_orderstatus WHEN 'P' THEN '' ELSE o_orderstatus END AS l4, o_orderpriority AS l5,
             l_returnflag AS l6, l_linestatus AS l7
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE {condition}
    ),
    leaves AS (
      SELECT l1, coalesce(nullif(l2, ''), 'Unknown') AS l2, coalesce(nullif(l3, ''), 'Unknown') AS l3,
             coalesce(nullif(l4, ''), 'Unknown') AS l4, coalesce(nullif(l5, ''), 'Unknown') AS l5,
             coalesce(nullif(l6, ''), 'Unknown') AS l6, coalesce(nullif(l7, ''), 'Unknown') AS l7, count(*) AS n
      FROM star WHERE l1 IS NOT NULL GROUP BY ALL
    )
    """


def _nodes(condition: str = "TRUE") -> str:
    return f"""
    {_leaves(condition)},
    rolled AS (SELECT l1, l2, l3, l4, l5, l6, l7, CAST(sum(n) AS BIGINT) AS n FROM leaves GROUP BY ROLLUP (l1, l2, l3, l4, l5, l6, l7)),
    listed AS (SELECT list_filter([l1, l2, l3, l4, l5, l6, l7], lambda x: x IS NOT NULL) AS p, n FROM rolled),
    nodes AS (
      SELECT CAST(len(p) AS INTEGER) AS depth, array_to_string(p, ' > ') AS path,
             array_to_string(p[1:len(p) - 1], ' > ') AS parent, p[len(p)] AS name, p, n FROM listed
    )
    """


def _pruned(min_count: int, max_depth: int = 7, condition: str = "TRUE") -> str:
    return f"""
    {_nodes(condition)},
    best AS (SELECT depth - 1 AS depth, parent AS path, max(n) AS best FROM nodes GROUP BY ALL),
    pruned AS (
      SELECT nodes.* FROM nodes LEFT JOIN best USING (depth, path)
      WHERE depth BETWEEN 1 AND {max_depth} AND CASE WHEN depth = 7 THEN n ELSE best END >= {min_count}
    )
    """


QUERIES = {
    "tax_leaf_counts": (
        tax_leaf_counts,
        f"""
        WITH {_leaves()}
        SELECT l1 AS kingdom, l2 AS phylum, l3 AS "class", l4 AS "order", l5 AS family, l6 AS genus, l7 AS species, n
        FROM leaves
        """,
    ),
    "tax_rollup": (tax_rollup, f"WITH {_nodes()} SELECT depth, path, n FROM nodes"),
    "tax_stats": (
        tax_stats,
        f"""
        WITH {_nodes()}
        SELECT ['total_records', 'kingdom', 'phylum', 'class', 'order', 'family', 'genus', 'species'][depth + 1] AS name,
               CAST(CASE depth WHEN 0 THEN sum(n) ELSE count(*) END AS BIGINT) AS value
        FROM nodes GROUP BY depth
        """,
    ),
    "tax_pruned": (tax_pruned, f"WITH {_pruned(MIN_COUNT)} SELECT depth, path, n FROM pruned"),
    "tax_pruned_shallow": (
        tax_pruned_shallow,
        f"WITH {_pruned(20 * MIN_COUNT, 3)} SELECT depth, path, n FROM pruned",
    ),
    "tax_sibling_order": (
        tax_sibling_order,
        f"""
        WITH {_pruned(MIN_COUNT)},
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY depth, parent ORDER BY CASE WHEN depth = 7 THEN -n ELSE 0 END, name) AS rank,
                 count(*) OVER (PARTITION BY depth, parent) AS siblings FROM pruned
        )
        SELECT path, name, CAST(rank AS INTEGER) AS rank, rank = siblings AS is_last FROM ranked
        """,
    ),
    "tax_for_cluster": (
        tax_for_cluster,
        f"""
        WITH {_pruned(MIN_COUNT, condition="substr(o_orderpriority, 1, 1) = '2'")} SELECT depth, path, n FROM pruned
        """,
    ),
    "tax_cluster_choices": (
        tax_cluster_choices,
        """
        SELECT CAST(0 AS BIGINT) AS rank, 'All' AS choice
        UNION ALL SELECT row_number() OVER (ORDER BY CAST(c AS BIGINT)), c
        FROM (SELECT DISTINCT substr(o_orderpriority, 1, 1) AS c FROM orders)
        """,
    ),
    "tax_tree_lines": (
        tax_tree_lines,
        f"""
        WITH {_pruned(MIN_COUNT)},
        ranked AS (
          SELECT *, CASE WHEN depth = 7 THEN -n ELSE 0 END AS weight,
                 row_number() OVER (PARTITION BY depth, parent ORDER BY CASE WHEN depth = 7 THEN -n ELSE 0 END DESC, name DESC) = 1 AS last
          FROM pruned
        ),
        places AS (
          SELECT path, level, array_to_string(p[1:level], ' > ') AS place
          FROM (SELECT path, p, unnest(generate_series(1, depth)) AS level FROM ranked)
        ),
        bars AS (
          SELECT places.path, string_agg(CASE WHEN level = 1 OR level = own.depth THEN ''
                   WHEN up.last THEN '    ' ELSE '│   ' END, '' ORDER BY level) AS bar
          FROM places JOIN ranked up ON up.path = places.place JOIN ranked own ON own.path = places.path GROUP BY places.path
        )
        SELECT row_number() OVER (ORDER BY p[1], p[2] NULLS FIRST, p[3] NULLS FIRST, p[4] NULLS FIRST, p[5] NULLS FIRST,
                 p[6] NULLS FIRST, CASE WHEN depth = 7 THEN weight END NULLS FIRST, p[7] NULLS FIRST) - 1 AS line_no,
               bar || CASE WHEN depth = 1 THEN '' WHEN last THEN '└── ' ELSE '├── ' END
               || name || ' (' || CAST(n AS VARCHAR) || ')' AS line
        FROM ranked JOIN bars USING (path)
        """,
    ),
}
