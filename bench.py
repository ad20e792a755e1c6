"""Time the registered headline queries on one table folder and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vectorlens.catalog import all_queries  # noqa: E402
from vectorlens.session import local_session  # noqa: E402

HEADLINE = [
    "load_stats",
    "batch_load_filtered",
    "filter_combined",
    "cascade_all",
    "profile_documents",
    "profile_orders",
    "value_counts",
    "record_detail",
    "density_grid",
    "row_index",
    "prep_normalize",
    "prep_report",
    "assign_nearest",
    "lloyd_two_steps",
    "kmeans_labels",
    "pca_2d",
    "covariance",
    "cluster_workflow",
    "batch_job",
    "cluster_summary",
    "representatives",
    "agreement",
    "agreement_documents",
    "purity_entropy",
    "composition",
    "tax_rollup",
    "tax_pruned",
    "tax_sibling_order",
    "tax_tree_lines",
    "knn_graph",
    "fuzzy_weights",
    "perplexity_affinity",
    "knn_graph_blocks",
    "neighbor_layout_umap",
    "neighbor_layout_tsne",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, app="vectorlens-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    wanted = os.environ.get("BENCH_QUERIES")
    names = list(queries) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    # Warm the JVM and the Python workers once, outside the timings.
    queries["load_stats"][0](spark, folder).collect()
    queries["prep_report"][0](spark, folder).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
