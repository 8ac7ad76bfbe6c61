"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and BENCH_QUERIES
(comma-separated names, default all headline queries) choose what is run.
"""

from __future__ import annotations

import json
import os
import time

from flowloom.operators import hcg
from flowloom.plans import views
from flowloom.plans.catalog import QUERIES
from flowloom.session import local_session

HEADLINE = [
    "hcg_edges",
    "hcg_edges_orders",
    "est_total",
    "tcg_edges",
    "tcg_shrcr_capped",
    "view_top_succ",
    "degree_summary",
    "walks_first_order",
    "walks_node2vec",
    "walks_uniform",
    "features_a",
    "features_c",
    "features_f",
    "te_oof",
    "features_d_te",
    "sample_split",
    "nearest",
    "knn",
    "metrics",
    "check_graph",
]


def hcg_edges_orders(spark, sf_dir):
    """Endpoint graph over lineitem, the largest table."""
    return hcg.edges(views.order_flows(spark, sf_dir))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    runs = {**QUERIES, "hcg_edges_orders": hcg_edges_orders}
    spark = local_session(cpus, "flowloom-bench")
    # One run to start the JVM's code paths; not timed.
    runs["hcg_edges"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in chosen:
        started = time.perf_counter()
        runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
