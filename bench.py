"""Headline queries at one scale; prints one JSON line.

Every query is computed in full (all rows, all columns) into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "top_companies", "canonical_edges", "distinct_entities", "alias_scoped", "alias_global", "edge_validation",
    "reference_edges", "note_links", "label_links", "propagate_types", "metadata_merge", "body_hash", "snapshot_diff",
    "file_history", "debounce_sessions", "worklist", "prompt_multi", "pattern_match", "two_hop", "walk_counts",
    "neighbourhood", "graph_nodes", "json_salvage", "pr_f1", "chunk_coverage", "semantic_chunks", "extracted_triples",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    from noteskein.plans.catalogue import QUERIES
    from noteskein.session import local_session

    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
