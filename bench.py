"""Seconds per headline query: one JSON line.

Reads ``$BENCH_SF_DIR`` (default sf0.1) on ``local[$BENCH_CPUS]``. The two indexes are built first, timed as
queries of their own; searches then read them, as they would read a stored index. Each query runs once.
"""

from __future__ import annotations

import json
import os
import time

from bagtree.catalog import QUERIES
from bagtree.catalog import data
from bagtree.session import local_session

HEADLINE = (
    "ingest_images",
    "ingest_captions",
    "encode_hashed_text",
    "encode_dense_text",
    "sample_new_docs",
    "kmeans_assign",
    "kmeans_update",
    "kmeans_plus_plus",
    "tree_two_levels",
    "tree_default_shape",
    "quantize_paths",
    "quantize_paths_by_join",
    "postings_tf",
    "query_term_weights",
    "search_embeddings",
    "search_topn",
    "search_text",
    "feedback_bags",
    "search_two_step",
    "exact_topk",
    "evaluate_sweep",
    "append_split",
    "append_term_stats",
    "stream_append",
    "active_tree",
    "retire_keep_set",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus, app="bagtree-bench")
    spark.sparkContext.setLogLevel("ERROR")

    # Start the JVM's and the Python workers' machinery before the clock.
    QUERIES["quantize_paths"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()

    seconds: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    timed("build_index_pictures", lambda: data.pictures(spark, sf_dir))
    timed("build_index_captions", lambda: data.captions(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    recall = {str(r["n"]): r["recall"] for r in QUERIES["recall_vs_exact"](spark, sf_dir).collect()}

    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "recall_vs_exact": recall,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
