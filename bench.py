"""Headline queries, timed end to end on one machine. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from gleaner.session import local_session
from gleaner.suite import inputs
from gleaner.suite.queries import QUERIES

HEADLINES = (
    "normalize_text", "chunk_fixed", "chunk_structural", "term_statistics", "bm25_top_k",
    "bm25_explanation", "dense_top_k_by_label", "rank_fusion", "hybrid_top_k", "rerank_audit",
    "pack_context", "assemble_prompts", "retrieval_report", "diagnosis_report",
    "configuration_comparison", "collection_check",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        began = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - began, 3)

    # The index and the gold ids are stored once; queries read them.
    timed("index_build", lambda: inputs.index(spark, sf_dir))
    timed("gold_lookup", lambda: inputs.gold(spark, sf_dir))
    for name in HEADLINES:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).lstrip("sf"),
    }))


if __name__ == "__main__":
    main()
