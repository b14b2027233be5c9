"""Benchmark the headline queries.

Runs each query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS], forcing full execution with the ``noop`` sink (no
collect to the driver). Each query runs three times; the fastest run counts, so
JVM warm-up is not billed to whichever query happens to go first; an
untimed pass over the smallest scale factor warms the JIT first.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.plans.queries import REGISTRY  # noqa: E402
from quarry.session import local_session  # noqa: E402

HEADLINE = ["topk_search", "budget_search", "budget_search_ties", "build_prompts",
            "search_response_json", "resolve_citations", "ingest_documents",
            "authorize_requests", "session_upsert", "hash_embedding", "page_text"]


def run_once(spark, key: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    REGISTRY[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = sys.argv[1:] or HEADLINE
    spark = local_session(cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_PARTITIONS", "8")))
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for key in keys:
            run_once(spark, key, warm_dir)
    times = {}
    for key in keys:
        times[key] = round(min(run_once(spark, key, sf_dir) for _ in range(int(os.environ.get("BENCH_RUNS", "3")))), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
