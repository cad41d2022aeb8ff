"""Times the headline queries. Prints one JSON line.

BENCH_SF_DIR: driver tables (default /root/testdata/sf0.1), BENCH_CPUS: local cores.
Every query runs to a noop sink (all rows are computed, none collected), once to warm up and
then BENCH_RUNS times; the best run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from footfall.session import build_session  # noqa: E402
from footfall.workload.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "kpis", "sessionize", "entry_exit", "transitions", "breakdowns", "campaigns", "timeseries_daily", "overview",
    "goals", "funnel", "revenue_by_source", "top_products", "ai_sources", "bot_summary", "daily_rollup",
    "breakdown_cube", "long_kpis", "merkle_root", "find_bursts", "ingest_hits", "mask_path", "rate_limit",
    "search_kpis", "rank_pages",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        best = None
        for i in range(runs + 1):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t0
            if i:
                best = took if best is None else min(best, took)
            spark.catalog.clearCache()
        times[name] = round(best, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
