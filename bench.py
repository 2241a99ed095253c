"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from rangeloom import catalog
from rangeloom.session import session

HEADLINE = ("cover_amplification", "span_merge", "chunk_overlap", "asof_floor_lookup", "run_coalesce", "budget_windows", "read_plan", "vram_plan", "gate_verdict", "first_event", "order_violation", "event_pivot", "arm_summary", "paired_ratio", "staircase_shape", "delta_stats", "bundle_digest", "path_conflict", "redact_urls", "duplicates_by_digest")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["role_histogram"](spark, sf).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            t = time.time()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "total of headline queries, best of two", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
