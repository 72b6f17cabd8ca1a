"""Benchmark: every proof query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion with the ``noop`` sink (full
evaluation, no collect to the driver). One warm-up pass on the smallest
scale loads classes and JIT-compiles; then each query runs
$BENCH_REPEAT times and the median is reported.

Prints ONE JSON line:
{"metric": "total_median_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from forumflow.plans.proofs import QUERIES  # noqa: E402
from forumflow.session import build_session  # noqa: E402


def run_once(spark, fn, sf_dir: str) -> float:
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "3")))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})
    names = only or list(QUERIES)
    warm = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    failed = {}
    if os.path.isdir(warm):
        for n in names:
            try:
                run_once(spark, QUERIES[n], warm)
            except Exception as e:  # noqa: BLE001 - reported below, the run goes on
                failed[n] = f"warm-up: {type(e).__name__}"
    per_query = {}
    for n in names:
        try:
            times = [run_once(spark, QUERIES[n], sf_dir) for _ in range(repeat)]
            per_query[n] = round(statistics.median(times), 3)
        except Exception as e:  # noqa: BLE001
            failed[n] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    out = {
        "metric": "total_median_sec",
        "value": round(sum(per_query.values()), 3),
        "unit": "sec",
        "queries": per_query,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "repeat": repeat,
        "spark": spark.version,
    }
    if failed:
        out["failed"] = failed
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
