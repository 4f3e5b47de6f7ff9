"""Times the headline queries: one warm-up, then the median of three runs each; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logloom.plans import registered  # noqa: E402
from logloom.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def seconds(query, spark) -> float:
    t = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered.queries()
    warm, cold = {}, {}
    for name in registered.headline():
        cold[name] = round(seconds(queries[name], spark), 3)
        warm[name] = round(statistics.median(seconds(queries[name], spark) for _ in range(RUNS)), 3)
        print(name, cold[name], warm[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, warm median, total", "value": round(sum(warm.values()), 3),
                      "unit": "sec", "queries": warm, "cold": cold, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
