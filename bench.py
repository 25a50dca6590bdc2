"""Benchmark: run the headline queries and print ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (timed runs per query, default 3; one warm-up run first),
BENCH_QUERIES (comma list; default all batch queries except the *_files
round trips), BENCH_SHUFFLE_PARTITIONS (default 2 x cpus).
Each run executes the whole plan into a no-op sink (nothing is collected),
so the time is the distributed work, not driver transfer.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skywatch.plans.queries import QUERIES  # noqa: E402
from skywatch.session import get_spark  # noqa: E402

# Headline set: the batch queries. Streams and the round trips over files
# (which write their inputs first) run on request via BENCH_QUERIES.
STREAMING = {"login_stream", "login_messages", "device_stream", "usage_by_source", "usage_landed", "report_written", "store_round_trip", "issue_lifecycle_stored"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or \
        [q for q in QUERIES if q not in STREAMING and not q.endswith("_files")]
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus * 2)), app_name="skywatch-bench",
                      extra={"spark.ui.showConsoleProgress": "false"})
    times: dict[str, float] = {}
    for name in names:
        fn = QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    out = {"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
           "cpus": cpus, "runs": runs}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
