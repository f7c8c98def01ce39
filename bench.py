"""Time the headline queries: prints one JSON line.

Each query is run once to warm up and then three times; the median counts.
Reads ``BENCH_SF_DIR`` and ``BENCH_CPUS``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dugout.session import local_session  # noqa: E402
from dugout.sources.shared import remove_written  # noqa: E402
from verification.queries import QUERIES  # noqa: E402

HEADLINE = (
    "run_values_m3", "woba_weights", "batting_line", "plus_stats_m2", "hit_quality",
    "top_half_mean", "runs_to_end", "season_level", "stratified_split", "confusion_metrics",
    "multinomial_score", "multinomial_fit",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    remove_written(spark)
    spark.stop()


if __name__ == "__main__":
    main()
