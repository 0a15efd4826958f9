"""Times the headline queries (median of three runs each); prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from checks.session import local_session  # noqa: E402

HEADLINE = [
    "lines_split", "rule_match", "missing_headers", "confidence_score", "taint_flows",
    "dedup_findings", "incremental_changed", "report_order", "baseline_new",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("CHECK_PARTITIONS", cpus)
    spark = local_session(cpus)
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    seconds = {}
    for name in HEADLINE:
        if os.path.isdir(warm):  # class loading and code generation
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
        took = []
        for _ in range(RUNS):
            started = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - started)
        seconds[name] = round(median(took), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total of medians", "value": round(sum(seconds.values()), 3),
                "unit": "sec", "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
