"""Time the headline queries, the better of two runs each; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from catalog.queries import QUERIES
from faultline.session import local_session

HEADLINES = (
    "parse_lines",
    "inherit_trace_level",
    "error_group_report",
    "source_report",
    "search_logs_batch",
    "classify_log",
    "classify_lines",
    "incident_report",
    "assemble_result",
)
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    seconds = {}
    for name in HEADLINES:
        runs = []
        for _ in range(RUNS):  # the first one also compiles
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
