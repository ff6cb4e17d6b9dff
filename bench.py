"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_QUERIES comma-separated names instead of the headline set
BENCH_SQL=1   also times the checking SQL, as the baseline at the same scale
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from kilnworks.plans.catalog import catalog
from kilnworks.runtime import local_session, scratch_scope

HEADLINE = (
    "baseline_regressions",
    "target_regressions",
    "target_trend",
    "project_day_stats",
    "diagnostic_clusters",
    "flaky_tests",
    "build_list",
    "detail_files",
    "stored_status",
    "prunable_builds",
    "step_ordinals",
    "log_summary",
    "log_timeline",
    "activity_builds",
    "document_targets",
    "graph_transitive",
    "graph_cycles",
    "graph_shortest_chains",
    "bottlenecks",
    "evidence_chains",
    "advice",
    "redacted_texts",
)


def timed(run) -> float:
    begin = time.perf_counter()
    run()
    return round(time.perf_counter() - begin, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = local_session(cores, int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog().queries
    spark.read.parquet(f"{folder}/lineitem.parquet").write.format("noop").mode("overwrite").save()

    def run(name: str) -> None:
        with scratch_scope(spark):
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in names:
        seconds[name] = timed(lambda name=name: run(name))
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
    }
    if os.environ.get("BENCH_SQL"):
        sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "tests"))
        from compare import connect

        con = connect(folder)
        oracles = catalog().oracles
        result["sql_seconds"] = {
            name: timed(lambda name=name: con.execute(oracles[name]).fetchall())
            for name in names
            if name in oracles
        }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
