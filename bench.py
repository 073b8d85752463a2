"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default all registered), BENCH_RUNS (1).

Every query is run to completion into the no-op sink. The derived collections
are written first and timed as ``collections``; each query then reports the
median of BENCH_RUNS runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame

from newsloom.queries import all_queries
from newsloom.queries.bindings import Newsroom
from newsloom.session import local_session


def finish(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    began = time.perf_counter()
    action()
    return time.perf_counter() - began


def main() -> int:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    queries = all_queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(queries)
    spark = local_session("bench", cpus)
    # Local files are few and small: let small partitions stay apart.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    room = Newsroom(spark, folder)
    results = {"collections": round(timed(lambda: (room.model, room.mentions)), 3)}
    for name in names:
        run = lambda name=name: finish(queries[name](spark, folder))
        results[name] = round(statistics.median(timed(run) for _ in range(runs)), 3)
        print(f"{name:32s} {results[name]:8.3f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(results.values()), 3),
                "unit": "sec",
                "queries": results,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
