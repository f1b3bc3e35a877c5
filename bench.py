"""Time the registered queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores. Each query is
computed in full into a sink that discards the rows; the first flagship run only warms the session up.
"""

from __future__ import annotations

import json
import os
import sys
import time

from driftwatch.plans.queries import QUERIES
from driftwatch.session import local_session


def timed(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(QUERIES)
    spark = local_session(cpus, shuffle_partitions=8, name="driftwatch-bench")
    spark.sparkContext.setLogLevel("ERROR")
    timed(QUERIES["motor_alerts_ci"], spark, sf_dir)
    seconds = {name: timed(QUERIES[name], spark, sf_dir) for name in names}
    spark.stop()
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
