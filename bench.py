"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from strandloom.plans.queries import QUERIES
from strandloom.session import local_session

HEADLINE = ("reads", "edge_counts", "degree_histogram", "graph_statistics", "partition_statistics", "edges", "half_edges", "superkmer_counts", "unitigs", "unitig_records")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(32, 4 * int(cpus)), memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not a query's
    times = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
