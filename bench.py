"""Times every query at one scale and prints one line of JSON.

Settings: BENCH_SF_DIR (table folder), BENCH_CPUS (local cores), BENCH_QUERIES (names, comma-separated),
BENCH_HOT_ROWS (rows above which a group may be hot; 1 times the split plans).
A query is run whole and its rows are thrown away by the no-op writer, so no column is pruned.
"""

from __future__ import annotations

import json
import os
import time

from strandline.operators.hot import HOT_ROWS_CONF
from strandline.plans import REGISTRY
from strandline.session import local_session


def run(spark, build, sf_dir: str) -> float:
    start = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(REGISTRY)
    spark = local_session(cores, "bench")
    if hot_rows := os.environ.get("BENCH_HOT_ROWS"):
        spark.conf.set(HOT_ROWS_CONF, hot_rows)
    run(spark, REGISTRY["pricing_summary"].build, sf_dir)
    times = {name: round(run(spark, REGISTRY[name].build, sf_dir), 3) for name in names}
    line = {
        "metric": "total query time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "cpus": cores,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
