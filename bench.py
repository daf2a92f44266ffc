"""Times the named queries and prints one JSON line.

Settings by environment: BENCH_SF_DIR (tables), BENCH_CPUS (threads), BENCH_RUNS (timed runs after one warm
run; the median counts), BENCH_QUERIES (comma list; all by default).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from reclutark.queries import queries
from reclutark.session import get_session


def timed(spark, sf_dir, query) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name, query in queries().items():
        if chosen and name not in chosen:
            continue
        timed(spark, sf_dir, query)
        seconds[name] = round(statistics.median(timed(spark, sf_dir, query) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total of median warm run times of all named queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": int(cpus),
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
