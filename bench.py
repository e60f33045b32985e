"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The first run of each query is reported apart from the mean of the others.
``python bench.py --duckdb`` times the same queries in DuckDB on the same files,
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from lodestream import plans
from lodestream.session import session

HEADLINE = [f"tpch_q{n:02d}" for n in (1, 5, 6, 7, 8, 9, 12, 14, 17, 19)]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    first, mean, spread = {}, {}, {}
    for name in HEADLINE:
        took = []
        for _ in range(1 + runs):
            began = time.perf_counter()
            plans.QUERIES[name](spark, sf).collect()
            took.append(time.perf_counter() - began)
        first[name], mean[name] = round(took[0], 4), round(statistics.mean(took[1:]), 4)
        spread[name] = round(statistics.pvariance(took[1:]), 6)
    print(json.dumps({"metric": "tpch_supported_total", "value": round(sum(mean.values()), 4), "unit": "sec", "queries": mean, "first_run": first, "variance": spread, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


def duckdb_times() -> None:
    import duckdb

    from lodestream.sources.catalog import TABLES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    db = duckdb.connect(config={"threads": int(os.environ.get("BENCH_CPUS", "8"))})
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    mean = {}
    for name in HEADLINE:
        took = []
        for _ in range(4):
            began = time.perf_counter()
            db.execute(plans.ORACLE_SQL[name]).fetchall()
            took.append(time.perf_counter() - began)
        mean[name] = round(statistics.mean(took[1:]), 4)
    print(json.dumps({"metric": "duckdb_total", "value": round(sum(mean.values()), 4), "unit": "sec", "queries": mean, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    duckdb_times() if "--duckdb" in sys.argv else main()
