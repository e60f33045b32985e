"""python -m lodestream QUERY|FILE.sql|FILE.json --data DIR: run, print rows, report times.

QUERY is a registered name; a .sql file is a SELECT over the catalog's views, a
.json file a logical plan.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from . import plans
from .config import Config
from .plans.planfront import Translator
from .session import session
from .sources.catalog import register, table
from .sources.sinks import assert_result, expected, golden, print_rows


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestream", description=__doc__)
    p.add_argument("query")
    p.add_argument("--data", help="folder of Parquet tables")
    p.add_argument("--config", help="JSON configuration, instead of --data")
    p.add_argument("--runs", type=int, default=1)
    p.add_argument("--master", default=None)
    p.add_argument("--golden", help="file to write the result to as expected values")
    p.add_argument("--expect", help="file of expected values that the result must equal")
    a = p.parse_args(argv)
    config = Config.read(Path(a.config).read_text()) if a.config else Config(dataset_path=a.data or ".")
    spark = session(a.master, **{k.replace(".", "__"): v for k, v in config.spark().items()})
    data = config.path()

    def run():
        if a.query.endswith(".sql"):
            register(spark, data)
            return spark.sql(Path(a.query).read_text().strip().rstrip(";"))
        if a.query.endswith(".json"):
            return Translator(lambda t: table(spark, f"{data}/{t}.parquet")).plan(json.loads(Path(a.query).read_text()))
        return plans.QUERIES[a.query](spark, data)

    if a.golden:
        Path(a.golden).write_text(golden(run()))
    if a.expect:
        df = run()
        assert_result(df, expected(Path(a.expect).read_text(), df))
    print("run,rows,seconds", file=sys.stderr)
    for k in range(a.runs):
        began = time.perf_counter()
        n = print_rows(run()) if k == 0 else run().count()
        print(f"{k},{n},{time.perf_counter() - began:.3f}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
