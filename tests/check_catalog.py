"""Command line check: ``python tests/check_catalog.py [sf dir] [name prefix ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from tests.compare import connect, differences  # noqa: E402


def main() -> int:
    path = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:]) or ("",)
    from sensorframe.catalog import all_queries

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(path)
    bad = 0
    for name, query in all_queries().items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = query.run(spark, path)
            if query.sql is None:
                found = [] if df.count() else ["no rows"]
            else:
                found = differences(df, con, query.sql)
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        print(f"{'BAD ' if found else 'ok  '} {name} {time.time() - start:.2f}s", *found, flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
