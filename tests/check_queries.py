"""Command line form of the oracle test: ``python tests/check_queries.py <sf_dir> [name ...]``."""

import sys
import time

sys.path.insert(0, "/root/repo")

import __spark_entry__ as entry_module
from flowlens.session import get_session
from tests.harness import connect, differences

if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = get_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(sf_dir), entry_module.queries(), entry_module.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            found = differences(df, con, oracles[name]) if name in oracles else [] if df.collect() else ["no rows"]
        except Exception as error:  # reported, and the next query still runs
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        kind = "sql " if name in oracles else "rows"
        print(f"{'FAIL' if found else 'ok  '} {kind} {time.time() - start:6.2f}s {name}", flush=True)
        for line in found:
            print("   ", line)
    print("failures:", bad)
