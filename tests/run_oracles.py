"""python tests/run_oracles.py [sf_dir] [name ...] -> per-query oracle report."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle import compare, duck  # noqa: E402
from panelkit.session import get_spark  # noqa: E402


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    con = duck(sf)
    qs, sql = E.queries(), E.oracle_sql()
    bad = 0
    for name in (names or sorted(qs)):
        t0 = time.time()
        if name not in sql:
            n = qs[name](spark, sf).count()
            print(f"ROWS  {name}: {n} rows ({time.time()-t0:.1f}s)")
            continue
        try:
            r = compare(spark, con, name, qs[name], sql[name], sf)
        except Exception as e:  # report and go on
            bad += 1
            print(f"ERROR {name}: {type(e).__name__}: {str(e)[:600]}")
            continue
        bad += not r["ok"]
        print(("OK    " if r["ok"] else "FAIL  ") + f"{name} ({time.time()-t0:.1f}s)"
              + ("" if r["ok"] else " " + json.dumps(r, default=str)[:1500]))
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
