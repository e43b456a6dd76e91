"""Command-line check of every registered query against its oracle: python tests/check_oracles.py SF_DIR [names]."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle_harness import compare, duck  # noqa: E402
from trailsift.session import get_session  # noqa: E402


def main():
    sf_dir = sys.argv[1]
    only = set(sys.argv[2:])
    spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sqls = E.oracle_sql()
    bad = 0
    for name, fn in E.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                ok, msg = compare(df, con, sqls[name])
            else:
                ok, msg = True, f"rows only: {df.count()}"
        except Exception as exc:  # report and go on
            ok, msg = False, "".join(traceback.format_exception_only(type(exc), exc))[-1500:]
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name:26s} {time.time() - t:6.1f}s {msg}", flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
