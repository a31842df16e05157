"""Run every registered query against its oracle (or rows-only) at one scale.

    python tests/run_oracle.py /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle_compare import compare  # noqa: E402
from roundlearn.session import local_session  # noqa: E402


def main():
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = local_session(8, 8)
    qs, sq = E.queries(), E.oracle_sql()
    bad = []
    for k, fn in qs.items():
        if only and k not in only:
            continue
        t = time.time()
        try:
            df = fn(spark, d)
            if k in sq:
                ok, msg = compare(df, d, sq[k])
            else:
                n = df.count()
                ok, msg = True, f"rows-only: {n} rows"
        except Exception as ex:  # noqa: BLE001
            ok, msg = False, f"ERROR {type(ex).__name__}: {str(ex)[:400]}"
            traceback.print_exc(limit=3)
        print(f"{'OK ' if ok else 'BAD'} {k:28s} {time.time() - t:6.2f}s {msg[:300]}", flush=True)
        if not ok:
            bad.append(k)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
