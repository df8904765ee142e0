"""Run every registered query against its DuckDB oracle.

usage: python tests/run_oracle.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from compare import compare  # noqa: E402
from tillsight.session import get_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    spark = get_session()
    qs, oracle = E.queries(), E.oracle_sql()
    bad = []
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        t = time.time()
        try:
            if name in oracle:
                ok, n = compare(spark, name, fn, oracle[name], sf)
                status = "OK " if ok else "BAD"
            else:
                n = fn(spark, sf).count()
                ok, status = True, "ROW"
        except Exception as e:  # report and go on
            ok, n, status = False, -1, "ERR"
            print(f"ERR {name}: {type(e).__name__}: {str(e)[:800]}", file=sys.stderr)
        print(f"{status} {name:32s} rows={n:<8d} {time.time() - t:6.2f}s", flush=True)
        if not ok:
            bad.append(name)
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
