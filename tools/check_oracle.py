"""Run registered queries against their SQL: ``check_oracle.py SF_DIR [name-prefix ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from compare import compare, connect  # noqa: E402

from bourselake.plans import catalog  # noqa: E402
from bourselake.session import local_session  # noqa: E402


def main() -> int:
    sf_dir, *prefixes = sys.argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = catalog.bound_queries(), catalog.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                note = "ok" if problem is None else problem
            else:
                n = len(df.collect())
                problem, note = None, f"rows only: {n}"
        except Exception as e:  # noqa: BLE001
            problem = note = f"{type(e).__name__}: {str(e)[:900]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if problem is not None:
            bad.append(name)
        print(f"{name:38s} {time.time() - start:6.2f}s  {note}", flush=True)
    print(f"{len(bad)} problems: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
