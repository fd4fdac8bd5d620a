"""Time each oracle query on DuckDB (the reference's engine) at one scale.

Usage: python tools/duck_bench.py [sf_dir]; prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


def main() -> None:
    import diffcheck
    from cordon.plans.oracle import ORACLE

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con = diffcheck.duck(sf_dir)
    con.execute(ORACLE["trip_counts"]).fetchall()  # warm-up
    times = {}
    for name, sql in ORACLE.items():
        t0 = time.perf_counter()
        con.execute(sql).fetchall()
        times[name] = round(time.perf_counter() - t0, 4)
    print(json.dumps({"engine": "duckdb", "value": round(sum(times.values()), 4), "unit": "sec",
                      "queries": times, "sf_dir": sf_dir}))


if __name__ == "__main__":
    main()
