"""

Usage: python tools/duckdb_baseline.py [sf_dir] [runs]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import duck  # noqa: E402

from omnisales.oracle import oracle_queries  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    runs = int(sys.argv[2]) if len(sys.argv) > 2 else 3
    con = duck(sf_dir)
    times = {}
    for name, sql in oracle_queries().items():
        best = None
        for _ in range(runs):
            t0 = time.perf_counter()
            con.execute(sql).fetchall()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 4)
    print(json.dumps({"engine": "duckdb", "sf_dir": sf_dir, "threads": con.execute("select current_setting('threads')").fetchone()[0],
                      "total": round(sum(times.values()), 3), "queries": times}))


if __name__ == "__main__":
    main()
