import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb  # noqa: E402

from bench import HEADLINE  # noqa: E402
from quarry.plans.oracle import ORACLE  # noqa: E402
from quarry.sources.tables import DRIVER_TABLES  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
con = duckdb.connect()
con.execute("SET threads TO 8")
for t in DRIVER_TABLES:
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
out = {}
for k in HEADLINE:
    best = None
    for _ in range(2):
        t0 = time.perf_counter()
        con.execute(ORACLE[k]).fetchall()
        dt = time.perf_counter() - t0
        best = dt if best is None else min(best, dt)
    out[k] = round(best, 3)
print(json.dumps({"duckdb_total": round(sum(out.values()), 3), "queries": out}))
