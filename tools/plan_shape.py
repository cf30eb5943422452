"""Count scans, exchanges and reuses in a query's final plan: python tools/plan_shape.py NAME [SF]"""
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from pulsegrid.plans import registered
from pulsegrid.session import local_session

spark = local_session("plan")
sf = "/root/testdata/sf0.01"
for n in [a for a in sys.argv[1:] if not a.startswith(("/", "-"))]:
    for _ in range(2):
        t = time.time()
        df = registered.QUERIES[n](spark, sf)
        df.collect()
        dt = time.time() - t
    p = df._jdf.queryExecution().executedPlan().toString()
    final = p.split("== Initial Plan ==")[0]
    c = lambda s: len(re.findall(s, final))
    print(f"{n}: {dt:.2f}s scans={c('Scan parquet')} exchanges={c(r'Exchange hash|Exchange Single|Exchange Round')} reused={c('ReusedExchange')} "
          f"bcast={c('BroadcastExchange')} python={c('Python|Pandas')} cartesian={c('CartesianProduct')} nlj={c('BroadcastNestedLoopJoin')}")
    if "-v" in sys.argv:
        print(final)
