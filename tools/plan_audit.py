"""Static look at the at-scale plans: single-partition exchanges, nested loops, cartesian products.

The size-checked shortcuts are switched off, so these are the plans large inputs get.
usage: python tools/plan_audit.py [prefix ...]
"""
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from pulsegrid.plans import registered
from pulsegrid.session import local_session

spark = local_session("audit")
spark.conf.set("pulsegrid.smallInputBytes", "0")
spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
SKIP = ("m20", "m21", "m22", "m23", "m24", "s0", "s10_insert_p", "s12", "t0")
for n in registered.QUERIES:
    if n.startswith(SKIP) or (len(sys.argv) > 1 and not n.startswith(tuple(sys.argv[1:]))):
        continue
    plan = registered.QUERIES[n](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    # a global window: a sort or window right above a single-partition exchange
    single_sort = sum(1 for a, b in zip(lines, lines[1:]) if "Sort " in a and "Exchange SinglePartition" in b)
    nlj, cart = len(re.findall("BroadcastNestedLoopJoin", plan)), len(re.findall("CartesianProduct", plan))
    if single_sort or cart or nlj:
        print(f"AUDIT {n:42s} global_sorts={single_sort} nested_loops={nlj} cartesian={cart}", flush=True)
