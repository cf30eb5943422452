"""Run queries beside their SQL in DuckDB and compare rows.

usage: python tools/check_queries.py [--sf DIR] [pattern ...]
"""

import argparse
import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import duckdb

from pulsegrid.plans import registered
from pulsegrid.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("patterns", nargs="*")
    a = ap.parse_args()
    spark = local_session("check")
    con = connect(a.sf)
    bad = []
    names = [n for n in registered.QUERIES if not a.patterns or any(n.startswith(p) for p in a.patterns)]
    for n in names:
        t = time.time()
        try:
            df = registered.QUERIES[n](spark, a.sf)
            got = [tuple(x) for x in df.collect()]
            t1 = time.time() - t
            c1, g = rows_of(df.columns, got)
            if n not in registered.ORACLES:
                print(f"ROWS  {n:45s} rows={len(g)} {t1:.1f}s", flush=True)
                continue
            cur = con.execute(registered.ORACLES[n])
            c2, w = rows_of([d[0] for d in cur.description], cur.fetchall())
            if c1 != c2:
                bad.append(n); print(f"COLS  {n}: {c1} vs {c2}", flush=True)
            elif g != w:
                diff = [(x, y) for x, y in zip(g, w) if x != y]
                bad.append(n)
                print(f"DIFF  {n}: rows {len(g)} vs {len(w)}; {len(diff)} differ\n      spark {diff[0][0] if diff else g[-1:]}\n      sql   {diff[0][1] if diff else w[-1:]}", flush=True)
            else:
                print(f"ok    {n:45s} rows={len(g)} {t1:.1f}s{'  EMPTY' if not g else ''}", flush=True)
        except Exception as e:
            bad.append(n)
            msg = str(e).strip().split("\n")
            tb = traceback.extract_tb(e.__traceback__)
            at = [f"{Path(f.filename).name}:{f.lineno}" for f in tb if "pulsegrid" in f.filename][-2:]
            print(f"ERR   {n}: {type(e).__name__}: {' '.join(msg)[:420]} {at}", flush=True)
    print(f"{len(names)} queries, {len(bad)} bad: {bad}")
    spark.stop()


main()
