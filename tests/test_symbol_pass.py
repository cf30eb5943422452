"""Symbols are looked up in one pass, a few rows at a time."""

import numpy as np
import pyarrow as pa

from pulsegrid.functions import matching
from pulsegrid.functions import text as tx


def test_slices_cover_a_batch():
    b = pa.record_batch({"x": pa.array(np.arange(1000))})
    parts = list(matching.sliced([b]))
    assert max(p.num_rows for p in parts) <= matching.SLICE_ROWS and sum((p["x"].to_pylist() for p in parts), []) == list(range(1000))


def test_symbols_take_one_pass(spark):
    rows = [(1, "Is $UP up, Is UP"), (2, None), (3, "none"), (4, "$IT and IT")]
    got = tx.symbol_mentions(spark.createDataFrame(rows, "id long, text string"), "text", ["UP", "Is", "IT"], ["IT"])
    assert sorted((r.id, r.ticker, r.match_type) for r in got.collect()) == [(1, "Is", "word"), (1, "UP", "dollar"), (4, "IT", "word")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
