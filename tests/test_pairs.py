"""Tiled correlation of all pairs against a plain loop."""

import numpy as np
import pandas as pd

from pulsegrid.operators import joins


def test_tiles_give_all_pairs_above_the_limit(spark):
    rng = np.random.default_rng(5)
    days = pd.date_range("2024-01-01", periods=90).date
    common, rows = rng.normal(0, 0.02, (3, 90)), []
    for k in range(30):
        close = 100 * np.exp(np.cumsum(common[k % 3] * (-1) ** (k // 15) + rng.normal(0, 0.004 + 0.0005 * k, 90)))
        close = np.full(90, 50.0) if k == 7 else close  # no variance: in no pair
        rows += [(f"K{k:02d}", d, float(c)) for d, c in zip(days, close) if rng.random() > (0.7 if k == 8 else 0.1)]
    pdf = pd.DataFrame(rows, columns=["ticker", "date", "close"])
    rets = {k: g["close"].pct_change().set_axis(g["date"]).dropna().tail(60) for k, g in pdf.groupby("ticker")}
    want = {}
    for a in rets:
        for b in rets:
            both = pd.concat([rets[a], rets[b]], axis=1, join="inner")
            if a < b and len(both) >= 20 and "K07" not in (a, b) and abs(c := np.corrcoef(both.T.to_numpy())[0, 1]) >= 0.5:
                want[a, b] = (len(both), round(float(c), 9))
    assert len(want) > 20
    bars = spark.createDataFrame(pdf)
    for tiles in (None, 4):
        got = {(r.key_a, r.key_b): (r.n, round(r.corr, 9)) for r in joins.correlated_pairs(bars, 0.5, tiles=tiles).collect()}
        assert got == want
    assert joins.correlated_pairs(bars.limit(0), 0.5).count() == 0
