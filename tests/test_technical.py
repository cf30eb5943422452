import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import signals as sig
from pulsegrid.operators import joins, technical as tech

D0 = dt.date(2024, 1, 1)


def bars(spark, closes, ticker="A", spread=1.0, volume=100.0):
    rows = [(ticker, D0 + dt.timedelta(days=i), float(c), float(c) + spread, float(c) - spread, volume) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, date date, close double, high double, low double, volume double")


def col(df, c):
    return [r[c] for r in df.orderBy("ticker", "date").collect()]


def test_rsi_without_a_loss_is_fifty(spark):
    up = bars(spark, range(100, 120))
    assert col(tech.rsi_simple(up), "rsi_14") == [50.0] * 20
    assert col(tech.rsi_simple(up, no_loss=None), "rsi_14") == [None] * 20
    assert col(tech.rsi_wilder(up), "rsi_14")[-1] == 100.0
    assert col(tech.rsi_wilder(up), "rsi_14")[13] is None


def test_range_average_starts_with_the_first_range(spark):
    a = col(tech.atr_wilder(bars(spark, [100, 100, 110])), "atr_14")
    assert a[0] == 2.0 and a[1] == 2.0
    assert a[2] == pytest.approx(2.0 + (11.0 - 2.0) / 14)
    n = tech.wilder_average(bars(spark, [1, 2, 4]), {"e": "close"}, normalised=True)
    w = 13 / 14
    assert col(n, "e")[2] == pytest.approx((4 + 2 * w + w * w) / (1 + w + w * w))


def test_jump_fades_over_the_following_rows(spark):
    closes = [100] * 3 + [121] + [121] * 16
    p = col(tech.jump_decay(bars(spark, closes)), "pead_proxy")
    assert p[3] == 0.0 and p[4] == pytest.approx(0.1)  # 0.21 * 0.95 is clipped
    assert p[4 + 11] == pytest.approx(0.21 * (1 - 12 / 20))


def test_first_rows_and_last_rows_are_null(spark):
    d = tech.forward_returns(tech.pct_change(bars(spark, range(100, 110)), (1, 5)), (1, 5))
    assert col(d, "returns_5d")[:5] == [None] * 5 and col(d, "target_return_5d")[-5:] == [None] * 5
    assert col(d, "target_return_1d")[0] == pytest.approx(0.01)


def test_percentile_needs_twenty_rows(spark):
    p = col(tech.rolling_percentile(bars(spark, range(30))), "percentile")
    assert p[:19] == [0.5] * 19 and p[19] == pytest.approx(19 / 20)


def test_benchmark_falls_below_its_average(spark):
    b = bars(spark, [100] * 209 + [50])
    d = tech.above_average(tech.pct_change(b, (60,), prefix="ret_"), 200, out="a").orderBy(F.col("date").desc()).limit(1)
    r = d.select(sig.market_regime(F.col("a") == 1.0, F.col("ret_60d")).alias("r")).first().r
    assert r == "negative"


def test_zero_volume_and_missing_prices_do_not_fail(spark):
    b = bars(spark, [0.0, 1.0, None or 2.0], volume=0.0)
    d = tech.relative_volume(tech.pct_change(b, (1,)), 20, 1, 1.0)
    assert col(d, "returns_1d") == [None, None, 1.0] and col(d, "relative_volume") == [1.0] * 3


def test_asof_never_looks_ahead(spark):
    rows = bars(spark, [1, 1, 1, 1]).select("ticker", "date")
    s = spark.createDataFrame([(D0 + dt.timedelta(days=1), 7.0), (D0 + dt.timedelta(days=3), 9.0)], "date date, v double")
    assert col(joins.asof_series(rows, s, "v", 0.5), "v") == [0.5, 7.0, 7.0, 9.0]
    assert col(joins.asof_series(rows, s, "v", 0.5, strict=True), "v") == [0.5, 0.5, 7.0, 7.0]
