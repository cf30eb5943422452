"""Pre-open windows: boundaries, daylight saving, and brute force over whole fixtures."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from pulsegrid.operators import setops, windows
from pyspark.sql import functions as F

SCHEMA = ("post_id long, ticker string, timestamp timestamp, score long, num_comments long, sentiment_score double, "
          "sentiment_label string, sentiment_conf double")


def posts(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def post(i, ts, s=0.5, score=3, key="A", conf=0.9):
    return (i, key, dt.datetime.fromisoformat(ts), score, 2, s, "positive" if s and s > 0 else None, conf)


def days(spark, *ds):
    return spark.createDataFrame([(dt.date.fromisoformat(d),) for d in ds], "date date")


def test_cutoff_is_strict_and_lower_bound_is_closed(spark):
    p = posts(spark, [post(1, "2024-01-10 14:30:00"), post(2, "2024-01-10 14:29:59"), post(3, "2024-01-09 14:30:00"), post(4, "2024-01-09 14:29:59")])
    r = windows.attention_before_open(p, days(spark, "2024-01-10"), min_count=1).collect()
    assert len(r) == 1 and (r[0].post_count_1d, r[0].post_count_3d, r[0].post_count_7d) == (2, 3, 3)


def test_summer_time_moves_the_cutoff(spark):
    p = posts(spark, [post(1, "2024-07-10 13:29:00"), post(2, "2024-07-10 13:31:00")])
    r = windows.attention_before_open(p, days(spark, "2024-07-10", "2024-07-11"), min_count=1).orderBy("date").collect()
    assert [x.post_count_1d for x in r] == [1, 1]


def test_clock_change_keeps_windows_in_hours(spark):
    # the New York clock moves forward on 2024-03-10: cutoffs are 23 hours apart
    p = posts(spark, [post(1, "2024-03-09 14:00:00"), post(2, "2024-03-09 13:29:00")])
    r = windows.attention_before_open(p, days(spark, "2024-03-10"), min_count=1).collect()
    assert r[0].post_count_1d == 1 and r[0].post_count_3d == 2


def test_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    n, t0 = 900, dt.datetime(2024, 3, 1)
    rows = []
    for i in range(n):
        s = None if i % 7 == 0 else float(np.round(rng.uniform(-1, 1), 2))
        key = "HOT" if i % 3 else f"K{i % 4}"
        rows.append((i, key, t0 + dt.timedelta(seconds=int(rng.integers(0, 20 * 86400))), int(rng.integers(-5, 40)), int(rng.integers(0, 9)), s,
                     "positive" if (s or 0) > 0.05 else "neutral", float(rng.uniform(0.5, 1))))
    ds = [dt.date(2024, 3, 1) + dt.timedelta(days=i) for i in range(22)]
    got = windows.attention_before_open(posts(spark, rows), spark.createDataFrame([(d,) for d in ds], "date date"), min_count=3).toPandas()
    got = got.set_index(["ticker", "date"]).sort_index()
    pdf = pd.DataFrame(rows, columns="post_id ticker ts score num_comments s label conf".split())
    want = {}
    for d in ds:
        hour = 14 if d < dt.date(2024, 3, 10) else 13
        cut = dt.datetime(d.year, d.month, d.day, hour, 30)
        for k, p in pdf.groupby("ticker"):
            def win(h):
                return p[(p.ts < cut) & (p.ts >= cut - dt.timedelta(hours=h))]
            a, b, c = win(24), win(72), win(168)
            if len(a) < 3:
                continue
            v = a.dropna(subset=["s"])
            w = float((v.s * np.log1p(v.score.clip(lower=0))).sum()) / len(a) if len(v) else math.nan
            want[(k, d)] = (len(a), len(b), len(c), a.score.sum(), v.s.mean(), b.s.mean(), w, v.s.std(), (a.label == "positive").sum() / len(a), a[a.conf >= 0.8].s.mean())
    assert set(want) == set(got.index)
    cols = ["post_count_1d", "post_count_3d", "post_count_7d", "total_upvotes_1d", "avg_sentiment_1d", "avg_sentiment_3d", "weighted_sentiment",
            "sentiment_std", "bullish_ratio", "avg_sentiment_hc"]
    for key, w in want.items():
        assert np.allclose(got.loc[key, cols].astype(float), np.array(w, dtype=float), equal_nan=True), key


def test_copies_are_folded_to_the_most_confident(spark):
    p = posts(spark, [post(1, "2024-01-10 10:00:00", s=0.1, conf=0.6), post(1, "2024-01-10 10:00:00", s=0.9, conf=0.95)] + [post(1, "2024-01-10 10:00:00", s=0.2, conf=0.7)] * 50)
    r = setops.keep_best(p, ["post_id", "ticker"], [F.col("sentiment_conf"), F.col("score")]).collect()
    assert len(r) == 1 and r[0].sentiment_score == pytest.approx(0.9)


def test_lagged_features_use_yesterday_only(spark):
    d0 = dt.date(2024, 1, 1)
    daily = spark.createDataFrame([("A", d0, 4, 9, 2.0, 4, 3.0), ("A", d0 + dt.timedelta(days=2), 1, 1, -0.5, 1, 0.5)],
                                  "ticker string, date date, count_d long, comments_d long, score_sum_d double, score_cnt_d long, abs_sum_d double")
    dense = windows.densify(daily, ["count_d", "comments_d", "score_sum_d", "score_cnt_d", "abs_sum_d"], end="2024-01-04")
    r = windows.lagged_post_features(dense).orderBy("date").collect()
    assert [x.post_count_1d for x in r] == [None, 4, 0, 1]
    assert r[1].avg_sentiment_1d == 0.5 and r[2].avg_sentiment_1d == 0.0 and r[2].avg_sentiment_3d == 0.5
    assert r[3].avg_sentiment_3d == pytest.approx(1.5 / 5)
