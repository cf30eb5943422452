"""Fault injection for the integrity suite, and the leakage property of the panel job."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import filters, quality
from pulsegrid.plans import panel as jobs
from pulsegrid.plans.queries_models import _calendar_inputs
from pulsegrid.plans.tables import Tables

D0 = dt.date(2024, 1, 1)


def integrity_panel(spark, extra=()):
    rows = []
    for k in ("A", "B"):
        for i in range(25):
            c = 100.0 + i
            rows.append((k, D0 + dt.timedelta(days=i), c, None if i == 0 else 1 / (c - 1), None if i < 20 else 20 / (c - 20), 5, 0.0, 0.01))
    return spark.createDataFrame(rows + list(extra), "ticker string, date date, close double, returns_1d double, returns_20d double, post_count_1d long, sentiment_accel double, target_return_5d double")


def status(df):
    return df.first().status


def test_clean_panel_passes(spark):
    p = integrity_panel(spark)
    assert status(quality.check_future_targets(p, "2025-01-01")) == "PASS"
    assert status(quality.check_duplicates(p, "2023-12-31", "2024-01-01")) == "PASS"
    assert status(quality.check_return_recomputation(p, min_rows=20)) == "PASS"


def test_future_label_fails_check_one(spark):
    bad = [("A", dt.date(2024, 6, 8), 1.0, 0.0, 0.0, 5, 0.0, 0.03)]
    assert status(quality.check_future_targets(integrity_panel(spark, bad), "2024-06-10")) == "FAIL"
    assert status(quality.check_timestamps(integrity_panel(spark, bad), "2024-06-10")) == "FAIL"


def test_duplicate_key_fails_check_six(spark):
    p = integrity_panel(spark)
    assert status(quality.check_duplicates(p.unionByName(p.limit(1)), "2023-12-31", "2024-01-01")) == "FAIL"


def test_wrong_return_is_found_on_every_row(spark):
    p = integrity_panel(spark).withColumn("returns_1d", F.when((F.col("ticker") == "B") & (F.dayofmonth("date") == 23), 0.5).otherwise(F.col("returns_1d")))
    r = quality.check_return_recomputation(p, min_rows=20).first()
    assert (r.status, r.n_violations) == ("FAIL", 1)


def test_split_invariants_raise(spark):
    p = filters.split_by_date(integrity_panel(spark), "2024-01-10")
    quality.require_split_invariants(p, "2024-01-10")
    with pytest.raises(quality.PanelIntegrityError):
        quality.require_split_invariants(p, "2024-01-05")
    with pytest.raises(quality.PanelIntegrityError):
        quality.require_split_invariants(p.withColumn("target_return_5d", F.lit(None).cast("double")), "2024-01-10")


def test_late_key_acceleration_warns(spark):
    late = [("Z", dt.date(2024, 5, 1) + dt.timedelta(days=i), 10.0, None, None, 5, 0.4, None) for i in range(5)]
    r = quality.check_timestamps(integrity_panel(spark, late), "2025-01-01").first()
    assert (r.status, r.n_violations) == ("WARN", 3)


def test_features_do_not_change_when_the_future_is_removed(spark):
    """Rows up to day D are the same whether or not later data exists (targets aside)."""
    t = Tables(spark, "/root/testdata/sf0.001")
    posts, comments, news, bars, bench, fear = _calendar_inputs(t)
    cut = "2024-01-15"
    kw = dict(start="2024-01-03")
    whole = jobs.calendar_panel(posts, comments, news, bars, bench, fear, end="2024-01-28", **kw)
    before = lambda d: d.where(F.col("date") <= cut)
    part = jobs.calendar_panel(before(posts), before(comments), before(news), before(bars), before(bench), before(fear), end=cut, **kw)
    targets = ["target_return_1d", "target_return_3d", "target_return_5d"]
    keep = [c for c in whole.columns if c not in targets]
    norm = lambda d: {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in before(d).select(*keep).collect()}
    a, b = norm(whole), norm(part)
    assert a and a == b
