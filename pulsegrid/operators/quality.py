"""Panel integrity suite, split invariants and feed drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.ic import feature_ic_table
from pulsegrid.operators.rollups import unpivot_doubles
from pulsegrid.operators.technical import by_key
from pulsegrid.session import settle


class PanelIntegrityError(ValueError):
    """A split invariant does not hold."""


def _report(df: DataFrame, check: str, bad: Column, warn: Column | None = None) -> DataFrame:
    """One row (check, status, n_violations) from violation counts."""
    status = F.when(bad > 0, "FAIL")
    if warn is not None:
        status = status.when(warn > 0, "WARN")
    n = bad if warn is None else bad + warn
    return df.select(F.lit(check).alias("check"), status.otherwise("PASS").alias("status"), n.cast("bigint").alias("n_violations"))


def check_future_targets(panel: DataFrame, today: str, buffer_days=7, target="target_return_5d", time="date") -> DataFrame:
    """Check 1: no filled target on a date too recent to have one."""
    recent = F.col(time) >= F.date_sub(F.lit(today).cast("date"), buffer_days)
    filled = F.col(target).isNotNull() & (F.col(target) != 0.0)
    return _report(panel.agg(F.count_if(recent & filled).alias("n")), "1_future_targets", F.col("n"))


def check_return_recomputation(panel: DataFrame, tolerance=0.005, min_rows=25, key="ticker", time="date") -> DataFrame:
    """Check 2: stored 1- and 20-row returns against the closes, on every row."""
    w, whole = by_key(key, time), Window.partitionBy(key)
    def off(col: str, n: int) -> Column:
        prev = F.lag("close", n).over(w)
        return F.when(prev != 0, F.abs(F.col(col) - (F.col("close") - prev) / prev) > tolerance)
    d = panel.select(
        (F.count(F.lit(1)).over(whole) > min_rows).alias("_ok"), F.row_number().over(w).alias("_i"),
        off("returns_1d", 1).alias("_a"), off("returns_20d", 20).alias("_b")).where(F.col("_ok") & (F.col("_i") > 20))
    g = d.agg((F.count_if("_a") + F.count_if("_b")).alias("n"), F.count(F.lit(1)).alias("rows"))
    r = _report(g, "2_return_recomputation", F.col("n"))
    return g.crossJoin(F.broadcast(r)).select(  # one row each
        "check", F.when(F.col("rows") == 0, "WARN").otherwise(F.col("status")).alias("status"), "n_violations")


def check_purge_gap(folds: DataFrame, purge=5, embargo=5) -> DataFrame:
    """Check 3: calendar gap between training end and test start."""
    need = int((purge + embargo) * 1.4)
    g = folds.agg(F.count_if(F.datediff("test_start", "train_end") < need).alias("n"))
    return _report(g, "3_purge_gap", F.col("n"))


def check_target_correlation(panel: DataFrame, features: Sequence[str], target="target_return_5d", high=0.85, mid=0.50,
                             n_buckets: int | None = None) -> DataFrame:
    """Check 4: features whose rank correlation with the target is too good."""
    t = feature_ic_table(panel, features, target, min_n=30, n_buckets=n_buckets)
    a = F.abs(F.coalesce(F.col("ic"), F.lit(0.0)))
    g = t.agg(F.count_if(a > high).alias("bad"), F.count_if((a > mid) & (a <= high)).alias("warn"))
    return _report(g, "4_target_correlation", F.col("bad"), F.col("warn"))


def check_normalisation(panel: DataFrame, features: Sequence[str], min_rows=100) -> DataFrame:
    """Check 5: columns that look min-max or z scaled before they were stored (warning only)."""
    long = unpivot_doubles(panel, features).where("value IS NOT NULL")
    s = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.avg("value").alias("m"), F.stddev_samp("value").alias("sd")).where(F.col("n") >= min_rows)
    unit = (F.col("lo") >= -0.01) & (F.col("hi") <= 1.01) & (F.col("m") > 0.1) & (F.col("m") < 0.9)
    z = (F.abs("m") < 0.05) & (F.col("sd") > 0.9) & (F.col("sd") < 1.1) & (F.abs("lo") < 5) & (F.abs("hi") < 5)
    g = s.agg(F.count_if(unit | z).alias("warn"))
    return _report(g, "5_normalisation", F.lit(0), F.col("warn"))


def check_duplicates(panel: DataFrame, train_end: str, test_start: str, keys=("ticker", "date"), time="date") -> DataFrame:
    """Check 6: repeated keys, and keys on both sides of the split."""
    t = F.col(time)
    per = panel.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max((t <= F.lit(train_end).cast("date"))).alias("_tr"), F.max((t >= F.lit(test_start).cast("date"))).alias("_te"))
    g = per.agg((F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)) + F.count_if(F.col("_tr") & F.col("_te"))).alias("n"))
    return _report(g, "6_duplicates", F.col("n"))


def check_timestamps(panel: DataFrame, today: str, buffer_days=7, new_after_days=60, tolerance=0.001,
                     target="target_return_5d", count="post_count_1d", accel="sentiment_accel", key="ticker",
                     time="date") -> DataFrame:
    """Check 7: filled targets on recent rows with posts (fail); acceleration on the first three
    rows of keys that appear late (warning, W27)."""
    recent = (F.col(time) >= F.date_sub(F.lit(today).cast("date"), buffer_days)) & (F.col(count) > 0)
    a = panel.agg(F.count_if(recent & F.col(target).isNotNull() & (F.col(target) != 0.0)).alias("bad"))
    late = late_key_rows(panel, new_after_days, key=key, time=time)
    b = late.agg(F.count_if(F.abs(accel) > tolerance).alias("warn"))
    return _report(a.crossJoin(F.broadcast(b)), "7_timestamps", F.col("bad"), F.col("warn"))  # one row each


def late_key_rows(panel: DataFrame, new_after_days=60, first_rows=3, key="ticker", time="date") -> DataFrame:
    """The first rows of keys first seen well after the start of the data."""
    first = panel.groupBy(key).agg(F.min(time).alias("first_seen"))
    start = first.agg(F.min("first_seen").alias("_start"))
    late = first.crossJoin(F.broadcast(start)).where(  # one row
        F.col("first_seen") >= F.date_add("_start", new_after_days)).drop("_start")
    d = panel.join(late, key)
    return d.withColumn("row_in_key", F.row_number().over(by_key(key, time))).where(F.col("row_in_key") <= first_rows)


def integrity_suite(panel: DataFrame, folds: DataFrame, features: Sequence[str], suspects: Sequence[str], *, today: str,
                    train_end="2023-12-31", test_start="2024-01-01", n_buckets: int | None = None) -> DataFrame:
    """All seven checks as rows (check, status, n_violations). The panel is written once and read by each."""
    panel = settle(panel, "panel")
    parts = [
        check_future_targets(panel, today), check_return_recomputation(panel), check_purge_gap(folds),
        check_target_correlation(panel, features, n_buckets=n_buckets), check_normalisation(panel, suspects),
        check_duplicates(panel, train_end, test_start), check_timestamps(panel, today),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_invariants(panel: DataFrame, cut: str, target="target_return_5d", time="date", split="split") -> DataFrame:
    """M13 as one row of facts."""
    c = F.lit(cut).cast("date")
    return panel.agg(
        (F.count(target) > 0).alias("has_targets"),
        F.max(F.when(F.col(split) == "train", F.col(time))).alias("max_train"),
        F.min(F.when(F.col(split) == "test", F.col(time))).alias("min_test"),
    ).withColumns({
        "train_ok": F.coalesce(F.col("max_train") < c, F.lit(True)), "test_ok": F.coalesce(F.col("min_test") >= c, F.lit(True)),
    })


def require_split_invariants(panel: DataFrame, cut: str, **kw) -> None:
    """Raise when an invariant is broken (one aggregate row reaches the driver)."""
    r = split_invariants(panel, cut, **kw).first()
    if not r.has_targets:
        raise PanelIntegrityError("no target is filled")
    if not r.train_ok:
        raise PanelIntegrityError(f"training rows reach {r.max_train}, the test period starts {cut}")
    if not r.test_ok:
        raise PanelIntegrityError(f"test rows start {r.min_test}, before {cut}")


def feed_drift(counts: DataFrame, history: DataFrame, as_of: str, reference_growth=0.232, low=0.5, high=2.0,
               mature_days=7, min_posts=3) -> DataFrame:
    """Skip the day on a silent feed; growth alert once the history is mature."""
    g = F.when(F.coalesce(F.col("mention_growth_7d"), F.lit(1.0)) != 1.0, F.col("mention_growth_7d"))
    c = counts.agg(F.coalesce(F.max("post_count_1d"), F.lit(0)).alias("max_posts"), F.avg(g).alias("live_growth"))
    h = history.agg(F.coalesce(F.min("date") <= F.date_sub(F.lit(as_of).cast("date"), mature_days), F.lit(False)).alias("mature"))
    j = c.crossJoin(F.broadcast(h))  # one row each
    skip = F.col("max_posts") < min_posts
    alert = (
        F.when(skip, "NO_POSTS")
        .when(F.col("mature") & (F.col("live_growth") < reference_growth * low), "GROWTH_LOW")
        .when(F.col("mature") & (F.col("live_growth") > reference_growth * high), "GROWTH_HIGH"))
    return j.select("max_posts", "live_growth", "mature", skip.alias("skip_day"), alert.alias("alert"),
                    alert.isNull().alias("clean"))
