"""Rank-correlation ("IC") statistics from distributed average ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import clamp, ratio
from pulsegrid.functions.signals import ic_gate
from pulsegrid.functions.special import spearman_p_value
from pulsegrid.operators.ordering import average_rank
from pulsegrid.operators.rollups import unpivot_doubles


def spearman(df: DataFrame, x: str, y: str, group: Sequence[str] = (), *, min_n: int = 20,
             on_small: float | None = None, with_p: bool = False, weight: str | None = None,
             n_buckets: int | None = None) -> DataFrame:
    """M1: Spearman correlation per group with average ranks for ties.

    Fewer than ``min_n`` complete rows give ``on_small``; so does a constant side.
    Equal pairs are counted first and ranks come from bucketed scans, so neither a
    pooled group nor a value shared by many rows ends in one task.
    """
    group = list(group)
    src = df.select(*group, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"),
                    *([weight] if weight else []))
    for c in [*group, "_x", "_y"]:
        src = src.where(F.col(c).isNotNull())
    pairs = src.groupBy(*group, "_x", "_y").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_w"))
    rx = average_rank(pairs, "_x", group, weight="_w", n_buckets=n_buckets).select(*group, "_x", F.col("rank_avg").alias("_rx"))
    ry = average_rank(pairs, "_y", group, weight="_w", n_buckets=n_buckets).select(*group, "_y", F.col("rank_avg").alias("_ry"))
    j = pairs.join(rx, [*group, "_x"]).join(ry, [*group, "_y"])
    return _correlate(j, group, min_n, on_small, with_p)


def _correlate(j: DataFrame, group: list[str], min_n: int, on_small: float | None, with_p: bool) -> DataFrame:
    """Correlation of weighted rank pairs; ranks are centred on their known mean."""
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    sums = [F.sum("_w").alias("n"), F.sum(w * a * b).alias("_sab"), F.sum(w * a * a).alias("_saa"), F.sum(w * b * b).alias("_sbb")]
    g = j.groupBy(*group).agg(*sums) if group else j.agg(*sums)
    m = (F.col("n") + 1) / 2.0  # mean rank, both sides
    cov = F.col("_sab") - F.col("n") * m * m
    va, vb = F.col("_saa") - F.col("n") * m * m, F.col("_sbb") - F.col("n") * m * m
    ic = F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb))
    small = F.lit(on_small).cast("double")
    out = g.select(*group, "n", F.when(F.col("n") < min_n, small).otherwise(F.coalesce(ic, small)).alias("ic"))
    return out.withColumn("p_value", spearman_p_value("ic", F.col("n").cast("double"))) if with_p else out


def grouped_ic(df: DataFrame, x: str, y: str, group: Column, min_n=20, name="period") -> DataFrame:
    """A10: IC per period, null below ``min_n`` rows."""
    return spearman(df.withColumn(name, group), x, y, [name], min_n=min_n)


def ic_moments(ics: DataFrame, ic="ic", group: Sequence[str] = ()) -> DataFrame:
    aggs = [F.count(ic).alias("n_periods"), F.avg(ic).alias("mean_ic"), F.stddev_samp(ic).alias("std_ic")]
    return ics.groupBy(*group).agg(*aggs) if group else ics.agg(*aggs)


def feature_ic_table(df: DataFrame, features: Sequence[str], target: str, group: Sequence[str] = (), min_n=100,
                     with_p: bool = False, n_buckets: int | None = None) -> DataFrame:
    """M2: IC of every feature against the target in one pass (features become rows)."""
    long = unpivot_doubles(df.where(F.col(target).isNotNull()), features, [*group, target])
    return spearman(long, "value", target, [*group, "feature"], min_n=min_n, with_p=with_p, n_buckets=n_buckets)


def mean_abs_ic(table: DataFrame, threshold=0.0846) -> DataFrame:
    """M2: mean |IC| and the pass flag."""
    return table.agg(F.count("ic").alias("n_features"), F.avg(F.abs("ic")).alias("mean_abs_ic")).withColumn(
        "passes", F.col("mean_abs_ic") > threshold)


def compare_scores(df: DataFrame, new: str, old: str, target: str) -> DataFrame:
    """M2: does a new score rank better than the old one (by |IC|)?"""
    t = feature_ic_table(df, [new, old], target)
    return t.agg(
        F.max(F.when(F.col("feature") == new, F.col("ic"))).alias("ic_new"),
        F.max(F.when(F.col("feature") == old, F.col("ic"))).alias("ic_old"),
        F.max("n").alias("n"),
    ).withColumn("improves", F.abs("ic_new") > F.abs("ic_old"))


def rolling_day_ic(df: DataFrame, x: str, y: str, days=30, time="date", min_n=20, threshold=0.03,
                   n_buckets: int | None = None) -> DataFrame:
    """Pooled IC over the previous ``days`` calendar days, today excluded, and its label.

    A row serves the next ``days`` days, a fixed number of copies; days without rows of
    their own are not reported.
    """
    own = df.select(time).distinct()
    spread = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        x, y, F.explode(F.sequence(F.date_add(time, 1), F.date_add(time, days))).alias(time))
    ic = spearman(spread, x, y, [time], min_n=min_n, n_buckets=n_buckets)
    return own.join(ic, time, "left").select(
        time, F.coalesce("n", F.lit(0)).alias("n"), F.col("ic").alias("rolling_ic"),
        F.when(F.col("ic").isNotNull(), F.when(F.col("ic") > threshold, 1).otherwise(0)).alias("regime"))


def last_rows_ic(trades: DataFrame, order: Sequence[Column], pred: str, actual: str, window=60, min_n=10,
                 min_trades=20) -> DataFrame:
    """IC over the last ``window`` trades and its t statistic."""
    total = trades.agg(F.count(F.lit(1)).alias("n_trades"))
    recent = trades.orderBy(*order).limit(window).where(F.col(actual).isNotNull() & (F.col(actual) != 0))
    ic = spearman(recent, pred, actual, min_n=min_n).crossJoin(F.broadcast(total))  # one row
    v = F.when(F.col("n_trades") >= min_trades, F.col("ic"))
    t = v * F.sqrt(F.col("n") - 2.0) / F.sqrt(1 - v * v + 1e-10)
    return ic.select("n_trades", F.col("n").alias("n_valid"), v.alias("rolling_ic"), t.alias("ic_tstat"))


def effective_ic(windows: DataFrame, raw_ic: float | Column, n_test, n_total, annual_trades=60, cost=0.002) -> DataFrame:
    """M6: raw IC times coverage and stability, less the turnover penalty.

    Row counts and the raw IC may be numbers or aggregate expressions over ``windows``.
    """
    penalty = min(max(annual_trades * cost / 252 * 5, 0.0), 0.05)
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    g = windows.agg(
        F.count(F.lit(1)).alias("n_windows"), F.stddev_pop("ic").alias("_sd"), F.avg(F.abs("ic")).alias("_m"),
        as_col(n_test).alias("_k"), as_col(n_total).alias("_t"), as_col(raw_ic).alias("_raw"))
    stab = F.when(F.coalesce(F.col("_m"), F.lit(0.0)) < 1e-6, 0.0).otherwise(clamp(1 - ratio("_sd", "_m"), 0.0, 1.0))
    cov = F.least(F.col("_k") / F.greatest(F.col("_t"), F.lit(1)), F.lit(1.0))
    enough = F.col("n_windows") >= 2
    return g.select(
        "n_windows",
        F.when(enough, F.col("_raw") * cov * stab - penalty).alias("effective_ic"),
        F.when(enough, F.round(cov, 4)).alias("coverage"), F.when(enough, F.round(stab, 4)).alias("stability"),
        F.when(enough, F.lit(round(penalty, 6))).alias("turnover_penalty"))


def regime_gate(windows: DataFrame) -> DataFrame:
    """M7: four gates over window ICs and the verdict."""
    g = windows.where(F.col("ic").isNotNull()).agg(
        F.count("ic").alias("n_windows"), F.avg("ic").alias("mean_ic"),
        F.avg((F.col("ic") > 0).cast("double")).alias("pct_positive"), F.min("ic").alias("worst_ic"),
        F.stddev_pop("ic").alias("ic_std"))
    gates = {
        "gate_mean": F.col("mean_ic") > 0, "gate_sign": F.col("pct_positive") >= 0.60,
        "gate_worst": F.col("worst_ic") > -0.02, "gate_spread": F.col("ic_std") < 0.08,
    }
    g = g.withColumns(gates)
    passed = sum((F.col(c).cast("int") for c in gates), F.lit(0))
    return g.withColumn("verdict", F.when(F.col("n_windows") < 2, "INSUFFICIENT_DATA").when(passed == 4, "ADOPT")
                        .when(passed >= 3, "MARGINAL").otherwise("REJECT"))


def live_ic_monitor(signals: DataFrame, bars: DataFrame, as_of: str, lookback=30, horizon=5, baseline=0.0562,
                    pred="pred", key="ticker", time="date", min_n=5) -> DataFrame:
    """IC of recent predictions against returns realised ``horizon`` rows later."""
    from pulsegrid.operators.joins import with_forward_rows

    lo = F.date_sub(F.lit(as_of).cast("date"), lookback)
    recent = signals.where((F.col(time) >= lo) & (F.col(time) <= F.lit(as_of).cast("date")))
    j = with_forward_rows(recent, bars, (horizon,), key=key, time=time).withColumnRenamed(f"realised_{horizon}d", "_a")
    counts = j.agg(
        F.count(F.lit(1)).alias("n_signals"), F.count("_a").alias("n_completed"),
        F.avg(F.when(F.col("_a").isNotNull(), F.col(pred))).alias("mean_pred_ret"), F.avg("_a").alias("mean_actual_ret"))
    ic = spearman(j, pred, "_a", min_n=min_n).select(F.col("ic").alias("live_ic"))
    return counts.crossJoin(F.broadcast(ic)).select(  # one row each
        "n_signals", "n_completed", (F.col("n_signals") - F.col("n_completed")).alias("n_skipped"), "live_ic",
        ic_gate(F.col("live_ic")).alias("gate"), (F.col("live_ic") - baseline).alias("ic_vs_baseline"),
        "mean_pred_ret", "mean_actual_ret")


def model_gate(ic_combined: DataFrame, ic_market: DataFrame, margin=0.005) -> DataFrame:
    """Does the combined model beat the market-only model by the margin?"""
    a = ic_combined.agg(F.avg("ic").alias("ic_combined"), F.stddev_samp("ic").alias("std_combined"))
    b = ic_market.agg(F.avg("ic").alias("ic_market"))
    return a.crossJoin(F.broadcast(b)).withColumn(
        "adds_value", F.col("ic_combined") - F.col("ic_market") > margin)


def consecutive_red(readings: DataFrame, time="date", gate="gate") -> DataFrame:
    """Two RED readings in a row (one reading per day at most)."""
    prev = F.lag(gate, 1).over(Window.orderBy(time))
    return readings.withColumn("switch", F.coalesce((F.col(gate) == "RED") & (prev == "RED"), F.lit(False)))
