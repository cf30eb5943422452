"""Walk-forward folds on the trading-day index, and fold tables.

Trading days are bounded by the calendar, so their index fits one ordered task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.dates import regime_period
from pulsegrid.functions.exprs import clamp, ratio
from pulsegrid.operators.windows import trading_day_index


def expanding_folds(days: DataFrame, step=63, min_train=252, purge=5, embargo=5, time="date") -> DataFrame:
    """Training from the first day, test windows of ``step`` trading days."""
    idx = trading_day_index(days, time).select((F.col("day_index") - 1).alias("i"), time)
    arr = idx.agg(F.array_sort(F.collect_list(time)).alias("_d"), F.count(F.lit(1)).alias("_n"))
    starts = arr.where(F.col("_n") > min_train + step).select(
        "_d", "_n", F.posexplode(F.sequence(F.lit(min_train), (F.col("_n") - step - 1).cast("int"), F.lit(step))).alias("_k", "_t"))
    train_end = F.col("_t") - embargo - purge
    ok = starts.where(train_end >= min_train // 2)
    at = lambda i: F.get("_d", i.cast("int"))
    f = ok.select(
        (F.col("_k") + 1).alias("fold"), at(F.lit(0)).alias("train_start"), at(train_end).alias("train_end"),
        at(F.col("_t")).alias("test_start"), at(F.least(F.col("_t") + step, F.col("_n") - 1)).alias("test_end"))
    return f.withColumn("regime", regime_period(F.col("test_start")))


def sliding_folds(days: DataFrame, train_years=4, val_months=6, gap_days=21, test_months=6, step_months=6,
                  time="date") -> DataFrame:
    """Fixed-length training, validation, gap and test periods; edges snap to the next trading day."""
    arr = days.select(time).distinct().agg(F.array_sort(F.collect_list(time)).alias("_d"))
    a = arr.withColumns({"_first": F.get("_d", F.lit(0)), "_last": F.element_at("_d", -1)})
    n_max = F.greatest(F.floor(F.months_between("_last", "_first") / step_months) + 1, F.lit(0)).cast("int")
    k = a.withColumn("_k", F.explode(F.sequence(F.lit(0), n_max)))
    k = k.withColumn("_a", F.add_months("_first", F.col("_k") * step_months))
    k = k.withColumn("_te", F.add_months("_a", 12 * train_years))
    k = k.withColumn("_ve", F.add_months("_te", val_months))
    k = k.withColumn("_ts", F.date_add("_ve", gap_days))
    k = k.withColumn("_tx", F.add_months("_ts", test_months)).where(F.col("_tx") <= F.col("_last"))
    def snap(c: str):
        return F.coalesce(F.array_min(F.filter("_d", lambda d: d >= F.col(c))), F.col("_last"))
    f = k.select((F.col("_k") + 1).alias("fold"), snap("_a").alias("train_start"), snap("_te").alias("train_end"),
                 snap("_ve").alias("val_end"), snap("_ts").alias("test_start"), snap("_tx").alias("test_end"))
    return f.withColumn("regime", regime_period(F.col("test_start")))


def fold_returns(panel: DataFrame, folds: DataFrame, value="daily_return", time="date") -> DataFrame:
    """Test and training-window statistics per fold from daily returns (J19 on both periods)."""
    from pulsegrid.operators.joins import in_folds

    y = float(252 ** 0.5)
    def stats(start: str, end: str, prefix: str) -> DataFrame:
        j = in_folds(panel.select(time, value), folds.select("fold", start, end), start, end, time)
        return j.groupBy("fold").agg(
            F.count(value).alias(f"{prefix}_n"), F.sum(value).alias(f"{prefix}_sum"),
            F.count_if(F.col(value) > 0).alias(f"{prefix}_wins"),
            ratio(F.avg(value) * y, F.stddev_samp(value), 0.0).alias(f"{prefix}_sharpe"))
    j = folds.join(stats("test_start", "test_end", "oos"), "fold").join(stats("train_start", "train_end", "is"), "fold")
    return j.select(
        "fold", "train_start", "train_end", "test_start", "test_end", "regime",
        (F.col("oos_sum") * 100).alias("total_return_pct"), F.col("oos_sharpe").alias("sharpe"),
        F.col("is_sharpe"), F.col("oos_wins").alias("wins"), F.col("oos_n").alias("n_trades"),
        ratio("oos_wins", "oos_n", 0.0).alias("win_rate"))


def walk_forward_summary(folds: DataFrame, daily: DataFrame, value="daily_return", bear="bear_2022",
                         dsr: DataFrame | None = None) -> DataFrame:
    """Pooled Sharpe, transfer ratio, share of positive folds and the five gates."""
    y = float(252 ** 0.5)
    g = folds.agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("total_return_pct").alias("avg_return_per_fold"),
        F.avg("win_rate").alias("avg_win_rate"), F.sum("n_trades").alias("total_trades"),
        F.avg("sharpe").alias("_oos"), F.avg(F.when(F.col("is_sharpe") != 0, F.col("is_sharpe"))).alias("_is"),
        F.avg((F.col("total_return_pct") > 0).cast("double")).alias("pct_positive_folds"),
        F.coalesce(F.avg(F.when(F.col("regime") == bear, F.col("total_return_pct"))), F.lit(0.0)).alias("bear_return"))
    p = daily.agg(
        F.when(F.count(value) > 10, ratio(F.avg(value) * y, F.stddev_samp(value), 0.0)).otherwise(0.0).alias("pooled_sharpe"))
    j = g.crossJoin(F.broadcast(p))  # one row each
    if dsr is not None:
        j = j.crossJoin(F.broadcast(dsr.select(F.col("confidence").alias("dsr_confidence"))))
    else:
        j = j.withColumn("dsr_confidence", F.lit(0.0))
    j = j.withColumn("wfe", F.coalesce(clamp(ratio("_oos", "_is"), -2.0, 5.0), F.lit(0.0))).drop("_oos", "_is")
    gates = {
        "g1": F.col("pooled_sharpe") >= 0.8, "g2": F.col("pct_positive_folds") >= 0.60,
        "g3": F.col("bear_return") > -20.0, "g4": F.col("wfe") >= 0.50, "g5": F.col("dsr_confidence") >= 0.95,
    }
    j = j.withColumns(gates)
    overall = F.lit(True)
    for c in gates:
        overall = overall & F.col(c)
    return j.withColumn("overall", overall)
