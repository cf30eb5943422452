"""Selections, report orders and universe staging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.signals import composite_score
from pulsegrid.operators.setops import top_per_group


# --- W24 / X1: selectors as (predicate, score) ---------------------------------------------

def select_per_day(panel: DataFrame, score: Column, where: Column | None = None, k=3, time="date", key="ticker") -> DataFrame:
    """Best ``k`` keys of each day by a score expression, ties by key."""
    d = panel.where(where) if where is not None else panel
    d = d.withColumn("score", score).where(F.col("score").isNotNull())
    return top_per_group(d, [time], k, [F.col("score").desc(), F.col(key)])


def by_mention_growth(panel: DataFrame, k=3, min_count=10) -> DataFrame:
    return select_per_day(panel, F.col("mention_growth_1d"), F.col("post_count_1d") >= min_count, k)


def by_weighted_sentiment(panel: DataFrame, k=3, min_count=10) -> DataFrame:
    ok = (F.col("post_count_1d") >= min_count) & (F.col("avg_sentiment_1d") > 0)
    return select_per_day(panel, F.col("weighted_sentiment"), ok, k)


def by_upvotes_with_volume(panel: DataFrame, k=3, min_count=5, min_volume=1.5, min_growth=0.3) -> DataFrame:
    ok = ((F.col("post_count_1d") >= min_count) & (F.col("relative_volume") >= min_volume)
          & (F.col("mention_growth_1d") >= min_growth))
    return select_per_day(panel, F.col("total_upvotes_1d"), ok, k)


def cap_per_group(signals: DataFrame, order: Sequence[Column], k=3, group=("date", "sector"), sector="sector",
                  exempt=("Index", "Unknown")) -> DataFrame:
    """At most ``k`` signals per sector and day in rank order; exempt sectors are not capped."""
    w = Window.partitionBy(*group).orderBy(*order)
    free = signals.where(F.col(sector).isin(list(exempt)))
    capped = signals.where(~F.col(sector).isin(list(exempt))).withColumn("_i", F.row_number().over(w)).where(
        F.col("_i") <= k).drop("_i")
    return capped.unionByName(free)


def side_order(side="signal", value="pred_5d") -> list[Column]:
    """O1: bullish by value, neutral by size, bearish from the lowest."""
    v, s = F.col(value), F.col(side)
    rank = F.when(s == "BULLISH", 0).when(s == "NEUTRAL", 1).otherwise(2)
    inner = F.when(s == "BULLISH", -v).when(s == "NEUTRAL", -F.abs(v)).otherwise(v)
    return [rank.asc(), inner.asc()]


def latest_day(df: DataFrame, time="date") -> DataFrame:
    last = df.agg(F.max(time).alias(time))
    return df.join(F.broadcast(last), time, "left_semi")  # one row


def latest_signals(log: DataFrame, side="signal", value="pred_5d", time="date", key="ticker") -> DataFrame:
    """O1: signals of the latest day in report order, with their position (a day holds at most
    one signal per key)."""
    d = latest_day(log, time)
    return d.withColumn("position", F.row_number().over(Window.partitionBy(time).orderBy(*side_order(side, value), F.col(key))))


def top_composite(log: DataFrame, n=5, time="date", key="ticker") -> DataFrame:
    """O2: best ``n`` of the latest day by composite score."""
    d = latest_day(log, time).withColumn("composite_score", composite_score())
    return d.orderBy(F.col("composite_score").desc(), key).limit(n)


def top_predictions(log: DataFrame, n=10, value="pred_5d", tie: Sequence[str] = ("id",)) -> DataFrame:
    """O3."""
    return log.orderBy(F.col(value).desc(), *tie).limit(n)


def last_n(df: DataFrame, n: int, order="id") -> DataFrame:
    """Newest ``n`` rows, oldest first."""
    return df.orderBy(F.col(order).desc()).limit(n).orderBy(order)


def best_row(df: DataFrame, by: str, label: str, lowest=False) -> DataFrame:
    """The row label with the highest (lowest) value; ties go to the smallest label."""
    pick = F.min_by(label, F.struct(by, label)) if lowest else F.max_by(label, F.struct(F.col(by), -F.col(label)))
    return df.agg(pick.alias(label), (F.min(by) if lowest else F.max(by)).alias(by))


def first_keys(df: DataFrame, n: int, key="ticker") -> DataFrame:
    """Rows of the first ``n`` keys in order (debug)."""
    return df.join(df.select(key).distinct().orderBy(key).limit(n), key, "left_semi")


def first_rows(df: DataFrame, n=1000, order: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows (debug)."""
    return (df.orderBy(*order) if order else df).limit(n)


# --- W28, M28: universe discovery and staging ----------------------------------------------

def promote_candidates(counts: DataFrame, as_of: str, min_mentions=8, min_days=3, max_age=14, max_gap=3, key="symbol",
                       time="date", count="n_mentions") -> DataFrame:
    """Symbols whose last ``min_days`` qualifying days lie close together."""
    day = F.lit(as_of).cast("date")
    q = counts.where((F.col(count) >= min_mentions) & F.col(time).between(F.date_sub(day, max_age), day))
    w = Window.partitionBy(key).orderBy(F.col(time).desc())
    r = q.select(key, time, F.row_number().over(w).alias("_i"), F.datediff(F.lag(time, 1).over(w), F.col(time)).alias("_gap"))
    g = r.where(F.col("_i") <= min_days).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_days"), F.max("_gap").alias("max_gap"), F.max(time).alias("last_day"))
    return g.where((F.col("n_days") >= min_days) & (F.col("max_gap") <= max_gap))


def price_eligibility(bars: DataFrame, etfs: Sequence[str] = (), min_price=5.0, min_history=252, min_dollar_volume=1e7,
                      window=20, key="ticker", time="date") -> DataFrame:
    """M28 stage 2: price, history, dollar volume and ETF gates; first failing gate as reason."""
    w = Window.partitionBy(key).orderBy(F.col(time).desc())
    d = bars.select(key, time, "close", "volume", F.row_number().over(w).alias("_i"))
    g = d.groupBy(key).agg(
        F.max_by("close", time).alias("price"), F.count(F.lit(1)).alias("history_days"),
        F.avg(F.when(F.col("_i") <= window, F.col("close") * F.col("volume"))).alias("_adv"))
    adv = F.when(F.col("history_days") >= window, F.col("_adv")).otherwise(0.0)
    reason = (
        F.when(F.col("price") < min_price, "price_too_low").when(F.col("history_days") < min_history, "insufficient_history")
        .when(adv < min_dollar_volume, "low_dollar_volume").when(F.col(key).isin(list(etfs)), "is_etf"))
    return g.select(key, "price", "history_days", adv.alias("avg_dollar_vol"), reason.isNull().alias("passes"),
                    reason.alias("fail_reason"))


def active_mentions(counts: DataFrame, as_of: str, days=7, min_posts=3, min_days=3, core: Sequence[str] = (),
                    key="ticker", time="date", count="post_count") -> DataFrame:
    """M28 stage 1: keys outside the universe with enough active days."""
    day = F.lit(as_of).cast("date")
    d = counts.where((F.col(time) >= F.date_sub(day, days)) & (F.col(time) <= day) & ~F.col(key).isin(list(core)))
    return d.groupBy(key).agg(
        F.sum(count).alias("post_count_7d"), F.count_if(F.col(count) >= min_posts).alias("active_days"),
    ).withColumn("sustained", F.col("active_days") >= min_days)


def universe_stage(mentions: DataFrame, eligible: DataFrame, watch: DataFrame, candidates: DataFrame, as_of: str,
                   watch_days=7, probation_days=30, min_ic=0.010, key="ticker") -> DataFrame:
    """Stage of every key seen in mentions, the watchlist or on probation."""
    e = eligible.select(key, "passes", "fail_reason")
    w = watch.select(key, F.col("promoted_date").alias("_watched"))
    c = candidates.select(key, "days_observed", "avg_ic")
    j = mentions.select(key, "sustained").join(w, key, "full_outer").join(c, key, "full_outer").join(e, key, "left")
    ok = F.coalesce(F.col("passes"), F.lit(False))
    old = F.col("_watched") <= F.date_sub(F.lit(as_of).cast("date"), watch_days)
    done = F.col("days_observed") >= probation_days
    stage = (
        F.when(F.col("days_observed").isNotNull() & done & (F.col("avg_ic") >= min_ic), "PROMOTED")
        .when(F.col("days_observed").isNotNull() & done, "DEMOTED")
        .when(F.col("days_observed").isNotNull(), "PROBATION")
        .when(F.col("_watched").isNotNull() & old & ok, "PROBATION_START")
        .when(F.col("_watched").isNotNull() & old, "REMOVED")
        .when(F.col("_watched").isNotNull(), "WATCHLIST")
        .when(F.col("sustained") & ok, "WATCHLIST_ADD")
        .when(F.col("sustained"), "INELIGIBLE").otherwise("MONITORING"))
    return j.select(key, stage.alias("stage"), "fail_reason", "days_observed", "avg_ic")
