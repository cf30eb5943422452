"""Backward-looking attention and sentiment windows over posts, and calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import ratio
from pulsegrid.operators.technical import by_key, trailing

HOUR = 3600


# --- W1-W3: hours before the market open -------------------------------------------------

def market_time_utc(day: Column, hh_mm: str = "09:30", zone: str = "America/New_York") -> Column:
    """UTC instant of a local wall-clock time on a date, daylight saving included."""
    local = F.to_timestamp(F.concat(day.cast("string"), F.lit(f" {hh_mm}:00")))
    return F.to_utc_timestamp(local, zone)


def hourly_sentiment_cells(posts: DataFrame, key="ticker", ts="timestamp", min_confidence=0.8) -> DataFrame:
    """Posts folded to one row per (key, hour starting at half past).

    Every cutoff lies on a half-hour mark, so whole cells are inside or outside each
    window; the raw posts are shuffled once, already reduced.
    """
    s, up = F.col("sentiment_score"), F.greatest(F.col("score"), F.lit(0)).cast("double")
    hc = F.col("sentiment_conf") >= min_confidence
    cell = (F.floor((F.unix_timestamp(F.col(ts).cast("timestamp")) - HOUR // 2) / HOUR)).alias("cell")
    return posts.groupBy(key, cell).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("post_id").alias("n_posts"),
        F.sum("score").cast("double").alias("upvotes"),
        F.sum("num_comments").cast("double").alias("comments"),
        F.count(s).alias("n_s"),
        F.sum(s).alias("sum_s"),
        F.sum(s * s).alias("sum_s2"),
        F.sum(s * F.log1p(up)).alias("sum_sw"),
        F.count_if(F.col("sentiment_label") == "positive").alias("n_pos"),
        F.count(F.when(hc, s)).alias("n_hc"),
        F.sum(F.when(hc, s)).alias("sum_hc"),
    )


def attention_before_open(
    posts: DataFrame,
    trading_days: DataFrame,
    *,
    key="ticker",
    ts="timestamp",
    time="date",
    min_count=10,
    min_confidence=0.8,
    hours=(24, 72, 168),
) -> DataFrame:
    """24 h / 72 h / 168 h windows that end strictly before 09:30 New York.

    ``posts`` must hold one row per (post, key) (see ``keep_best``). Null sentiment
    stays out of means but counts in the denominators of the weighted score and the
    positive share.
    """
    cells = hourly_sentiment_cells(posts, key, ts, min_confidence)
    start = (F.col("cell") * HOUR + HOUR // 2).alias("start")
    longest = max(hours)
    first_day = F.to_date(F.timestamp_seconds("start"))
    spread = cells.select("*", start).withColumn(
        time, F.explode(F.sequence(first_day, F.date_add(first_day, longest // 24 + 1)))
    )
    days = trading_days.select(time).distinct().withColumn(
        "cutoff", F.unix_timestamp(market_time_utc(F.col(time)))
    )
    j = spread.join(days, time).where(
        (F.col("start") < F.col("cutoff")) & (F.col("start") >= F.col("cutoff") - longest * HOUR)
    )
    d1, d3, d7 = (F.col("start") >= F.col("cutoff") - h * HOUR for h in hours)

    def total(c: str, cond: Column) -> Column:
        return F.sum(F.when(cond, F.col(c)))

    g = j.groupBy(key, time).agg(
        total("n", d1).alias("n1"), total("n", d3).alias("n3"), total("n", d7).alias("n7"),
        total("n_posts", d1).alias("uniq"),
        total("upvotes", d1).alias("total_upvotes_1d"),
        total("comments", d1).alias("total_comments_1d"),
        total("n_s", d1).alias("ns1"), total("sum_s", d1).alias("s1"), total("sum_s2", d1).alias("ss1"),
        total("n_s", d3).alias("ns3"), total("sum_s", d3).alias("s3"),
        total("sum_sw", d1).alias("sw1"), total("n_pos", d1).alias("pos1"),
        total("n_hc", d1).alias("nh1"), total("sum_hc", d1).alias("sh1"),
    ).where(F.col("n1") >= min_count)
    m1, m3 = ratio("s1", "ns1"), ratio("s3", "ns3")
    var = (F.col("ss1") - F.col("s1") * F.col("s1") / F.col("ns1")) / (F.col("ns1") - 1)
    return g.select(
        key, time,
        F.col("n1").alias("post_count_1d"),
        F.col("n3").alias("post_count_3d"),
        F.col("n7").alias("post_count_7d"),
        F.col("uniq").alias("unique_posts_1d"),
        "total_upvotes_1d", "total_comments_1d",
        (F.col("n1") / (F.col("n3") + 1)).alias("mention_growth_1d"),
        (F.col("n1") / (F.col("n7") + 1)).alias("mention_growth_7d"),
        m1.alias("avg_sentiment_1d"),
        m3.alias("avg_sentiment_3d"),
        F.when(F.col("ns1") > 0, F.col("sw1") / F.col("n1")).alias("weighted_sentiment"),
        F.when(F.col("ns1") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("sentiment_std"),
        (m1 - m3).alias("sentiment_accel"),
        (F.col("pos1") / F.col("n1")).alias("bullish_ratio"),
        ratio("sh1", "nh1").alias("avg_sentiment_hc"),
    )


# --- W4, W5, J5: calendar-day windows shifted by one --------------------------------------

def calendar(df: DataFrame, time="date", start: str | None = None, end: str | None = None) -> DataFrame:
    """Every calendar day between the given bounds (default: those of the data)."""
    lo = F.lit(start).cast("date") if start else F.min(time)
    hi = F.lit(end).cast("date") if end else F.max(time)
    return df.agg(lo.alias("_lo"), hi.alias("_hi")).select(
        F.explode(F.sequence("_lo", "_hi")).alias(time)
    )


def densify(daily: DataFrame, values: list[str], key="ticker", time="date", start: str | None = None,
            end: str | None = None, fill: float = 0.0) -> DataFrame:
    """One row per key and calendar day, gaps filled with ``fill``."""
    lo = F.lit(start).cast("date") if start else F.min(time)
    hi = F.lit(end).cast("date") if end else F.max(time)
    bounds = daily.agg(lo.alias("_lo"), hi.alias("_hi"))
    keys = daily.select(key).distinct()
    grid = keys.crossJoin(F.broadcast(bounds)).select(  # bounds: one row
        key, F.explode(F.sequence("_lo", "_hi")).alias(time)
    )
    return grid.join(daily.select(key, time, *values), [key, time], "left").fillna(fill, subset=values)


def lagged_post_features(daily: DataFrame, key="ticker", time="date") -> DataFrame:
    """Day T-1 counts and sentiment, and the [T-3, T-1] mean as a ratio of sums."""
    w = by_key(key, time)
    w3 = trailing(3, key, time, include_current=False)
    prev = {c: F.lag(c, 1).over(w) for c in ("count_d", "comments_d", "score_sum_d", "score_cnt_d", "abs_sum_d")}
    d = daily.withColumns({f"_{c}": e for c, e in prev.items()}).withColumns({
        "_s3": F.sum("score_sum_d").over(w3), "_c3": F.sum("score_cnt_d").over(w3),
    })
    m1 = ratio("_score_sum_d", "_score_cnt_d", 0.0)
    m3 = ratio("_s3", "_c3", 0.0)
    return d.select(
        key, time,
        F.col("_count_d").alias("post_count_1d"),
        F.col("_comments_d").alias("total_comments_1d"),
        m1.alias("avg_sentiment_1d"),
        m3.alias("avg_sentiment_3d"),
        ratio("_abs_sum_d", "_count_d", 0.0).alias("sentiment_extremity"),
        (m1 - m3).alias("sentiment_accel"),
    )


def lagged_comment_features(daily: DataFrame, key="ticker", time="date") -> DataFrame:
    w = by_key(key, time)
    return daily.select(
        key, time,
        F.lag("comment_count_d", 1).over(w).alias("comment_count_1d"),
        ratio(F.lag("comment_sum_d", 1).over(w), F.lag("comment_cnt_d", 1).over(w), 0.0).alias("comment_sentiment_1d"),
    )


def mention_growth(history: DataFrame, count="count", key="ticker", time="date") -> DataFrame:
    """Growth against yesterday and a week ago; a missing day counts as today's value."""
    days = Window.partitionBy(key).orderBy(F.datediff(F.col(time), F.lit("1970-01-01").cast("date")))
    def at(n: int) -> Column:
        past = F.max(count).over(days.rangeBetween(-n, -n))
        return F.greatest(F.coalesce(past, F.col(count)), F.lit(1))
    return history.withColumns({
        "mention_growth_1d": F.col(count) / at(1), "mention_growth_7d": F.col(count) / at(7),
    })


# --- W36: trading-day arithmetic ----------------------------------------------------------

def trading_day_index(days: DataFrame, time="date") -> DataFrame:
    """Numbered distinct trading days. One row per calendar day at most, so one task is enough."""
    d = days.select(time).distinct()
    return d.withColumn("day_index", F.row_number().over(Window.orderBy(time)))


def shift_trading_days(dates: DataFrame, days: DataFrame, n: int, time="date", out="shifted") -> DataFrame:
    """The ``n``-th trading day strictly after (n > 0) or before (n < 0) each date, and
    whether the date itself trades."""
    idx = trading_day_index(days, time)
    # position of each calendar date among trading days: as-of fill on the calendar
    asof = trading_days_asof(dates.select(time).distinct(), idx, time)
    base = asof.withColumn(
        "_want",
        F.col("last_index") + n if n > 0 else
        F.col("last_index") + n + F.when(F.col("is_trading_day"), 0).otherwise(1),
    )
    look = idx.select(F.col(time).alias(out), F.col("day_index").alias("_want"))
    res = base.join(look, "_want", "left").select(time, "is_trading_day", out)
    return dates.join(res, time, "left")


def trading_days_asof(dates: DataFrame, idx: DataFrame, time="date") -> DataFrame:
    """Last trading-day number at or before each date (0 before the first one)."""
    both = dates.withColumn("day_index", F.lit(None).cast("int")).withColumn("_probe", F.lit(True)).unionByName(
        idx.select(time, F.col("day_index").cast("int")).withColumn("_probe", F.lit(False))
    )
    merged = both.groupBy(time).agg(F.max("day_index").alias("day_index"), F.max("_probe").alias("_probe"))
    w = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return merged.select(
        time, "_probe",
        F.col("day_index").isNotNull().alias("is_trading_day"),
        F.coalesce(F.max("day_index").over(w), F.lit(0)).alias("last_index"),
    ).where("_probe").drop("_probe")
