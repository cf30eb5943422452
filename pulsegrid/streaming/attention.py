"""Streaming counts, sliding windows, de-duplication and outage alerts over posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_mentions(posts: DataFrame, ts="timestamp", key="ticker", delay="48 hours") -> DataFrame:
    """Tumbling daily counts; late posts count until the watermark passes the day."""
    w = posts.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"), key)
    return w.agg(F.count(F.lit(1)).alias("count"), F.sum("num_comments").alias("comments")).select(
        key, F.to_date("window.start").alias("date"), "count", "comments", "window")


def sliding_attention(posts: DataFrame, days: int, ts="timestamp", key="ticker", delay="48 hours") -> DataFrame:
    """Attention and sentiment over the last ``days`` days, one result per day."""
    w = posts.withWatermark(ts, delay).groupBy(F.window(ts, f"{days} days", "1 day"), key)
    return w.agg(F.count(F.lit(1)).alias("post_count"), F.avg("sentiment_score").alias("avg_sentiment")).select(
        key, F.to_date("window.end").alias("date"), "post_count", "avg_sentiment")


def without_refetches(posts: DataFrame, keys: Sequence[str] = ("post_id", "ticker"), ts="timestamp", delay="48 hours") -> DataFrame:
    """The first copy of each (post, key); state expires with the watermark."""
    return posts.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def outage_alerts(daily: DataFrame, min_posts=3) -> DataFrame:
    """Days on which no key reached ``min_posts`` (second aggregate over closed day windows)."""
    day = daily.groupBy(F.window(F.window_time("window"), "1 day")).agg(F.max("count").alias("max_posts"))
    return day.select(F.to_date("window.start").alias("date"), "max_posts", (F.col("max_posts") < min_posts).alias("skip_day"))
