"""The three end-to-end jobs: calendar-day panel, pre-open panel, daily scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.functions import signals as sig
from pulsegrid.functions.exprs import ratio
from pulsegrid.models import stumps
from pulsegrid.operators import filters, joins, quality, ranking, rollups, setops, technical as tech, windows


def calendar_market_features(bars: DataFrame, bench: DataFrame, fear: DataFrame) -> DataFrame:
    """Lookback features, regime columns and forward returns of daily bars.

    ``bench`` (date, close) and ``fear`` (date, value) are single daily series; their
    features are computed once and reach the bars by date.
    """
    d = tech.pct_change(bars.select("ticker", "date", "close", "volume"), (1, 20))
    d = tech.rsi_simple(d)
    d = tech.relative_volume(d, 20, 5, 1.0)
    d = tech.ma_distance(d, 20, 10, 0.0, out="dist_from_20ma_pct")
    d = tech.jump_decay(d)
    d = tech.forward_returns(d, (1, 3, 5))
    one = F.lit("series").alias("ticker")
    pct = tech.rolling_percentile(fear.select(one, "date", "value"), "value", out="vix_percentile")
    above = tech.above_average(bench.select(one, "date", "close"), 200, 100, out="spy_above_200ma")
    d = joins.asof_series(d, pct.select("date", "vix_percentile"), "vix_percentile", 0.5)
    d = joins.asof_series(d, above.select("date", "spy_above_200ma"), "spy_above_200ma", 0.0)
    return d.withColumn("regime_score", sig.regime_score())


def calendar_panel(posts: DataFrame, comments: DataFrame, news: DataFrame, bars: DataFrame, bench: DataFrame,
                   fear: DataFrame, *, start: str, end: str, starts: DataFrame | None = None,
                   universe: Sequence[str] | None = None) -> DataFrame:
    """(key, trading day) panel with attention, sentiment, news, market and regime features.

    ``posts`` (post_id, ticker, date, sentiment_score, has_body, num_comments) are one row
    per post and key; ``comments`` carry ``link_id`` and ``score``; ``news`` is one row per
    key and day. All joins share (ticker, date).
    """
    if universe is not None:
        posts, bars, news = (filters.universe(x, universe) for x in (posts, bars, news))
    posts = posts.where("ticker IS NOT NULL")
    market = calendar_market_features(bars, bench, fear)
    grid = joins.key_calendar(bars, bench.where(F.col("date").between(start, end)), starts, start)

    daily = rollups.daily_post_rollup(posts)
    dense = windows.densify(daily, ["count_d", "comments_d", "score_sum_d", "score_cnt_d", "abs_sum_d"], start=_before(start), end=end)
    social = windows.lagged_post_features(dense).withColumnRenamed("avg_sentiment_1d", "vader_sentiment_1d").drop("avg_sentiment_3d")

    per_day = rollups.linked_comment_rollup(comments, posts.select(F.col("post_id").alias("id"), "ticker"))
    dense_c = windows.densify(per_day, ["comment_count_d", "comment_sum_d", "comment_cnt_d"], start=_before(start), end=end)
    talk = windows.lagged_comment_features(dense_c)

    zero = lambda *cs: {c: 0.0 for c in cs}
    p = joins.left_chain(grid, [
        (market, {}),
        (social, zero("post_count_1d", "total_comments_1d", "vader_sentiment_1d", "sentiment_extremity", "sentiment_accel")),
        (talk, zero("comment_count_1d", "comment_sentiment_1d")),
        (news.select("ticker", "date", "news_sentiment_1d", "news_count_1d"), zero("news_sentiment_1d", "news_count_1d")),
    ])
    p = tech.abnormal_attention(p)
    p = filters.sample_weight(filters.split_by_year(p.withColumn("year", F.year("date"))))
    p = p.withColumn("vix_x_volume", sig.fear_volume()).where(F.col("close").isNotNull() & (F.col("volume") > 0))
    return p.select(*schema.PANEL_COLUMNS)


def _before(start: str, days: int = 10) -> str:
    from datetime import date, timedelta

    return (date.fromisoformat(start) - timedelta(days=days)).isoformat()


def preopen_market_features(bars: DataFrame) -> DataFrame:
    """Market features of the pre-open panel: recursive RSI and range, full windows, four horizons."""
    d = tech.pct_change(bars, (1, 5, 20))
    d = tech.rsi_wilder(d)
    d = tech.atr_wilder(d).withColumn("atr_14", F.col("atr_14_norm")).drop("atr_14_norm")
    d = tech.relative_volume(d)
    d = tech.ma_distance(tech.ma_distance(d, 20), 50)
    d = tech.forward_returns(d)
    return d.select("ticker", "date", *schema.INTRADAY_MARKET, *schema.INTRADAY_TARGETS)


def preopen_panel(posts: DataFrame, bars: DataFrame, *, test_start: str, excluded: Sequence[str] = (), min_count=10,
                  max_return=0.5, market_required: Sequence[str] = tuple(schema.INTRADAY_MARKET), days: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Panel of keys with enough posts before the open; returns (panel, drop counts)."""
    best = setops.keep_best(posts, ["post_id", "ticker"], [F.col("sentiment_conf"), F.col("score"), F.col("timestamp")])
    best = filters.universe(best, exclude=list(excluded))
    social = windows.attention_before_open(best, days if days is not None else bars.select("date"), min_count=min_count)
    j = joins.panel_join(social, preopen_market_features(bars))
    tagged = filters.with_drop_reason(j, filters.quality_rules(excluded, min_count, max_return, market=market_required))
    kept = filters.split_by_date(tagged.where("drop_reason IS NULL").drop("drop_reason"), test_start)
    return kept.select(*schema.INTRADAY_COLUMNS), filters.drop_counts(tagged)


def daily_signals(panel: DataFrame, model: DataFrame, base: dict[str, float], features: Sequence[str], *, sectors: DataFrame,
                  events: DataFrame | None = None, pcr: DataFrame | None = None, gate=3, drop: Sequence[str] = (), per_sector=3) -> DataFrame:
    """Score, gate, classify and rank the signals of every day in ``panel``.

    Pass one day for a live run; more days give the same rows per day.
    """
    d = filters.universe(filters.density_gate(panel, gate), exclude=list(drop))
    if events is not None:
        d = joins.clear_of_events(d, events, time="date").drop("next_event")
    s = sig.classify_signals(stumps.add_predictions(d, model, features, base))
    if pcr is not None:
        s = s.join(pcr.select("ticker", "pcr"), "ticker", "left").withColumn("pcr", F.when(F.col("signal") == "BULLISH", F.col("pcr")))
        s = s.withColumns({"pcr_confirmation": sig.put_call_label(), "pcr_size_multiplier": sig.put_call_multiplier()})
    s = joins.with_sector(s, sectors)
    return ranking.cap_per_group(s, [*ranking.side_order(), F.col("ticker")], per_sector)


def checked_panel(panel: DataFrame, cut: str) -> DataFrame:
    """Raise if the split invariants do not hold, else pass the panel on."""
    quality.require_split_invariants(panel, cut)
    return panel


__all__ = ["calendar_panel", "checked_panel", "daily_signals", "preopen_panel", "ratio"]
