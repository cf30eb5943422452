"""Aggregations to (key, date) and small report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import ratio
from pulsegrid.operators.ordering import exact_quantiles


def daily_post_rollup(posts: DataFrame, key="ticker", time="date", score="sentiment_score") -> DataFrame:
    """A1: counts, comments and eligible sentiment sums per key and day.

    A zero score without a body is noise and is left out of the mean (P12).
    """
    s = F.col(score)
    eligible = ~((s == 0.0) & ~F.col("has_body"))
    return posts.groupBy(key, time).agg(
        F.count(F.lit(1)).alias("count_d"),
        F.coalesce(F.sum("num_comments"), F.lit(0)).alias("comments_d"),
        F.coalesce(F.sum(F.when(eligible, s)), F.lit(0.0)).alias("score_sum_d"),
        F.count(F.when(eligible, s)).alias("score_cnt_d"),
        F.coalesce(F.sum(F.abs(s)), F.lit(0.0)).alias("abs_sum_d"),
    )


def daily_comment_rollup(comments: DataFrame, key="ticker", time="date", score="score") -> DataFrame:
    """A2: comment count, and sum and number of non-zero scores."""
    s = F.when(F.col(score) != 0.0, F.col(score))
    return comments.groupBy(key, time).agg(
        F.count(F.lit(1)).alias("comment_count_d"),
        F.coalesce(F.sum(s), F.lit(0.0)).alias("comment_sum_d"),
        F.count(s).alias("comment_cnt_d"),
    )


def linked_comment_rollup(comments: DataFrame, posts: DataFrame, key="ticker", time="date", score="score") -> DataFrame:
    """A2 over J6: comments are summed per post and day first, so a post that holds a large
    share of all comments enters the join as one row per day."""
    from pulsegrid.operators.joins import comments_to_keys

    per_post = daily_comment_rollup(comments, "link_id", time, score)
    linked = comments_to_keys(per_post, posts, key=key)
    return linked.groupBy(key, time).agg(*[F.sum(c).alias(c) for c in ("comment_count_d", "comment_sum_d", "comment_cnt_d")])


def news_daily(articles: DataFrame, key="ticker", epoch="datetime", score="score", source="source") -> DataFrame:
    """A3: article count, mean / max / min score and distinct non-blank sources per UTC day."""
    day = F.to_date(F.timestamp_seconds(epoch)).alias("date")
    return articles.where(F.col(epoch) != 0).groupBy(key, day).agg(
        F.count(F.lit(1)).alias("news_count_1d"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("news_sentiment_1d"),
        F.coalesce(F.max(score), F.lit(0.0)).alias("news_sentiment_max"),
        F.coalesce(F.min(score), F.lit(0.0)).alias("news_sentiment_min"),
        F.count_distinct(F.when(F.col(source) != "", F.col(source))).alias("news_source_count"),
    )


def news_moments(records: DataFrame, key="ticker", time="date", score="score") -> DataFrame:
    """A4: count, mean and sample deviation (single article: 0)."""
    return records.groupBy(key, time).agg(
        F.count(score).alias("news_count_1d"),
        F.avg(score).alias("news_sentiment_1d"),
        F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("news_sentiment_std"),
    )


def tone_daily(articles: DataFrame, key="ticker", time="date", tone="tone", urls="source_urls",
               min_articles=3) -> DataFrame:
    """A5: tone means per key and day with at least ``min_articles``, and distinct source URLs."""
    t = F.col(tone)
    base = articles.groupBy(key, time).agg(
        F.count(F.lit(1)).alias("article_count"),
        F.avg(t).alias("tone_mean"),
        F.coalesce(F.avg(F.when(t > 0, t)), F.lit(0.0)).alias("tone_positive"),
        F.coalesce(F.avg(F.when(t < 0, t)), F.lit(0.0)).alias("tone_negative"),
    ).where(F.col("article_count") >= min_articles)
    src = (
        articles.select(key, time, F.explode(F.split(F.coalesce(F.col(urls), F.lit("")), ";")).alias("_u"))
        .where(F.col("_u") != "")
        .groupBy(key, time).agg(F.count_distinct("_u").alias("source_count"))
    )
    return base.join(src, [key, time], "left").fillna(0, subset=["source_count"])


def tagged_ratio(messages: DataFrame, key="ticker", tag="basic", min_messages=3) -> DataFrame:
    """Net and bullish share of tagged messages; untagged keys read 0 and 0.5."""
    g = messages.groupBy(key).agg(
        F.count(F.lit(1)).alias("st_count_1d"),
        F.count_if(F.col(tag) == "Bullish").alias("_b"),
        F.count_if(F.col(tag) == "Bearish").alias("_s"),
    ).where(F.col("st_count_1d") >= min_messages)
    tot = F.col("_b") + F.col("_s")
    return g.select(
        key, "st_count_1d",
        F.round(ratio(F.col("_b") - F.col("_s"), tot, 0.0), 4).alias("st_sentiment_1d"),
        F.round(ratio(F.col("_b"), tot, 0.5), 4).alias("st_bull_pct"),
    )


def live_counts(posts: DataFrame, key="ticker", title="title", comments="num_comments", score="score") -> DataFrame:
    """Posts, comments, and mean score over posts with a title."""
    titled = F.when(F.trim(F.coalesce(F.col(title), F.lit(""))) != "", F.col(score))
    return posts.groupBy(key).agg(
        F.count(F.lit(1)).alias("post_count_1d"),
        F.coalesce(F.sum(comments), F.lit(0)).alias("total_comments_1d"),
        F.round(F.coalesce(F.avg(titled), F.lit(0.0)), 4).alias("sentiment_1d"),
    )


def put_call_ratio(chain: DataFrame, key="ticker") -> DataFrame:
    """Put over call volume of the nearest expiry; null without call volume.

    Volumes are summed per expiry first, so the earliest expiry is picked from a few
    rows per key.
    """
    v = F.coalesce(F.col("volume"), F.lit(0.0))
    per_expiry = chain.groupBy(key, "expiry").agg(
        F.sum(F.when(F.col("side") == "put", v).otherwise(0.0)).alias("put_volume"),
        F.sum(F.when(F.col("side") == "call", v).otherwise(0.0)).alias("call_volume"),
    )
    best = per_expiry.groupBy(key).agg(
        F.min_by(F.struct("expiry", "put_volume", "call_volume"), "expiry").alias("_n")
    )
    return best.select(key, "_n.*").withColumn("pcr", F.round(ratio("put_volume", "call_volume"), 3))


def coverage(panel: DataFrame, count="post_count_1d", key="ticker") -> DataFrame:
    """Share of days with posts per key."""
    return panel.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_days"),
        (F.avg(F.when(F.col(count) > 0, 1.0).otherwise(0.0)) * 100).alias("coverage_pct"),
    )


def coverage_by_year(panel: DataFrame, value: str, key="ticker", time="date") -> DataFrame:
    return panel.groupBy(F.year(time).alias("year")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(key).alias("n_keys"),
        F.avg(value).alias("mean_value"),
    )


def quartile_returns(panel: DataFrame, feature: str, target: str, q=4, n_buckets: int | None = None) -> DataFrame:
    """Mean target per quantile bucket of a feature (by value, right-closed edges) and
    the contrarian flag (lowest bucket earns more than the highest)."""
    rows = panel.where(F.col(feature).isNotNull() & F.col(target).isNotNull()).select(feature, target)
    names = [f"e{i}" for i in range(1, q)]
    edges = exact_quantiles(rows, feature, [i / q for i in range(1, q)], names=names, n_buckets=n_buckets)
    bucket = F.lit(1)
    for n in names:
        bucket = bucket + F.when(F.col(feature) > F.col(n), 1).otherwise(0)
    per = (
        rows.crossJoin(F.broadcast(edges))  # one row
        .groupBy(bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean_target"))
    )
    ends = per.agg(
        F.min_by("mean_target", "bucket").alias("_first"), F.max_by("mean_target", "bucket").alias("_last")
    )
    return per.crossJoin(F.broadcast(ends)).select(
        "bucket", "n", "mean_target", (F.col("_first") > F.col("_last")).alias("contrarian")
    )


def group_fold_summary(folds: DataFrame) -> DataFrame:
    """Folds, mean return, mean Sharpe and win share per regime."""
    return folds.groupBy("regime").agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.round(F.avg("total_return_pct"), 2).alias("avg_return"),
        F.round(F.avg("sharpe"), 3).alias("avg_sharpe"),
        F.round(F.sum("wins") / F.greatest(F.sum("n_trades"), F.lit(1)), 4).alias("win_rate"),
        F.sum("n_trades").alias("n_trades"),
    )


def trade_summary(trades: DataFrame, pnl="pnl_pct", group: Sequence[str] = ()) -> DataFrame:
    """Number, win rate, mean, total and profit factor (null without losses)."""
    p = F.col(pnl)
    loss = F.sum(F.when(p < 0, p))
    aggs = [
        F.count(F.lit(1)).alias("n_trades"),
        F.avg(F.when(p > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg(p).alias("mean_pnl"),
        F.sum(p).alias("total_pnl"),
        (F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)) / F.nullif(F.abs(loss), F.lit(0.0))).alias("profit_factor"),
    ]
    return trades.groupBy(*group).agg(*aggs) if group else trades.agg(*aggs)


def exit_histogram(trades: DataFrame, reason="exit_reason", hold="hold_days", stop="stop_pct") -> DataFrame:
    """Count, mean hold and mean stop per exit reason."""
    return trades.groupBy(reason).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hold).alias("mean_hold"), F.avg(stop).alias("mean_stop")
    )


def monthly_returns(equity: DataFrame, time="date", value="equity", min_points=2) -> DataFrame:
    """Percent change from first to last value within each calendar month."""
    g = equity.groupBy(F.date_format(time, "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n_points"), F.min_by(value, time).alias("_s"), F.max_by(value, time).alias("_e")
    ).where(F.col("n_points") >= min_points)
    return g.select("month", "n_points", (ratio(F.col("_e") - F.col("_s"), "_s") * 100).alias("return_pct"))


def monthly_pivot(monthly: DataFrame) -> DataFrame:
    """Year by month table."""
    m = monthly.select(
        F.substring("month", 1, 4).cast("int").alias("year"),
        F.substring("month", 6, 2).cast("int").alias("_m"), "return_pct",
    )
    names = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    return m.groupBy("year").agg(
        *[F.max(F.when(F.col("_m") == i + 1, F.col("return_pct"))).alias(n) for i, n in enumerate(names)]
    )


def unpivot_doubles(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = (), name="feature",
                    value="value") -> DataFrame:
    casted = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return casted.unpivot(list(ids), list(columns), name, value)


def null_rates(panel: DataFrame, features: Sequence[str], warn_pct=5.0) -> DataFrame:
    """Percent of nulls per feature, one pass over the table."""
    one = panel.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in features])
    return unpivot_doubles(one, features, value="null_pct").withColumn("warn", F.col("null_pct") > warn_pct)


def target_moments(panel: DataFrame, targets: Sequence[str], outlier=0.20) -> DataFrame:
    """Mean, deviation, population skew and excess kurtosis, shares positive / extreme."""
    long = unpivot_doubles(panel, targets, name="target").where(F.col("value").isNotNull())
    v = F.col("value")
    return long.groupBy("target").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"),
        (F.avg((v > 0).cast("double")) * 100).alias("pct_positive"),
        (F.avg((F.abs(v) > outlier).cast("double")) * 100).alias("pct_outlier"),
    )


def yearly_drift(panel: DataFrame, features: Sequence[str], time="date", sigmas=2.0) -> DataFrame:
    """Years whose mean lies outside mean ± 2 deviations of the yearly means."""
    yearly = unpivot_doubles(panel.withColumn("year", F.year(time)), features, ["year"]).groupBy(
        "feature", "year").agg(F.avg("value").alias("yearly_mean"))
    w = Window.partitionBy("feature")
    sd = F.coalesce(F.nullif(F.stddev_samp("yearly_mean").over(w), F.lit(0.0)), F.lit(1.0))
    return yearly.withColumns({"_mu": F.avg("yearly_mean").over(w), "_sd": sd}).select(
        "feature", "year", "yearly_mean",
        (F.abs(F.col("yearly_mean") - F.col("_mu")) > sigmas * F.col("_sd")).alias("drift"),
    )


def live_drift(live: DataFrame, train: DataFrame, features: Sequence[str], sigmas=3.0) -> DataFrame:
    """Live mean against the training mean in training deviations."""
    def stats(df: DataFrame, fill: bool, *aggs: Column) -> DataFrame:
        long = unpivot_doubles(df, features)
        return (long.fillna(0.0, ["value"]) if fill else long.where("value is not null")).groupBy("feature").agg(*aggs)
    t = stats(train, True, F.avg("value").alias("train_mean"),
              F.greatest(F.stddev_samp("value"), F.lit(1e-6)).alias("train_std"))
    l = stats(live, False, F.avg("value").alias("live_mean"))
    return l.join(t, "feature").withColumn(
        "drift", F.abs(F.col("live_mean") - F.col("train_mean")) > sigmas * F.col("train_std"))


def directional_accuracy(df: DataFrame, pred: str, actual: str, group: Sequence[str] = ()) -> DataFrame:
    """Share of rows where prediction and outcome have the same sign."""
    hit = F.avg(F.when(F.signum(pred) == F.signum(actual), 1.0).otherwise(0.0)).alias("dir_acc")
    rows = df.where(F.col(pred).isNotNull() & F.col(actual).isNotNull())
    agg = [F.count(F.lit(1)).alias("n"), hit]
    return rows.groupBy(*group).agg(*agg) if group else rows.agg(*agg)


def side_accuracy(df: DataFrame, side: str, actual: str) -> DataFrame:
    """A20, side-aware: bearish rows are right when the outcome is negative."""
    ok = F.when(F.col(side) == "BEARISH", F.col(actual) < 0).otherwise(F.col(actual) > 0)
    return df.where(F.col(actual).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(ok.cast("double")), 3).alias("accuracy"))


def score_band(score: Column, band=0.05) -> Column:
    """Right-closed three-way band of a score."""
    return F.when(score <= -band, "BEARISH").when(score <= band, "NEUTRAL").when(score.isNotNull(), "BULLISH")


def label_agreement(df: DataFrame, score: str, label: str, band=0.05) -> DataFrame:
    """Percent of rows whose banded score equals the label."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    same = F.avg((score_band(F.col(score), band) == F.col(label)).cast("double")) * 100
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(same, F.lit(0.0)).alias("agreement_pct"))


def class_balance(panel: DataFrame, flag_col: str, warn_pct=20.0) -> DataFrame:
    """Bull and bear rows and the warning when bears are scarce."""
    g = panel.agg(F.count_if(F.col(flag_col) == 1.0).alias("bull"), F.count_if(F.col(flag_col) == 0.0).alias("bear"))
    pct = ratio(F.col("bear") * 100.0, F.col("bull") + F.col("bear"))
    return g.withColumn("bear_pct", pct).withColumn("warn", F.col("bear_pct") < warn_pct)


def describe_percentiles(df: DataFrame, value: str, group: Sequence[str] = (), probs=(0.01, 0.05, 0.95, 0.99),
                         n_buckets: int | None = None) -> DataFrame:
    """Count, mean, max and exact percentiles, overall or per key."""
    rows = df.where(F.col(value).isNotNull())
    aggs = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max")]
    names = [f"p{round(p * 100):02d}" for p in probs]
    q = exact_quantiles(rows, value, probs, group, names=names, n_buckets=n_buckets)
    if group:
        return rows.groupBy(*group).agg(*aggs).join(q, list(group))
    return rows.agg(*aggs).crossJoin(F.broadcast(q))


def run_funnel(posts: DataFrame, counts: DataFrame, signals: DataFrame, gate=3) -> DataFrame:
    """Posts, keys found, keys over the gate, signals and opens of a run (one row)."""
    parts = [
        posts.agg(F.count(F.lit(1)).alias("total_posts")),
        counts.agg(F.count(F.lit(1)).alias("keys_found"),
                   F.count_if(F.col("post_count_1d") >= gate).alias("keys_passing")),
        signals.agg(F.count(F.lit(1)).alias("n_signals"), F.count_if(F.col("action") == "OPEN").alias("n_opens")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def frozen_features(df: DataFrame, features: Sequence[str], key="ticker") -> DataFrame:
    """Features with a single distinct rounded value per key."""
    long = unpivot_doubles(df, features, [key]).where("value is not null")
    return long.groupBy(key, "feature").agg(
        F.count_distinct(F.round("value", 4)).alias("n_values")
    ).withColumn("frozen", F.col("n_values") == 1)


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall and support per class, from label/prediction counts."""
    cells = df.groupBy(F.col(label).alias("_l"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    side = cells.select(F.explode(F.array(
        F.struct(F.col("_l").alias("c"), F.col("_n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("_l") == F.col("_p"), F.col("_n")).otherwise(0).alias("tp")),
        F.struct(F.col("_p").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("_n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("tp")),
    )).alias("_s")).select("_s.*")
    g = side.groupBy(F.col("c").alias("class")).agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    return g.select("class", "support", "predicted", ratio("tp", "predicted", 0.0).alias("precision"),
                    ratio("tp", "support", 0.0).alias("recall"))


def trading_summary(daily: DataFrame, initial: float, time="date", value="portfolio_value",
                    ret="daily_return", benchmark: DataFrame | None = None) -> DataFrame:
    """Days, first, last, total return, Sharpe with population deviation, alpha."""
    g = daily.agg(
        F.count(F.lit(1)).alias("n_days"), F.min(time).alias("start_date"), F.max(time).alias("end_date"),
        F.max_by(value, time).alias("final_value"), F.avg(ret).alias("_m"), F.stddev_pop(ret).alias("_s"),
    )
    g = g.withColumn("total_return", F.col("final_value") / initial - 1).withColumn(
        "sharpe_ratio", ratio(F.col("_m") * (252 ** 0.5), "_s", 0.0)).drop("_m", "_s")
    if benchmark is not None:
        g = g.crossJoin(F.broadcast(benchmark)).withColumn("alpha", F.col("total_return") - F.col("benchmark_return"))
    return g


def period_return(series: DataFrame, time="date", value="close", start=None, end=None, out="benchmark_return") -> DataFrame:
    """Last over first value of a series within the period, minus one."""
    s = series.where(F.col(value).isNotNull())
    if start is not None:
        s = s.where(F.col(time) >= F.lit(start).cast("date"))
    if end is not None:
        s = s.where(F.col(time) < F.lit(end).cast("date"))
    return s.agg((F.max_by(value, time) / F.min_by(value, time) - 1).alias(out))


def closed_trade_report(trades: DataFrame, tol=1e-4) -> DataFrame:
    """Cost, dollar result and WIN / LOSS / ZERO per closed trade."""
    p = F.col("pnl_pct")
    return trades.select(
        "*",
        F.round(F.col("n_shares") * F.col("entry_price"), 2).alias("cost_basis"),
        F.round(F.col("n_shares") * (F.col("exit_price") - F.col("entry_price")), 2).alias("pnl_dollars"),
        (F.abs(p) > tol).alias("has_real_pnl"),
        F.when(p > tol, "WIN").when(p < -tol, "LOSS").otherwise("ZERO").alias("result"),
    )


def closed_trade_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if("has_real_pnl").alias("n_real"),
        F.sum("pnl_dollars").alias("total_pnl_dollars"))


def action_summary(runs: DataFrame, time="date", actions="actions") -> DataFrame:
    """Opens, closes and skip reason per day from an array of action strings."""
    a = F.col(actions)
    def n(prefix: str) -> Column:
        return F.size(F.filter(a, lambda x: x.startswith(prefix))).cast("bigint")
    return runs.select(
        time, n("OPEN").alias("opens"), n("CLOSE").alias("closes"),
        F.get(F.filter(a, lambda x: x.startswith("SKIP")), F.lit(0)).alias("skip_reason"),
    )


def action_totals(summary: DataFrame) -> DataFrame:
    return summary.groupBy("skip_reason").agg(
        F.count(F.lit(1)).alias("n_days"), F.sum("opens").alias("opens"), F.sum("closes").alias("closes"))


def fold_stability(folds: DataFrame) -> DataFrame:
    """Spread of fold Sharpes, robustness flags, early-half against late-half transfer.

    The fold table has one row per test window, so ordering it is cheap.
    """
    f = folds.withColumn("wfe", F.when(F.abs("is_sharpe") > 1e-6, F.col("sharpe") / F.col("is_sharpe")))
    valid = F.when(F.col("wfe").isNotNull(), F.col("fold"))
    ordered = f.withColumns({
        "_i": F.count(valid).over(Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)),
        "_n": F.count(valid).over(Window.partitionBy()),
    })
    half = F.floor(F.col("_n") / 2)
    g = ordered.agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.stddev_pop("sharpe").alias("sharpe_std"),
        F.min_by("fold", F.struct("sharpe", "fold")).alias("worst_fold"),
        F.max_by("fold", F.struct(F.col("sharpe"), -F.col("fold"))).alias("best_fold"),
        (F.min("sharpe") > 0).alias("all_positive"),
        (F.min("sharpe") < -0.5).alias("fragile"),
        F.avg(F.when(F.col("_i") <= half, F.col("wfe"))).alias("early_wfe"),
        F.avg(F.when(F.col("_i") > half, F.col("wfe"))).alias("late_wfe"),
        F.avg("wfe").alias("mean_wfe"), F.stddev_pop("wfe").alias("std_wfe"),
    )
    return g.withColumn(
        "status", F.when(F.col("sharpe_std") > 0.5, "HIGH_VARIANCE").when(F.col("fragile"), "FRAGILE").otherwise("STABLE")
    ).withColumn(
        "trend", F.when(F.col("late_wfe") < F.col("early_wfe") - 0.3, "LOSING_EDGE")
        .when(F.col("mean_wfe").between(0.5, 2.5) & (F.col("std_wfe") < 1.5), "STABLE").otherwise("NONE"))
