"""Projections, predicates and null handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import clamp
from pulsegrid.operators.ordering import exact_quantiles
from pulsegrid.schema import SAMPLE_WEIGHTS


def universe(df: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] = (), key="ticker") -> DataFrame:
    """P1 for configured lists: pushed to the scan as IN predicates."""
    if include is not None:
        df = df.where(F.col(key).isin(list(include)))
    return df.where(~F.col(key).isin(list(exclude))) if exclude else df


def universe_table(df: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None, key="ticker") -> DataFrame:
    """P1 for list tables: semi and anti joins."""
    if include is not None:
        df = df.join(include.select(key).distinct(), key, "left_semi")
    if exclude is not None:
        df = df.join(exclude.select(key).distinct(), key, "left_anti")
    return df


def density_gate(df: DataFrame, gate=5, count="post_count_1d") -> DataFrame:
    """Rows with enough posts."""
    return df.where(F.col(count) >= gate)


def density_share(df: DataFrame, gate=5, count="post_count_1d", group="split") -> DataFrame:
    """Rows, retained rows and retained share per split."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(count) >= gate).alias("n_kept"),
        F.avg(F.when(F.col(count) >= gate, 1.0).otherwise(0.0)).alias("kept_share"))


def with_drop_reason(df: DataFrame, rules: Sequence[tuple[str, Column]], out="drop_reason") -> DataFrame:
    """Name of the first failing rule, null where the row is kept."""
    expr = None
    for name, fails in rules:
        expr = F.when(fails, name) if expr is None else expr.when(fails, name)
    return df.withColumn(out, expr)


def drop_counts(tagged: DataFrame, reason="drop_reason") -> DataFrame:
    return tagged.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias(reason)).agg(F.count(F.lit(1)).alias("n"))


def quality_rules(excluded: Sequence[str], min_count=10, max_return=0.5, target="target_return_5d",
                  market: Sequence[str] = (), key="ticker", count="post_count_1d") -> list[tuple[str, Column]]:
    """P3 rule order: excluded key, low count, no target, extreme target, missing market data."""
    missing = F.lit(False)
    for c in market:
        missing = missing | F.col(c).isNull()
    return [
        ("excluded", F.col(key).isin(list(excluded))),
        ("low_count", F.col(count) < min_count),
        ("null_target", F.col(target).isNull()),
        ("extreme_target", F.abs(F.col(target)) > max_return),
        ("null_market", missing),
    ]


def comment_rules(bots: Sequence[str], author="author", body="body") -> list[tuple[str, Column]]:
    """Bot authors first, then empty or removed bodies."""
    b = F.trim(F.coalesce(F.col(body), F.lit("")))
    return [
        ("bot", F.trim(F.coalesce(F.col(author), F.lit(""))).isin(list(bots))),
        ("empty", b.isin("", "[removed]", "[deleted]")),
    ]


# fixed values: accounts whose comments are automated
KNOWN_BOTS = [
    "VisualMod", "AutoModerator", "WSBVoteBot", "BotDefense", "anti-gif-bot", "RepostSleuthBot",
    "RemindMeBot", "SaveVideo", "transcribersofreddit", "sneakpeekbot",
]


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """P4."""
    return df.dropna(subset=list(subset))


def drop_extremes(df: DataFrame, column: str, limit=0.5) -> DataFrame:
    """P5: rows beyond the limit are dropped, not clipped."""
    return df.where(F.abs(F.col(column)) <= limit)


def from_listing_date(df: DataFrame, starts: DataFrame, default_start: str, end: str | None = None,
                      key="ticker", time="date", start_col="start_date") -> DataFrame:
    """Rows from each key's first day (default: the global start) up to the global end."""
    j = df.join(starts.select(key, start_col), key, "left")
    lo = F.greatest(F.coalesce(F.col(start_col), F.lit(default_start).cast("date")), F.lit(default_start).cast("date"))
    j = j.where(F.col(time) >= lo)
    if end:
        j = j.where(F.col(time) <= F.lit(end).cast("date"))
    return j.drop(start_col)


def split_by_date(df: DataFrame, cut: str, time="date", out="split") -> DataFrame:
    """P7, two-way."""
    return df.withColumn(out, F.when(F.col(time) < F.lit(cut).cast("date"), "train").otherwise("test"))


def split_by_year(df: DataFrame, train_to=2023, test_to=2025, time="date", out="split") -> DataFrame:
    """P7, three-way."""
    y = F.year(time)
    return df.withColumn(out, F.when(y <= train_to, "train").when(y <= test_to, "test").otherwise("live"))


def sample_weight(df: DataFrame, weights: dict[int, float] | None = None, time="date", out="sample_weight") -> DataFrame:
    """Weight of the row's year."""
    m = F.create_map(*[F.lit(x) for kv in (weights or SAMPLE_WEIGHTS).items() for x in kv])
    return df.withColumn(out, F.coalesce(F.try_element_at(m, F.year(time)), F.lit(1.0)))


def canonical_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Known columns in order, the others after them."""
    known = [c for c in order if c in df.columns]
    return df.select(*known, *[c for c in df.columns if c not in set(known)])


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def normalise_posts(raw: DataFrame) -> DataFrame:
    """P10: canonical post records."""
    ts = F.timestamp_seconds(F.coalesce(F.col("created_utc"), F.lit(0)))
    return raw.select(
        F.col("id").cast("string").alias("id"), "subreddit",
        F.when(_text("author").isin("[deleted]", ""), "deleted").otherwise(F.trim("author")).alias("author"),
        F.trim(_text("title")).alias("title"),
        F.when(_text("selftext").isin("[removed]", "[deleted]"), "").otherwise(F.trim(_text("selftext"))).alias("selftext"),
        F.coalesce(F.col("score"), F.lit(0)).cast("bigint").alias("score"),
        F.coalesce(F.col("num_comments"), F.lit(0)).cast("bigint").alias("num_comments"),
        "created_utc", ts.alias("timestamp"), F.to_date(ts).alias("date"), F.year(ts).alias("year"),
    )


def normalise_comments(raw: DataFrame, bots: Sequence[str] = tuple(KNOWN_BOTS)) -> DataFrame:
    """Canonical comment records without bots and empty bodies."""
    kept = with_drop_reason(raw, comment_rules(bots)).where("drop_reason IS NULL").drop("drop_reason")
    ts = F.timestamp_seconds("created_utc")
    a = F.trim(_text("author"))
    return kept.select(
        F.col("id").cast("string").alias("id"),
        F.replace(_text("link_id"), F.lit("t3_"), F.lit("")).alias("link_id"),
        F.when(a.isin("[deleted]", ""), "deleted").otherwise(a).alias("author"),
        F.trim("body").alias("body"),
        F.coalesce(F.col("score"), F.lit(0)).cast("bigint").alias("score"),
        "created_utc", F.to_date(ts).alias("date"), F.year(ts).alias("year"),
    )


def sentiment_eligible(score="sentiment_score", has_body="has_body") -> Column:
    """P12 for posts: not (score is zero and there is no body)."""
    return ~((F.col(score) == 0.0) & ~F.col(has_body))


def contract_violations(df: DataFrame, contract: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Add ``violations``, an array of (column, check, value) that failed."""
    checks = [
        F.when(~F.coalesce(F.expr(pred), F.lit(False)), F.struct(
            F.lit(c).alias("column"), F.lit(name).alias("check"), F.col(c).cast("string").alias("value")))
        for c, name, pred in contract
    ]
    return df.withColumn("violations", F.filter(F.array(*checks), lambda v: v.isNotNull()))


def contract_valid(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") == 0).drop("violations")


def contract_summary(checked: DataFrame) -> DataFrame:
    """Rows in, valid, dropped, and violations found, as one row."""
    bad = F.size("violations")
    return checked.agg(F.count("*").alias("n_rows"), F.count_if(bad == 0).alias("n_valid"), F.count_if(bad > 0).alias("n_dropped"), F.coalesce(F.sum(bad), F.lit(0)).cast("bigint").alias("n_violations"))


def contract_counts(checked: DataFrame) -> DataFrame:
    """Violations per column and check."""
    return checked.select(F.explode("violations").alias("_v")).groupBy("_v.column", "_v.check").agg(F.count("*").alias("n"))


def contract_report(checked: DataFrame, ids: Sequence[str]) -> DataFrame:
    return checked.select(*ids, F.explode("violations").alias("_v")).select(*ids, "_v.column", "_v.check", "_v.value")


def feature_from_vectors(feature: str, vectors: Sequence[str]) -> Column:
    """Value of a feature in the first vector that is present, 0 where it lacks it."""
    v = F.coalesce(*[F.when(F.size(F.map_keys(F.col(c))) > 0, F.col(c)) for c in vectors])
    return F.coalesce(F.try_element_at(v, F.lit(feature)), F.lit(0.0))


def fill_constants(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """P16, constant per column."""
    return df.fillna(values)


def fill_train_median(df: DataFrame, features: Sequence[str], split="split", train="train",
                      n_buckets: int | None = None) -> DataFrame:
    """Nulls to the exact median of the training rows (medians from distributed ranks)."""
    long = df.where(F.col(split) == train).select(*[F.col(c).cast("double").alias(c) for c in features]).unpivot(
        [], list(features), "feature", "value")
    med = exact_quantiles(long, "value", [0.5], ["feature"], names=["median"], n_buckets=n_buckets)
    one = med.agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"_m_{c}") for c in features])
    out = df.crossJoin(F.broadcast(one))  # one row
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"), F.lit(0.0)) for c in features}).drop(
        *[f"_m_{c}" for c in features])


def clip_to_train_sigmas(df: DataFrame, features: Sequence[str], sigmas=10.0, split="split", train="train") -> DataFrame:
    """Nulls to zero, then clipped to training mean ± sigmas (zero deviation reads 1)."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    stats = filled.where(F.col(split) == train).agg(
        *[F.avg(c).alias(f"_mu_{c}") for c in features],
        *[F.coalesce(F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(1.0)).alias(f"_sd_{c}") for c in features],
    )
    out = filled.crossJoin(F.broadcast(stats))  # one row
    clipped = {
        c: clamp(c, F.col(f"_mu_{c}") - sigmas * F.col(f"_sd_{c}"), F.col(f"_mu_{c}") + sigmas * F.col(f"_sd_{c}"))
        for c in features
    }
    return out.withColumns(clipped).drop(*stats.columns)


# fixed values: finance themes and domains
FINANCE_THEMES = ["ECON_STOCKMARKET", "ECON_EARNINGSREPORT", "ECON_IPO", "ECON_BANKRUPTCY", "ECON_INTEREST_RATE",
                  "ECON_MONOPOLY"]
FINANCE_DOMAINS = ["bloomberg.com", "reuters.com", "wsj.com", "cnbc.com", "ft.com", "marketwatch.com", "barrons.com",
                   "benzinga.com", "fool.com", "seekingalpha.com", "thestreet.com", "investopedia.com",
                   "yahoofinance.com", "finance.yahoo.com"]


def contains_any(c: str, needles: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | _text(c).contains(n)
    return out


def finance_articles(df: DataFrame, themes="THEMES", urls="SOURCEURLS", theme_list=tuple(FINANCE_THEMES),
                     domain_list=tuple(FINANCE_DOMAINS)) -> DataFrame:
    """A finance theme or a finance domain occurs in the row."""
    return df.where(contains_any(themes, theme_list) | contains_any(urls, domain_list))


def high_engagement(df: DataFrame, min_score=10, min_comments=20, title: str | None = None, min_title=10,
                    score="score", comments="num_comments") -> DataFrame:
    """P19."""
    d = df.where((F.col(score) >= min_score) | (F.col(comments) >= min_comments))
    return d.where(F.char_length(title) >= min_title) if title else d


def matched(df: DataFrame, min_confidence=0.5) -> DataFrame:
    """P20."""
    return df.where((F.col("confidence") >= min_confidence) & (F.col("match_type") != "false_positive"))


def feed_counts_of_day(panel: DataFrame, day: str, fields: dict[str, float], key="ticker", time="date") -> DataFrame:
    """One day's panel rows as feed counts with defaults (partition pruned by date)."""
    return panel.where(F.col(time) == F.lit(day).cast("date")).select(
        key, *[F.coalesce(F.col(c).cast("double"), F.lit(float(d))).alias(c) for c, d in fields.items()])
