"""Symbols in text, text assembly and small parsers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import clamp
from pulsegrid.functions.matching import listed

WORDS = r"(?U)(\w+)"
DOLLAR = r"(?U)\$([A-Z]{1,5})\b"
UNKNOWN = r"(?U)\b([A-Z]{1,5})\b"

# fixed values: capitalised words that are not symbols, and forum jargon
FALSE_POSITIVES = [
    "I", "A", "THE", "FOR", "ARE", "BE", "DO", "OR", "AN", "IT", "IF", "GO", "SO", "ON", "IN", "AT", "US", "DD",
    "IMO", "EPS", "YOY", "ATH", "ETF", "IPO", "CEO", "CFO", "SEC", "IRS",
]
DISCOVERY_NOISE = FALSE_POSITIVES + [
    "YOLO", "FOMO", "WSB", "TLDR", "TBH", "AKA", "ASAP", "USA", "UK", "EU", "GDP", "CPI", "FED", "PE", "PT", "AH",
    "OTM", "ITM", "YTD", "QOQ", "IRA", "LOL", "WTF", "NSFW",
]


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def symbol_mentions(df: DataFrame, text: str, symbols: Sequence[str], false_positives: Sequence[str] = (),
                    out="ticker") -> DataFrame:
    """one row per text and known symbol, with the stronger tier for ``$SYM``.

    Words are looked up in the hashed list inside each row, so common words never become rows or shuffle keys,
    and the time does not depend on the length of the list.
    """
    t = text_of(text)
    found = lambda pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
    tagged = [s for s in symbols if s not in set(false_positives)]
    both = listed(df, {"_plain": (found(WORDS), symbols), "_tag": (found(DOLLAR), tagged)})
    return (
        both.withColumn("_all", F.array_union("_plain", "_tag"))
        .withColumn(out, F.explode("_all"))
        .withColumn("match_type", F.when(F.array_contains("_tag", F.col(out)), "dollar").otherwise("word"))
        .withColumn("confidence", F.when(F.col("match_type") == "dollar", 1.0).otherwise(0.8))
        .drop("_tag", "_all", "_plain")
    )


def unknown_symbols(df: DataFrame, text: str, known: Sequence[str] = (), noise: Sequence[str] = tuple(DISCOVERY_NOISE),
                    extra: Sequence[str] = ()) -> DataFrame:
    """capitalised 1-5 letter tokens that are neither known nor noise, counted per match.

    Tokens are counted first; the lists are compared with the counts, one row per distinct token.
    """
    toks = F.regexp_extract_all(text_of(text), F.lit(UNKNOWN), F.lit(1))
    counts = df.select(*extra, F.explode(toks).alias("symbol")).groupBy(*extra, "symbol").agg(F.count(F.lit(1)).alias("n_mentions"))
    skip = sorted({*known, *noise})
    return counts.where(~F.col("symbol").isin(skip)) if skip else counts


def most_frequent(df: DataFrame, column: str, k=10) -> DataFrame:
    """The ``k`` most frequent values, ties by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column).limit(k)


def build_text(df: DataFrame, title="title", body="body", limit=500, min_body=20) -> DataFrame:
    """title, and the first ``limit`` characters of a body longer than ``min_body``."""
    has = F.char_length(text_of(body)) > min_body
    return df.withColumns({
        "text": F.when(has, F.concat(F.trim(text_of(title)), F.lit(". "), F.substring(text_of(body), 1, limit)))
        .otherwise(F.trim(text_of(title))),
        "has_body": has,
    })


def parse_tone(c: Column | str) -> Column:
    """first comma field over 10, clamped to ±1; anything unreadable reads 0."""
    raw = F.get(F.split(text_of(c), ","), F.lit(0)).try_cast("double")
    return F.coalesce(clamp(raw / 10.0, -1.0, 1.0), F.lit(0.0))


def parse_run_log(lines: DataFrame, value="value") -> DataFrame:
    """fields of run-log lines; null where a line does not carry the field."""
    v = F.col(value)
    def grab(pattern: str, kind: str) -> Column:
        return F.nullif(F.regexp_extract(v, pattern, 1), F.lit("")).try_cast(kind)
    return lines.select(
        v.alias("line"),
        F.nullif(F.regexp_extract(v, r"\[(PASS|FAIL)\]\s+(\w+)\s+posts=(\d+)", 1), F.lit("")).alias("gate"),
        F.nullif(F.regexp_extract(v, r"\[(?:PASS|FAIL)\]\s+(\w+)\s+posts=", 1), F.lit("")).alias("ticker"),
        grab(r"\bposts=(\d+)", "bigint").alias("posts"),
        F.upper(F.nullif(F.regexp_extract(v, r"(?i)regime[=_](\w+)", 1), F.lit(""))).alias("regime"),
        grab(r"multiplier=([\d.]+)", "double").alias("multiplier"),
        grab(r"(?i)vix_pct[a-z_]*=([\d.]+)", "double").alias("vix_percentile"),
        grab(r"post_count_total=(\d+)", "bigint").alias("total_posts"),
    )


def run_log_report(parsed: DataFrame) -> DataFrame:
    """one-row report over the parsed lines."""
    return parsed.agg(
        F.count_if(F.col("gate") == "PASS").alias("n_pass"), F.count_if(F.col("gate") == "FAIL").alias("n_fail"),
        F.coalesce(F.sum(F.when(F.col("gate").isNotNull(), F.col("posts"))), F.lit(0)).alias("gated_posts"),
        F.max("vix_percentile").alias("vix_percentile"), F.max("multiplier").alias("multiplier"),
        F.max("total_posts").alias("total_posts"))


def ticker_sentiments(articles: DataFrame, threshold=0.3, array_col="ticker_sentiment", published="time_published",
                      tracked: Sequence[str] | None = None) -> DataFrame:
    """nested per-ticker scores of articles above a relevance threshold."""
    day = F.try_to_date(F.substring(published, 1, 8), "yyyyMMdd")
    e = articles.where(F.length(published) >= 8).select(day.alias("date"), F.explode(array_col).alias("_s"))
    out = e.select(
        F.upper("_s.ticker").alias("ticker"), "date",
        F.col("_s.relevance_score").try_cast("double").alias("_rel"),
        F.col("_s.ticker_sentiment_score").try_cast("double").alias("score"),
    ).where((F.col("_rel") > threshold) & F.col("score").isNotNull())
    if tracked is not None:
        out = out.where(F.col("ticker").isin(list(tracked)))
    return out.drop("_rel")


def nested_sentiment(message: str = "message") -> Column:
    """``entities.sentiment.basic``; struct access is null safe."""
    return F.col(f"{message}.entities.sentiment.basic")


def classifier_features(df: DataFrame, sources: dict[str, int], title="title") -> DataFrame:
    """word count, logged counts, hour of day and encoded source."""
    m = F.create_map(*[F.lit(x) for kv in sources.items() for x in kv])
    words = F.size(F.filter(F.split(F.trim(text_of(title)), r"\s+"), lambda w: w != ""))
    return df.withColumns({
        "title_length": words.cast("double"),
        "has_body_f": F.col("has_body").cast("int").cast("double"),
        "log_score": F.log1p(F.greatest(F.coalesce(F.col("score"), F.lit(0)), F.lit(0)).cast("double")),
        "log_comments": F.log1p(F.coalesce(F.col("num_comments"), F.lit(0)).cast("double")),
        "hour_of_day": F.floor(F.pmod(F.col("created_utc"), F.lit(86400)) / 3600).cast("double"),
        "source_code": F.coalesce(F.try_element_at(m, F.col("source")), F.lit(0)).cast("double"),
    })
