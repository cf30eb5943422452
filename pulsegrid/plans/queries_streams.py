"""Streaming jobs run over everything available, beside the SQL of their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.plans.catalog import query, r
from pulsegrid.session import scratch_path
from pulsegrid.streaming import attention, sinks, stateful

POST_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream_of(t, table: str, schema: str):
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.dir)


def _posts(t):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
    s = F.when(k % 7 == 0, None).otherwise(((F.col("event_id") * 37) % 201 - 100).cast("double") / 100)
    return stream_of(t, "events", POST_SCHEMA).select(
        F.col("event_id").alias("post_id"), F.concat(F.lit("U"), F.col("user_id") % 20).alias("ticker"),
        F.col("ts").cast("timestamp").alias("timestamp"), k.alias("num_comments"), s.alias("sentiment_score"))


CLOSED = "CAST(date AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR"


@query("t01_stream_daily_mentions", f"SELECT ticker, date, count(*) AS count, CAST(sum(num_comments) AS BIGINT) AS comments FROM posts_small WHERE {CLOSED} GROUP BY 1,2")
def _(t):
    return sinks.drain(attention.daily_mentions(_posts(t))).select("ticker", "date", "count", "comments")


@query("t02_stream_sliding_attention", f"""SELECT ticker, CAST(e AS DATE) AS date, count(*) AS post_count, {r('avg(sentiment_score)', 'avg_sentiment', 9)} FROM posts_small, (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-02-10', INTERVAL 1 DAY)) AS e)
WHERE timestamp >= e - INTERVAL 7 DAY AND timestamp < e AND e <= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR GROUP BY 1,2""", digits=9)
def _(t):
    return sinks.drain(attention.sliding_attention(_posts(t), 7))


@query("t03_stream_without_refetches", "SELECT post_id, ticker FROM posts_small")
def _(t):
    twice = _posts(t).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).drop("_copy")
    return sinks.drain(attention.without_refetches(twice)).select("post_id", "ticker")


@query("t06_stream_outage_alerts", f"""SELECT date, max(n) AS max_posts, max(n) < 18 AS skip_day FROM (SELECT ticker, date, count(*) AS n FROM posts_small WHERE {CLOSED} GROUP BY 1,2) GROUP BY 1""")
def _(t):
    d = attention.outage_alerts(attention.daily_mentions(_posts(t)), 18)
    return sinks.drain(d)


ORDER_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
COOL = """WITH RECURSIVE ev AS (SELECT DISTINCT concat(o_orderpriority, '/', o_custkey % 10) AS ticker, CAST(o_orderdate AS DATE) AS date FROM orders), c AS (SELECT ticker, min(date) AS date FROM ev GROUP BY 1
 UNION ALL SELECT c.ticker, (SELECT min(e.date) FROM ev e WHERE e.ticker=c.ticker AND e.date >= c.date + 7) FROM c WHERE c.date IS NOT NULL) SELECT ticker, date FROM c WHERE date IS NOT NULL"""


def _orders_stream(t):
    return stream_of(t, "orders", ORDER_SCHEMA).select(
        F.concat("o_orderpriority", F.lit("/"), F.col("o_custkey") % 10).alias("ticker"), F.to_date("o_orderdate").alias("date"))


@query("t05_stream_cooldown", COOL)
def _(t):
    return sinks.drain(stateful.cooldown_stream(_orders_stream(t)))


@query("t05_batch_cooldown", COOL)
def _(t):
    d = t.base("orders").select(F.concat("o_orderpriority", F.lit("/"), F.col("o_custkey") % 10).alias("ticker"), F.to_date("o_orderdate").alias("date"))
    return stateful.cooldown_batch(d)


def _staged(t, df, name):
    """A derived table written once and read back as a stream."""
    path = scratch_path(t.spark, name)
    df.write.parquet(path)
    return t.spark.readStream.schema(df.schema).parquet(path)


@query("t04_stream_pending_labels", f"""SELECT ticker, date, {r('lead(close,5) OVER (PARTITION BY ticker ORDER BY date)/close-1', 'target_return')} FROM event_bars QUALIFY lead(close,5) OVER (PARTITION BY ticker ORDER BY date) IS NOT NULL""")
def _(t):
    bars = t.event_bars().select("ticker", "date", "close")
    ev = stateful.as_label_events(bars, bars)
    return sinks.drain(stateful.pending_labels(_staged(t, ev, "label-events"), min_days=5)).select("ticker", "date", "target_return")


@query("t08_stream_rolling_baseline", f"""WITH s AS (SELECT ticker, date, count(*) AS n FROM posts_by_user GROUP BY 1,2), b AS (SELECT ticker, min(date) AS lo, max(date) AS hi FROM s GROUP BY 1),
g AS (SELECT b.ticker, CAST(d AS DATE) AS date FROM b, LATERAL (SELECT unnest(generate_series(b.lo, b.hi, INTERVAL 1 DAY)) AS d)), f AS (SELECT g.ticker, g.date, coalesce(s.n,0) AS c FROM g LEFT JOIN s ON s.ticker=g.ticker AND s.date=g.date),
w AS (SELECT *, CASE WHEN count(*) OVER x >= 5 THEN avg(c) OVER x ELSE 1.0 END AS m FROM f WINDOW x AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT ticker, date, CAST(c AS BIGINT) AS count, {r('m', 'baseline')}, {r('least(c/(m+1),10)', 'spike_ratio')} FROM w""")
def _(t):
    d = t.posts_by_user().groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("count"))
    return sinks.drain(stateful.rolling_baseline(_staged(t, d, "daily-counts")))


@query("t07_stream_upsert", "SELECT ticker, date, count(*) AS count FROM posts_small GROUP BY 1,2")
def _(t):
    """Counts in update mode, upserted per micro-batch; a second run over the same data changes nothing."""
    path = scratch_path(t.spark, "upsert-stream")
    for _i in range(2):
        d = attention.daily_mentions(_posts(t)).select("ticker", "date", "count")
        sinks.upsert_stream(d, path, scratch_path(t.spark, "upsert-checkpoint")).awaitTermination()
    return t.spark.read.parquet(path).select("ticker", "date", "count")
