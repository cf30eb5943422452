"""Panel-shaped views over the given tables, as DataFrames and as SQL.

Both forms follow the same rules, so a query and its check read identical rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.session import configure

HELD = ["STANDARD", "PROMO"]


class Tables:
    """Lazy access to the base tables and the derived views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = configure(spark), sf_dir.rstrip("/")

    def base(self, name: str, *columns: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return df.select(*columns) if columns else df

    # bars of item types and brands -------------------------------------------------------
    def _bars(self, key: str) -> DataFrame:
        li = self.base("lineitem").select(
            "l_partkey", F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity", "l_discount")
        j = li.join(self.base("part").select("p_partkey", F.col(key).alias("ticker")), F.col("l_partkey") == F.col("p_partkey"))
        dec = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
        unit = F.col("l_extendedprice") / F.col("l_quantity")
        return j.groupBy("ticker", "date").agg(
            (dec("l_extendedprice") / dec("l_quantity")).alias("close"), F.max(unit).alias("high"), F.min(unit).alias("low"),
            dec("l_quantity").alias("volume"), F.count(F.lit(1)).alias("n_lines"),
            (dec("l_discount") / F.count(F.lit(1))).alias("discount"))

    def bars(self) -> DataFrame:
        return self._bars("p_type")

    def brand_bars(self) -> DataFrame:
        return self._bars("p_brand")

    def bench(self) -> DataFrame:
        return self.bars().where(F.col("ticker") == "STANDARD")

    def index_series(self) -> DataFrame:
        li = self.base("lineitem").select(F.to_date("l_shipdate").alias("date"), "l_discount")
        return li.groupBy("date").agg(
            (F.sum(F.col("l_discount").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("value"))

    def panel(self) -> DataFrame:
        """Bars with attention, sentiment, lookback features, targets and split."""
        from pulsegrid.operators import technical as tech

        d = self.bars().select(
            "ticker", "date", "close", "volume", F.col("n_lines").alias("post_count_1d"),
            (F.col("n_lines") * 3).alias("total_comments_1d"), (F.col("discount") - 0.05).alias("sentiment_1d"))
        d = tech.pct_change(d, (1, 20))
        d = tech.relative_volume(d, 20, 5, 1.0)
        d = tech.forward_returns(d, (1, 5))
        y = F.year("date")
        return d.withColumns({
            "year": y, "split": F.when(y <= 1998, "train").when(y <= 2000, "test").otherwise("live"),
            "sentiment_accel": F.col("sentiment_1d") - F.coalesce(F.lag("sentiment_1d", 1).over(tech.by_key()), F.lit(0.0))})

    # posts ---------------------------------------------------------------------------------
    def _posts(self, key) -> DataFrame:
        k = F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
        e = self.base("events").withColumn("k", k)
        s = F.when(F.col("k") % 7 == 0, None).otherwise(((F.col("event_id") * 37) % 201 - 100).cast("double") / 100)
        return e.select(
            F.col("event_id").alias("post_id"), key.alias("ticker"), F.col("ts").cast("timestamp").alias("timestamp"),
            F.to_date("ts").alias("date"), (F.floor("value").cast("bigint") - 20).alias("score"),
            F.col("k").alias("num_comments"), s.alias("sentiment_score"),
            F.when(s > 0.05, "positive").when(s < -0.05, "negative").when(s.isNotNull(), "neutral").alias("sentiment_label"),
            (F.col("k").cast("double") / 100).alias("sentiment_conf"), (F.col("event_id") % 3 == 0).alias("has_body"),
            F.col("event_type").alias("source"))

    def posts(self) -> DataFrame:
        return self._posts(F.col("event_type"))

    def posts_small(self) -> DataFrame:
        return self._posts(F.concat(F.lit("U"), F.col("user_id") % 20))

    def posts_by_user(self) -> DataFrame:
        """Posts keyed by user: many keys, and days on which a key has no post."""
        return self._posts(F.concat(F.lit("U"), F.col("user_id")))

    def event_bars(self) -> DataFrame:
        """Daily bars of the small post keys, from event values."""
        e = self.base("events").select(
            F.concat(F.lit("U"), F.col("user_id") % 20).alias("ticker"), F.to_date("ts").alias("date"), "value")
        v = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
        return e.groupBy("ticker", "date").agg(
            (10.0 + v / F.count(F.lit(1))).alias("close"), (10.0 + F.max("value")).alias("high"),
            (10.0 + F.min("value")).alias("low"), F.count(F.lit(1)).cast("double").alias("volume"))

    def daily_small(self) -> DataFrame:
        return self.posts_small().groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("count"))

    def _news(self, kind: str) -> DataFrame:
        p = self.posts_small().where(F.col("source") == kind)
        return p.groupBy("ticker", "date").agg(
            (F.sum(F.col("score").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)) / 100).alias("news_sentiment_1d"),
            F.count(F.lit(1)).alias("news_count_1d"))

    def news_a(self) -> DataFrame:
        return self._news("view")

    def news_b(self) -> DataFrame:
        return self._news("click")

    def news_c(self) -> DataFrame:
        return self._news("purchase")

    # texts -----------------------------------------------------------------------------------
    def texts(self) -> DataFrame:
        t = F.col("text")
        first = F.substring_index(t, "\n", 1)
        body = F.when(F.instr(t, "\n") > 0, F.substring(t, F.char_length(first) + 2, F.char_length(t))).otherwise("")
        return self.base("documents", "doc_id", "text", "source", "lang").select(
            F.col("doc_id").alias("id"), first.alias("title"), body.alias("body"), "text", "source", "lang",
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("date"))

    def comments(self) -> DataFrame:
        s = F.when(F.col("turn") % 5 == 0, 0.0).otherwise(((F.col("conv_id") * 31 + F.col("turn") * 17) % 201 - 100).cast("double") / 100)
        return self.base("conversations", "conv_id", "turn").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("t3_"), F.col("conv_id")).alias("link_id"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 30).cast("int")).alias("date"), s.alias("score"))

    def articles(self) -> DataFrame:
        """Web pages as feed rows: organisations, tone text and source URLs."""
        p = self.base("pages")
        return p.select(
            "page_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 5).cast("int")).alias("date"),
            F.col("html").alias("organizations"), "url",
            F.concat((((F.col("page_id") * 7) % 41) - 20).cast("string"), F.lit(",1.0,2.0")).alias("tone_text"),
            F.concat(F.col("url"), F.lit(";"), F.col("url")).alias("source_urls"))

    # orders and options ------------------------------------------------------------------------
    def trades(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.base("orders").select(
            k.alias("id"), F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("entry_date"),
            F.date_add(F.to_date("o_orderdate"), (1 + k % 5).cast("int")).alias("exit_date"),
            (((k * 7919) % 2001 - 960).cast("double") / 10000).alias("pnl_pct"),
            (((k * 104729) % 1999 - 990).cast("double") / 20000).alias("pred"),
            (((k * 7919) % 2001 - 960 + (k * 104729) % 1999 / 4.0) / 10000.0).alias("actual"),
            F.when(k % 3 == 0, "BEARISH").otherwise("BULLISH").alias("side"),
            F.when(k % 4 == 0, "stop_loss").when(k % 4 == 1, "take_profit_cap").otherwise("hold_period_expired").alias("exit_reason"),
            (1 + k % 5).alias("hold_days"), (-(4 + k % 9) / 100.0).alias("stop_pct"),
            (1 + k % 50).alias("n_shares"), (F.col("o_totalprice") / 1000).alias("entry_price"))

    def chain(self) -> DataFrame:
        li = self.base("lineitem").where(F.col("l_returnflag").isin("R", "A")).select(
            "l_partkey", F.to_date(F.trunc(F.to_date("l_shipdate"), "month")).alias("expiry"),
            F.when(F.col("l_returnflag") == "R", "put").otherwise("call").alias("side"), "l_quantity")
        j = li.join(self.base("part").select("p_partkey", F.col("p_type").alias("ticker")), F.col("l_partkey") == F.col("p_partkey"))
        return j.groupBy("ticker", "expiry", "side").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("volume"))

    def calendar_events(self) -> DataFrame:
        return self.base("orders").where(F.col("o_orderstatus") == "P").select(
            F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("event_date"))

    def sector(self) -> DataFrame:
        n = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
        return self.base("part", "p_brand").where(F.col("p_brand") != "Brand#25").select(
            F.col("p_brand").alias("ticker"), F.concat(F.lit("S"), n % 5).alias("sector")).distinct()

    def predictions(self) -> DataFrame:
        """Brand bars with three derived predictions, one row per brand and day."""
        d = F.datediff("date", F.lit("1995-01-01").cast("date")).cast("bigint")
        n = F.regexp_extract("ticker", "[0-9]+", 0).cast("bigint")
        p = lambda a, b: (((n * a + d * b) % 121 - 60).cast("double") / 2000)
        return self.brand_bars().select(
            "ticker", "date", "close", "high", "low", "volume", "n_lines", p(31, 17).alias("pred_1d"), p(53, 7).alias("pred_3d"),
            p(11, 29).alias("pred_5d"))


def _bars_sql(key: str) -> str:
    return f"""SELECT {key} AS ticker, CAST(l_shipdate AS DATE) AS date,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)/CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close,
  MAX(l_extendedprice/l_quantity) AS high, MIN(l_extendedprice/l_quantity) AS low,
  CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume, COUNT(*) AS n_lines,
  CAST(SUM(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE)/COUNT(*) AS discount
FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2"""


def _posts_sql(key: str) -> str:
    return f"""SELECT event_id AS post_id, {key} AS ticker, ts AS timestamp, CAST(ts AS DATE) AS date,
  CAST(floor(value) AS BIGINT)-20 AS score, k AS num_comments, s AS sentiment_score,
  CASE WHEN s > 0.05 THEN 'positive' WHEN s < -0.05 THEN 'negative' WHEN s IS NOT NULL THEN 'neutral' END AS sentiment_label,
  CAST(k AS DOUBLE)/100 AS sentiment_conf, event_id % 3 = 0 AS has_body, event_type AS source
FROM (SELECT *, CASE WHEN k % 7 = 0 THEN NULL ELSE CAST((event_id*37) % 201 - 100 AS DOUBLE)/100 END AS s
  FROM (SELECT *, CAST(regexp_extract(props,'[0-9]+',0) AS BIGINT) AS k FROM events))"""


def _news_sql(kind: str) -> str:
    return f"""SELECT ticker, date, CAST(SUM(CAST(score AS DECIMAL(18,2))) AS DOUBLE)/COUNT(*)/100 AS news_sentiment_1d,
  COUNT(*) AS news_count_1d FROM posts_small WHERE source='{kind}' GROUP BY 1,2"""


VIEWS = {
    "bars": _bars_sql("p_type"),
    "brand_bars": _bars_sql("p_brand"),
    "bench": "SELECT * FROM bars WHERE ticker='STANDARD'",
    "index_series": "SELECT CAST(l_shipdate AS DATE) AS date, CAST(SUM(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE)/COUNT(*) AS value FROM lineitem GROUP BY 1",
    "panel": """SELECT ticker, date, close, volume, n_lines AS post_count_1d, n_lines*3 AS total_comments_1d, discount-0.05 AS sentiment_1d,
  close/lag(close,1) OVER w - 1 AS returns_1d, close/lag(close,20) OVER w - 1 AS returns_20d,
  coalesce(CASE WHEN count(volume) OVER w20 >= 5 THEN volume/avg(volume) OVER w20 END, 1.0) AS relative_volume,
  lead(close,1) OVER w/close - 1 AS target_return_1d, lead(close,5) OVER w/close - 1 AS target_return_5d,
  CAST(year(date) AS INTEGER) AS year, CASE WHEN year(date)<=1998 THEN 'train' WHEN year(date)<=2000 THEN 'test' ELSE 'live' END AS split,
  discount-0.05 - coalesce(lag(discount-0.05,1) OVER w, 0.0) AS sentiment_accel
FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date), w20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "posts": _posts_sql("event_type"),
    "posts_small": _posts_sql("concat('U', user_id % 20)"),
    "posts_by_user": _posts_sql("concat('U', user_id)"),
    "event_bars": """SELECT concat('U', user_id % 20) AS ticker, CAST(ts AS DATE) AS date,
  CAST(10.0 AS DOUBLE)+CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE)/COUNT(*) AS close, CAST(10.0 AS DOUBLE)+MAX(value) AS high,
  CAST(10.0 AS DOUBLE)+MIN(value) AS low, CAST(COUNT(*) AS DOUBLE) AS volume FROM events GROUP BY 1,2""",
    "daily_small": "SELECT ticker, date, COUNT(*) AS count FROM posts_small GROUP BY 1,2",
    "news_a": _news_sql("view"), "news_b": _news_sql("click"), "news_c": _news_sql("purchase"),
    "texts": """SELECT doc_id AS id, split_part(text, chr(10), 1) AS title,
  CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body, text, source, lang,
  DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS date FROM documents""",
    "comments": """SELECT conv_id*1000+turn AS id, concat('t3_', conv_id) AS link_id, DATE '2024-01-01' + CAST(conv_id % 30 AS INT) AS date,
  CASE WHEN turn % 5 = 0 THEN 0.0E0 ELSE CAST((conv_id*31+turn*17) % 201 - 100 AS DOUBLE)/100 END AS score FROM conversations""",
    "articles": """SELECT page_id, DATE '2024-01-01' + CAST(page_id % 5 AS INT) AS date, html AS organizations, url,
  concat(CAST((page_id*7) % 41 - 20 AS VARCHAR), ',1.0,2.0') AS tone_text, concat(url, ';', url) AS source_urls FROM pages""",
    "trades": """SELECT o_orderkey AS id, o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS entry_date,
  CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 5 AS INT) AS exit_date,
  CAST((o_orderkey*7919) % 2001 - 960 AS DOUBLE)/10000 AS pnl_pct, CAST((o_orderkey*104729) % 1999 - 990 AS DOUBLE)/20000 AS pred,
  (CAST((o_orderkey*7919) % 2001 - 960 AS DOUBLE) + CAST((o_orderkey*104729) % 1999 AS DOUBLE)/4.0E0)/10000.0E0 AS actual,
  CASE WHEN o_orderkey % 3 = 0 THEN 'BEARISH' ELSE 'BULLISH' END AS side,
  CASE WHEN o_orderkey % 4 = 0 THEN 'stop_loss' WHEN o_orderkey % 4 = 1 THEN 'take_profit_cap' ELSE 'hold_period_expired' END AS exit_reason,
  1 + o_orderkey % 5 AS hold_days, -CAST(4 + o_orderkey % 9 AS DOUBLE)/100.0E0 AS stop_pct, 1 + o_orderkey % 50 AS n_shares,
  o_totalprice/1000 AS entry_price FROM orders""",
    "chain": """SELECT p_type AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS expiry,
  CASE WHEN l_returnflag='R' THEN 'put' ELSE 'call' END AS side, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume
FROM lineitem JOIN part ON l_partkey=p_partkey WHERE l_returnflag IN ('R','A') GROUP BY 1,2,3""",
    "calendar_events": "SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS event_date FROM orders WHERE o_orderstatus='P'",
    "sector": """SELECT DISTINCT p_brand AS ticker, concat('S', CAST(regexp_extract(p_brand,'[0-9]+',0) AS INT) % 5) AS sector
FROM part WHERE p_brand <> 'Brand#25'""",
    "predictions": """SELECT ticker, date, close, high, low, volume, n_lines, CAST((n*31+d*17)%121-60 AS DOUBLE)/2000 AS pred_1d,
  CAST((n*53+d*7)%121-60 AS DOUBLE)/2000 AS pred_3d, CAST((n*11+d*29)%121-60 AS DOUBLE)/2000 AS pred_5d
FROM (SELECT *, date_diff('day', DATE '1995-01-01', date) AS d, CAST(regexp_extract(ticker,'[0-9]+',0) AS BIGINT) AS n FROM brand_bars)""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """The SQL text with the definitions of every view it mentions put in front."""
    views = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in views:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(views[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body.strip()
    head = ",\n".join(f"{n} AS ({views[n]})" for n in order)
    text = body.strip()
    if text[:4].upper() == "WITH":
        rec = text[4:].lstrip()
        if rec[:9].upper() == "RECURSIVE":
            return f"WITH RECURSIVE {head},\n{rec[9:].lstrip()}"
        return f"WITH {head},\n{rec}"
    return f"WITH {head}\n{text}"
