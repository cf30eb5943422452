"""Queries over file sources and sinks, on files Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions import text as tx
from pulsegrid.operators import filters
from pulsegrid.plans.catalog import query, r
from pulsegrid.session import scratch_path
from pulsegrid.sources import lines, readers, writers


@query("s01_parquet_columns", f"SELECT event_id, event_type, {r('value', 'value')} FROM events")
def _(t):
    return readers.parquet(t.spark, f"{t.dir}/events.parquet", ["event_id", "event_type", "value"])


@query("s02_json_lines", f"SELECT event_id, event_type, {r('value', 'value')} FROM events WHERE event_id % 10 <> 3 AND event_id % 10 <> 7")
def _(t):
    """Lines with blanks and broken records mixed in."""
    e = F.col("event_id") % 10
    line = F.when(e == 3, "").when(e == 7, F.concat(F.lit('{"event_id": '), "event_type")).otherwise(
        F.to_json(F.struct("event_id", "event_type", "value")))
    path = scratch_path(t.spark, "jsonl")
    t.base("events").select(line.alias("value")).write.text(path)
    return readers.json_lines(t.spark, path, "event_id bigint, event_type string, value double").where("event_id IS NOT NULL")


@query("s03_fold_documents", f"""WITH d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bench))
SELECT CAST(1 + (i-252)//63 AS INT) AS fold, (SELECT e.date FROM d e WHERE e.i=d.i-10) AS train_end, date AS test_start, 'bull_2019' AS regime, {r('(1 + (i-252)//63)/10.0E0', 'sharpe')}, CAST(7 AS BIGINT) AS n_trades FROM d WHERE i >= 252 AND (i-252) % 63 = 0 AND i+63 < n""")
def _(t):
    """A walk-forward result document, written as indented JSON and exploded again."""
    from pulsegrid.operators.folds import expanding_folds

    f = expanding_folds(t.bench())
    one = F.struct("fold", "train_start", "train_end", "test_start", "test_end", "regime", F.lit(0.5).alias("is_sharpe"), F.struct(
        F.lit(1.0).alias("total_return_pct"), (F.col("fold") / 10.0).alias("sharpe"), F.lit(0.5).alias("win_rate"), F.lit(7).alias("n_trades")).alias("oos"))
    doc = f.agg(F.struct(F.lit(5).alias("purge_days"), F.lit(5).alias("embargo_days"), F.collect_list(one).alias("folds")).alias("d"))
    path = scratch_path(t.spark, "folds")
    doc.select(F.to_json("d", {"pretty": "true"}).alias("value")).write.text(path)
    return readers.fold_documents(t.spark, path).select("fold", "train_end", "test_start", "regime", "sharpe", "n_trades")


@query("s04_tab_separated_feed", f"SELECT CAST(page_id AS VARCHAR) AS numarts, url AS sourceurls, {r('((page_id*7) % 41 - 20)/10.0E0 * CASE WHEN abs((page_id*7) % 41 - 20) > 10 THEN 10.0E0/abs((page_id*7) % 41 - 20) ELSE 1 END', 'tone')} FROM pages WHERE page_id % 13 <> 5")
def _(t):
    """Feed rows with quotes in the text; rows with too few fields are dropped."""
    tone = F.concat((((F.col("page_id") * 7) % 41) - 20).cast("string"), F.lit(",1,2"))
    full = F.concat_ws("\t", F.lit("20240101"), F.col("page_id").cast("string"), F.lit(""), F.lit("ECON_IPO"), F.lit('say "hi'), F.lit("p"), F.lit("org"),
                       tone, F.lit("1"), F.lit("s"), F.col("url"))
    line = F.when(F.col("page_id") % 13 == 5, "too\tshort").otherwise(full)
    path = scratch_path(t.spark, "tsv")
    t.base("pages").select(line.alias("value")).write.text(path)
    d = readers.article_feed(t.spark, path)
    return filters.finance_articles(d).select(F.col("NUMARTS").alias("numarts"), F.col("SOURCEURLS").alias("sourceurls"), tx.parse_tone("TONE").alias("tone"))


@query("s05_symbol_list", "SELECT DISTINCT upper(p_brand) AS ticker FROM part WHERE p_brand <> 'Brand#7'")
def _(t):
    """A list file with comments, blanks, padding and repeats."""
    v = F.concat(F.lit("  "), F.lower("p_brand"), F.lit(" "))
    line = F.explode(F.array(v, F.lit(""), F.concat(F.lit("# "), F.col("p_brand"))))
    path = scratch_path(t.spark, "symbols")
    t.base("part").select(line.alias("value")).write.text(path)
    return readers.symbol_list(t.spark, path, exclude=["BRAND#7"]).select("ticker")


@query("s05_symbol_order", "SELECT upper(p_brand) AS ticker, CAST(row_number() OVER (ORDER BY min(p_partkey)) AS INT) AS place FROM part WHERE p_brand <> 'Brand#7' GROUP BY 1")
def _(t):
    """The same list in file order: many files, read in ranges of a few kilobytes."""
    line = F.concat(F.lit("  "), F.lower("p_brand"), F.lit(" "))
    path = scratch_path(t.spark, "symbols")
    t.base("part").orderBy("p_partkey").select(F.explode(F.array(line, F.lit(""), F.concat(F.lit("# "), F.col("p_brand")))).alias("value")).write.text(path)
    found = lines.ordered_symbols(t.spark, path, exclude=["BRAND#7"], split_bytes=4096)
    return found.select("ticker", F.row_number().over(Window.orderBy("position")).alias("place"))  # one row per symbol


@query("s06_registry", "SELECT DISTINCT p_brand AS ticker, concat('T', CAST(regexp_extract(p_brand,'[0-9]+',0) AS INT) % 2) AS tier, concat('S', CAST(regexp_extract(p_brand,'[0-9]+',0) AS INT) % 5) AS sector FROM part WHERE CAST(regexp_extract(p_brand,'[0-9]+',0) AS INT) % 3 <> 0 AND CAST(regexp_extract(p_brand,'[0-9]+',0) AS INT) % 2 = 1")
def _(t):
    n = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    e = F.struct(F.array("p_brand").alias("company_names"), F.array().cast("array<string>").alias("subreddits"), (n % 3 != 0).alias("active"),
                 F.lit("2024-01-01").alias("added_date"), F.concat(F.lit("T"), n % 2).alias("tier"), F.concat(F.lit("S"), n % 5).alias("sector"))
    b = t.base("part").select("p_brand").distinct().select(F.struct("p_brand", e.alias("e")).alias("kv"))
    doc = b.agg(F.map_from_entries(F.collect_list("kv")).alias("tickers"))
    path = scratch_path(t.spark, "registry")
    doc.select(F.to_json(F.struct("tickers")).alias("value")).write.text(path)
    reg = readers.registry(t.spark, path)
    return readers.active_keys(reg, "T1").join(readers.sector_map(reg).withColumnRenamed("sector", "s2"), "ticker").select("ticker", "tier", "sector")


@query("s07_panel_write_and_prune", "SELECT ticker, date, post_count_1d FROM panel WHERE year = 1998")
def _(t):
    path = scratch_path(t.spark, "panel")
    writers.write_panel(t.panel(), path)
    return t.spark.read.parquet(path).where("year = 1998").select("ticker", "date", "post_count_1d")


@query("s08_upsert_panel", f"""SELECT ticker, date, {r('CASE WHEN year(date)=1999 AND day(date) < 10 THEN close+1 ELSE close END', 'close', 9)} FROM bars""", digits=9)
def _(t):
    """A re-sent slice replaces its rows; sending it twice changes nothing."""
    path = scratch_path(t.spark, "upsert-panel")
    b = t.bars().select("ticker", "date", "close")
    new = b.where("year(date) = 1999 AND day(date) < 10").withColumn("close", F.col("close") + 1)
    writers.upsert_panel(b, path)
    writers.upsert_panel(new, path)
    writers.upsert_panel(new, path)
    return t.spark.read.parquet(path).select("ticker", "date", "close")


@query("s10_insert_panel", "SELECT ticker, date, n_lines FROM bars")
def _(t):
    path = scratch_path(t.spark, "insert-panel")
    b = t.bars().select("ticker", "date", "n_lines")
    writers.write_panel(b.where("year(date) <= 1996"), path)
    writers.insert_panel(b.withColumn("n_lines", F.when(F.year("date") <= 1996, -1).otherwise(F.col("n_lines")).cast("bigint")), path)
    return t.spark.read.parquet(path).select("ticker", "date", "n_lines")


@query("s09_append_log", f"SELECT id, ticker, {r('pnl_pct', 'pnl_pct')} FROM trades")
def _(t):
    path = scratch_path(t.spark, "log")
    d = t.trades().select("id", "ticker", "pnl_pct")
    writers.append_log(d.where("id % 2 = 0"), path)
    writers.append_log(d.where("id % 2 = 1"), path)
    return readers.json_lines(t.spark, path, "id bigint, ticker string, pnl_pct double")




@query("s12_wide_to_long_bars", f"SELECT ticker, date, {r('close', 'close', 9)}, {r('volume', 'volume', 9)} FROM bars", digits=9)
def _(t):
    keys = [r.ticker for r in t.bars().select("ticker").distinct().orderBy("ticker").collect()]  # the item types
    wide = t.bars().groupBy("date").agg(*[
        F.max(F.when(F.col("ticker") == k, F.col(f.lower()))).alias(f"{f}_{k}") for f in ("Close", "Volume") for k in keys])
    return readers.wide_to_long_bars(wide, fields=("Close", "Volume")).select("ticker", "date", "close", "volume")


@query("s13_feed_fallback", "SELECT ticker, date, news_count_1d, 'secondary' AS feed FROM news_b UNION ALL SELECT ticker, date, news_count_1d, 'primary' AS feed FROM news_c")
def _(t):
    cols = ["ticker", "date", "news_count_1d"]
    silent = t.news_a().select(*cols).withColumn("news_count_1d", F.lit(0).cast("bigint"))
    ok = F.col("news_count_1d") > 0
    a = readers.feed_or_fallback(silent, t.news_b().select(*cols), ok)
    b = readers.feed_or_fallback(t.news_c().select(*cols), t.news_b().select(*cols), ok)
    return a.unionByName(b)


@query("s06_mention_history_document", "SELECT ticker, date, CAST(count AS INT) AS count FROM daily_small")
def _(t):
    d = t.daily_small()
    per = d.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("string"), "count"))).alias("m"))
    doc = per.select("ticker", F.create_map("ticker", "m").alias("d"))  # one document per key
    path = scratch_path(t.spark, "history")
    doc.select("ticker", F.to_json("d").alias("value")).write.partitionBy("ticker").text(path)
    return readers.mention_history(t.spark, path)


@query("f05_run_log_fields", f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'PASS' WHEN event_id % 3 = 1 THEN 'FAIL' END AS gate, CASE WHEN event_id % 3 < 2 THEN event_type END AS ticker, CASE WHEN event_id % 3 < 2 THEN event_id END AS posts,
 CASE WHEN event_id % 3 = 2 THEN 'POSITIVE' END AS regime, {r('CASE WHEN event_id % 3 = 2 THEN 0.75 END', 'multiplier')}, {r('CASE WHEN event_id % 3 = 2 THEN 0.25 END', 'vix_percentile')} FROM events""")
def _(t):
    e = F.col("event_id") % 3
    line = (F.when(e == 0, F.concat(F.lit("[PASS] "), "event_type", F.lit("  posts="), "event_id"))
            .when(e == 1, F.concat(F.lit("[FAIL] "), "event_type", F.lit("  posts="), "event_id"))
            .otherwise("regime=positive multiplier=0.75 vix_pct_rank=0.25"))
    p = tx.parse_run_log(t.base("events").select(F.concat(line, F.lit(" #"), F.col("event_id")).alias("value")))
    return p.select(F.regexp_extract("line", "#([0-9]+)$", 1).cast("bigint").alias("event_id"), "gate", "ticker", "posts", "regime", "multiplier", "vix_percentile")


@query("f05_run_log_report", f"""SELECT count(*) FILTER (event_id % 3 = 0) AS n_pass, count(*) FILTER (event_id % 3 = 1) AS n_fail, CAST(sum(event_id) FILTER (event_id % 3 < 2) AS BIGINT) AS gated_posts, {r('0.25', 'vix_percentile')}, {r('0.75', 'multiplier')}, CAST(NULL AS BIGINT) AS total_posts FROM events""")
def _(t):
    e = F.col("event_id") % 3
    line = (F.when(e == 0, F.concat(F.lit("[PASS] "), "event_type", F.lit("  posts="), "event_id"))
            .when(e == 1, F.concat(F.lit("[FAIL] "), "event_type", F.lit("  posts="), "event_id"))
            .otherwise("regime=positive multiplier=0.75 vix_pct_rank=0.25"))
    return tx.run_log_report(tx.parse_run_log(t.base("events").select(line.alias("value"))))


_ = T
