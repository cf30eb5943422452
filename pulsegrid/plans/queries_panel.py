"""Queries over the feature panel: filters, joins, quality suite, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.functions.exprs import nan_to_null
from pulsegrid.operators import filters, joins, quality, rollups, setops
from pulsegrid.plans.catalog import query, r, rs

FEATS = ["post_count_1d", "sentiment_1d", "returns_1d", "returns_20d", "relative_volume"]


@query("p01_universe_lists", "SELECT ticker, date, close FROM (SELECT ticker, date, n_lines AS close FROM bars) WHERE ticker IN ('STANDARD','PROMO','SMALL') AND ticker NOT IN ('PROMO')")
def _(t):
    return filters.universe(t.bars(), ["STANDARD", "PROMO", "SMALL"], ["PROMO"]).select("ticker", "date", F.col("n_lines").alias("close"))


@query("p01_universe_tables", "SELECT ticker, date, n_lines FROM brand_bars WHERE ticker IN (SELECT ticker FROM sector WHERE sector <> 'S4') AND ticker NOT IN (SELECT ticker FROM sector WHERE sector = 'S0')")
def _(t):
    s = t.sector()
    return filters.universe_table(t.brand_bars(), s.where("sector <> 'S4'"), s.where("sector = 'S0'")).select("ticker", "date", "n_lines")


@query("p02_density_gate", f"SELECT split, count(*) AS n_rows, count(*) FILTER (post_count_1d >= 5) AS n_kept, {r('avg(CASE WHEN post_count_1d >= 5 THEN 1.0 ELSE 0 END)', 'kept_share')} FROM panel GROUP BY 1")
def _(t):
    return filters.density_share(t.panel())


@query("p02_density_gate_rows", "SELECT ticker, date, post_count_1d FROM panel WHERE post_count_1d >= 5")
def _(t):
    return filters.density_gate(t.panel()).select("ticker", "date", "post_count_1d")


@query("p03_quality_drop_reasons", """SELECT CASE WHEN ticker IN ('PROMO') THEN 'excluded' WHEN post_count_1d < 3 THEN 'low_count' WHEN target_return_5d IS NULL THEN 'null_target' WHEN abs(target_return_5d) > 0.5 THEN 'extreme_target'
 WHEN close IS NULL OR returns_1d IS NULL OR returns_20d IS NULL THEN 'null_market' ELSE 'kept' END AS drop_reason, count(*) AS n FROM panel GROUP BY 1""")
def _(t):
    rules = filters.quality_rules(["PROMO"], min_count=3, market=["close", "returns_1d", "returns_20d"])
    return filters.drop_counts(filters.with_drop_reason(t.panel(), rules))


@query("p04_drop_missing", "SELECT ticker, date, post_count_1d FROM panel WHERE returns_20d IS NOT NULL AND target_return_5d IS NOT NULL")
def _(t):
    return filters.drop_missing(t.panel(), ["returns_20d", "target_return_5d"]).select("ticker", "date", "post_count_1d")


@query("p05_drop_extremes", f"SELECT ticker, date, {r('target_return_5d', 'target_return_5d')} FROM panel WHERE abs(target_return_5d) <= 0.5")
def _(t):
    return filters.drop_extremes(t.panel(), "target_return_5d").select("ticker", "date", "target_return_5d")


STARTS = {"starts": "SELECT ticker, DATE '1996-01-01' + CAST(100*CAST(regexp_extract(ticker,'[0-9]+',0) AS INT) AS INT) AS start_date FROM sector WHERE sector <> 'S1'"}


def _starts(t):
    n = F.regexp_extract("ticker", "[0-9]+", 0).cast("int")
    return t.sector().where("sector <> 'S1'").select("ticker", F.date_add(F.lit("1996-01-01").cast("date"), 100 * n).alias("start_date"))


@query("p06_listing_dates", "SELECT b.ticker, b.date, b.n_lines FROM brand_bars b LEFT JOIN starts s ON s.ticker=b.ticker WHERE b.date >= greatest(coalesce(s.start_date, DATE '1995-06-01'), DATE '1995-06-01') AND b.date <= DATE '2001-06-30'", views=STARTS)
def _(t):
    return filters.from_listing_date(t.brand_bars(), _starts(t), "1995-06-01", "2001-06-30").select("ticker", "date", "n_lines")


@query("p07_split_labels", "SELECT ticker, date, CASE WHEN date < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS split2, CASE WHEN year(date) <= 1997 THEN 'train' WHEN year(date) <= 1999 THEN 'test' ELSE 'live' END AS split3 FROM bars")
def _(t):
    d = filters.split_by_date(t.bars(), "1999-01-01", out="split2")
    return filters.split_by_year(d, 1997, 1999, out="split3").select("ticker", "date", "split2", "split3")


@query("p08_sample_weight", f"SELECT ticker, date, {r('CASE year(date) WHEN 1996 THEN 0.3 WHEN 1999 THEN 1.5 ELSE 1.0 END', 'sample_weight')} FROM bars")
def _(t):
    return filters.sample_weight(t.bars(), {1996: 0.3, 1999: 1.5}).select("ticker", "date", "sample_weight")


@query("p09_canonical_columns", "SELECT ticker, date, year, split, post_count_1d, total_comments_1d FROM panel")
def _(t):
    d = t.panel().select("total_comments_1d", "split", "year", "post_count_1d", "date", "ticker")
    return filters.canonical_order(d, schema.PANEL_COLUMNS)


CONTRACT = {"checked": """SELECT event_id AS post_id, CASE WHEN event_id % 50 = 0 THEN lower(event_type) ELSE upper(substr(event_type,1,4)) END AS ticker, CAST(floor(value) AS BIGINT) - 2 AS upvotes,
 CASE WHEN event_id % 40 = 0 THEN 1.5E0 WHEN event_id % 41 = 0 THEN NULL ELSE 0.25E0 END AS sentiment_score, CAST((event_id % 110) AS DOUBLE)/100 AS sentiment_confidence FROM events"""}


def _checked(t):
    e = F.col("event_id")
    d = t.base("events").select(
        e.alias("post_id"), F.when(e % 50 == 0, F.lower("event_type")).otherwise(F.upper(F.substring("event_type", 1, 4))).alias("ticker"),
        (F.floor("value").cast("bigint") - 2).alias("upvotes"), F.when(e % 40 == 0, 1.5).when(e % 41 == 0, None).otherwise(0.25).alias("sentiment_score"),
        ((e % 110).cast("double") / 100).alias("sentiment_confidence"))
    return filters.contract_violations(d, schema.MENTION_CONTRACT)


BAD = """SELECT post_id, 'ticker' AS "column", 'matches' AS "check", ticker AS value FROM checked WHERE NOT regexp_full_match(ticker, '[A-Z]{1,5}')
UNION ALL SELECT post_id, 'upvotes', 'ge_0', CAST(upvotes AS VARCHAR) FROM checked WHERE upvotes < 0
UNION ALL SELECT post_id, 'sentiment_score', 'between_-1_1', CAST(sentiment_score AS VARCHAR) FROM checked WHERE sentiment_score NOT BETWEEN -1 AND 1
UNION ALL SELECT post_id, 'sentiment_confidence', 'between_0_1', CAST(sentiment_confidence AS VARCHAR) FROM checked WHERE sentiment_confidence NOT BETWEEN 0 AND 1"""


@query("p13_contract_report", BAD, views=CONTRACT)
def _(t):
    return filters.contract_report(_checked(t), ["post_id"])


@query("p13_contract_valid_rows", f"SELECT post_id, ticker, upvotes FROM checked WHERE post_id NOT IN (SELECT post_id FROM ({BAD}))", views=CONTRACT)
def _(t):
    return filters.contract_valid(_checked(t)).select("post_id", "ticker", "upvotes")


BARS = {"bad_bars": """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_extendedprice AS DOUBLE) END AS open, CAST(l_extendedprice AS DOUBLE) AS high, CAST(l_extendedprice AS DOUBLE) * (1 - CAST(l_discount AS DOUBLE) * 10) AS low,
 CAST(l_extendedprice AS DOUBLE) AS close, CAST(l_quantity AS DOUBLE) - 2 AS volume FROM lineitem"""}
NO_BAR = "(CASE WHEN {c} IS NULL OR {c} {op} 0 THEN 1 ELSE 0 END)"
BAR_CHECKS = [(c, "gt_0", "<=") for c in ("open", "high", "low", "close")] + [("volume", "ge_0", "<")]
N_BAD = " + ".join(NO_BAR.format(c=c, op=op) for c, _, op in BAR_CHECKS)


def _bars_checked(t):
    p = F.col("l_extendedprice").cast("double")
    d = t.base("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 7, None).otherwise(p).alias("open"), p.alias("high"), (p * (1 - F.col("l_discount").cast("double") * 10)).alias("low"),
                                  p.alias("close"), (F.col("l_quantity").cast("double") - 2).alias("volume"))
    return filters.contract_violations(d, schema.BAR_CONTRACT)


@query("p13_bar_contract_summary", f"SELECT count(*) AS n_rows, count(*) FILTER (v = 0) AS n_valid, count(*) FILTER (v > 0) AS n_dropped, CAST(sum(v) AS BIGINT) AS n_violations FROM (SELECT {N_BAD} AS v FROM bad_bars)", views=BARS)
def _(t):
    return filters.contract_summary(_bars_checked(t))


@query("p13_bar_contract_counts", " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{k}' AS "check", count(*) AS n FROM bad_bars WHERE {c} IS NULL OR {c} {op} 0 HAVING count(*) > 0""" for c, k, op in BAR_CHECKS), views=BARS)
def _(t):
    return filters.contract_counts(_bars_checked(t))


POSTS_BAD = {"bad_posts": """SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE CAST(conv_id AS VARCHAR) END AS post_id, text AS title, conv_id % 9 - 1 AS upvotes, CASE WHEN turn % 3 = 2 THEN -turn ELSE turn END AS comment_count, CASE WHEN conv_id % 10 = 0 THEN NULL ELSE conv_id * 1.0E0 END AS created_utc FROM conversations"""}
N_POST = "(CASE WHEN post_id IS NULL THEN 1 ELSE 0 END) + (CASE WHEN title IS NULL THEN 1 ELSE 0 END) + (CASE WHEN upvotes IS NULL OR upvotes < 0 THEN 1 ELSE 0 END) + (CASE WHEN comment_count IS NULL OR comment_count < 0 THEN 1 ELSE 0 END) + (CASE WHEN created_utc IS NULL THEN 1 ELSE 0 END)"


@query("p13_post_contract_summary", f"SELECT count(*) AS n_rows, count(*) FILTER (v = 0) AS n_valid, count(*) FILTER (v > 0) AS n_dropped, CAST(sum(v) AS BIGINT) AS n_violations FROM (SELECT {N_POST} AS v FROM bad_posts)", views=POSTS_BAD)
def _(t):
    c, k = F.col("conv_id"), F.col("turn")
    d = t.base("conversations").select(F.when(k % 5 == 4, None).otherwise(c.cast("string")).alias("post_id"), F.col("text").alias("title"), (c % 9 - 1).alias("upvotes"),
                                       F.when(k % 3 == 2, -k).otherwise(k).alias("comment_count"), F.when(c % 10 == 0, None).otherwise(c.cast("double")).alias("created_utc"))
    return filters.contract_summary(filters.contract_violations(d, schema.POST_CONTRACT))


@query("p13_feature_contract_summary", """SELECT count(*) AS n_rows, count(*) FILTER (v = 0) AS n_valid, count(*) FILTER (v > 0) AS n_dropped, CAST(sum(v) AS BIGINT) AS n_violations
FROM (SELECT (CASE WHEN ticker IS NULL THEN 1 ELSE 0 END) + (CASE WHEN post_count_1d - 3 < 0 THEN 1 ELSE 0 END) + (CASE WHEN sentiment_1d * 1000 NOT BETWEEN 0 AND 100 THEN 1 ELSE 0 END) + (CASE WHEN relative_volume < 0 THEN 1 ELSE 0 END) AS v FROM panel)""")
def _(t):
    d = t.panel().select("ticker", (F.col("post_count_1d") - 3).alias("post_count_1d"), (F.col("sentiment_1d") * 1000).alias("rsi_14"), "relative_volume")
    return filters.contract_summary(filters.contract_violations(d, schema.FEATURE_CONTRACT))


@query("p14_nan_to_null", "SELECT event_id, CASE WHEN event_id % 11 IN (0,1,2) THEN NULL ELSE value END AS value FROM events")
def _(t):
    e = F.col("event_id") % 11
    v = F.when(e == 0, float("nan")).when(e == 1, float("inf")).when(e == 2, float("-inf")).otherwise(F.col("value"))
    return nan_to_null(t.base("events").select("event_id", v.alias("value")))


@query("p15_vector_drift_coalesce", f"""SELECT event_id, {r('CASE WHEN event_id % 3 = 2 THEN 0 ELSE value END', 'returns_1d')}, {r('CASE WHEN event_id % 3 = 0 THEN 1.0 WHEN event_id % 3 = 1 THEN 2.0 ELSE 0 END', 'rsi_14')}, {r('0', 'missing')} FROM events""")
def _(t):
    k = F.col("event_id") % 3
    m = lambda x: F.create_map(F.lit("returns_1d"), F.col("value"), F.lit("rsi_14"), F.lit(x))
    d = t.base("events").select("event_id", F.when(k == 0, m(1.0)).alias("fv"), F.when(k <= 1, m(2.0)).alias("fv14"),
                                F.when(k == 2, F.create_map(F.lit("other"), F.lit(9.0))).alias("fv11"))
    return d.select("event_id", *[filters.feature_from_vectors(c, ["fv", "fv14", "fv11"]).alias(c) for c in ("returns_1d", "rsi_14", "missing")])


@query("p16_fill_constants", f"SELECT ticker, date, {r('coalesce(returns_20d, 0.0)', 'returns_20d')}, {r('coalesce(target_return_5d, -1.0)', 'target_return_5d')} FROM panel")
def _(t):
    return filters.fill_constants(t.panel(), {"returns_20d": 0.0, "target_return_5d": -1.0}).select("ticker", "date", "returns_20d", "target_return_5d")


@query("p16_fill_train_median", f"""SELECT ticker, date, {r("coalesce(returns_1d, (SELECT quantile_cont(returns_1d, 0.5) FROM panel WHERE split='train'))", 'returns_1d')}, {r("coalesce(returns_20d, (SELECT quantile_cont(returns_20d, 0.5) FROM panel WHERE split='train'))", 'returns_20d')} FROM panel""")
def _(t):
    return filters.fill_train_median(t.panel(), ["returns_1d", "returns_20d"]).select("ticker", "date", "returns_1d", "returns_20d")


def _clip(c):
    return f"least(greatest(coalesce({c},0), (SELECT avg(coalesce({c},0)) - 2*stddev_samp(coalesce({c},0)) FROM panel WHERE split='train')), (SELECT avg(coalesce({c},0)) + 2*stddev_samp(coalesce({c},0)) FROM panel WHERE split='train'))"


@query("p17_clip_to_train_sigmas", f"SELECT ticker, date, {r(_clip('returns_1d'), 'returns_1d')}, {r(_clip('relative_volume'), 'relative_volume')} FROM panel")
def _(t):
    return filters.clip_to_train_sigmas(t.panel(), ["returns_1d", "relative_volume"], 2.0).select("ticker", "date", "returns_1d", "relative_volume")


@query("p21_feed_counts_of_day", f"SELECT ticker, {r('coalesce(post_count_1d,0)', 'post_count_1d')}, {r('coalesce(returns_20d,1.0)', 'returns_20d')} FROM panel WHERE date = DATE '1998-03-03'")
def _(t):
    return filters.feed_counts_of_day(t.panel(), "1998-03-03", {"post_count_1d": 0.0, "returns_20d": 1.0})


# joins ---------------------------------------------------------------------------------------------
DC = "(SELECT ticker, date, count(*) AS posts, CAST(sum(num_comments) AS BIGINT) AS comments FROM posts_by_user GROUP BY 1,2)"


def _sparse_counts(t):
    return t.posts_by_user().groupBy("ticker", "date").agg(
        F.count(F.lit(1)).alias("posts"), F.sum("num_comments").alias("comments"))


@query("j01_social_market_join", f"SELECT b.ticker, b.date, {r('b.close', 'close')}, p.posts, p.comments FROM event_bars b JOIN {DC} p ON p.ticker=b.ticker AND p.date=b.date")
def _(t):
    return joins.panel_join(t.event_bars(), _sparse_counts(t)).select("ticker", "date", "close", "posts", "comments")


@query("j02_left_join_chain", f"""SELECT g.ticker, g.date, {r('b.close', 'close')}, coalesce(p.posts,0) AS posts, coalesce(p.comments,0) AS comments, {r('coalesce(n.news_sentiment_1d,0)', 'news_sentiment_1d')}, coalesce(n.news_count_1d,0) AS news_count_1d
FROM (SELECT ticker, date FROM event_bars) g LEFT JOIN event_bars b ON b.ticker=g.ticker AND b.date=g.date LEFT JOIN {DC} p ON p.ticker=g.ticker AND p.date=g.date LEFT JOIN news_c n ON n.ticker=g.ticker AND n.date=g.date""")
def _(t):
    grid = t.event_bars().select("ticker", "date")
    return joins.left_chain(grid, [
        (t.event_bars().select("ticker", "date", "close"), {}), (_sparse_counts(t), {"posts": 0, "comments": 0}),
        (t.news_c(), {"news_sentiment_1d": 0.0, "news_count_1d": 0})])


@query("j03_key_calendar", """SELECT k.ticker, d.date FROM (SELECT DISTINCT ticker FROM brand_bars) k CROSS JOIN (SELECT DISTINCT date FROM bench) d LEFT JOIN starts s ON s.ticker=k.ticker
WHERE d.date >= greatest(coalesce(s.start_date, DATE '1995-06-01'), DATE '1995-06-01')""", views=STARTS)
def _(t):
    return joins.key_calendar(t.brand_bars(), t.bench(), _starts(t), "1995-06-01")


@query("j08_unseen_keys", f"SELECT ticker, date, posts FROM {DC} p WHERE NOT EXISTS (SELECT 1 FROM news_c n WHERE n.ticker=p.ticker AND n.date=p.date)")
def _(t):
    return setops.unseen(_sparse_counts(t), t.news_c()).select("ticker", "date", "posts")


NEXT = "SELECT t.id, t.ticker, t.entry_date, (SELECT min(e.event_date) FROM ev e WHERE e.ticker=t.ticker AND e.event_date >= t.entry_date AND e.event_date <= t.entry_date + 90) AS next_event FROM trades t"
EV = {"ev": "SELECT DISTINCT ticker, event_date FROM calendar_events"}


def _events(t):
    return t.calendar_events()


@query("j09_next_event", f"WITH n AS ({NEXT}) SELECT * FROM n", views=EV)
def _(t):
    return joins.next_event(t.trades().select("id", "ticker", "entry_date"), _events(t))


@query("j09_clear_of_events", f"WITH n AS ({NEXT}) SELECT id FROM n WHERE NOT coalesce(next_event <= entry_date + 8, false)", views=EV)
def _(t):
    return joins.clear_of_events(t.trades().select("id", "ticker", "entry_date"), _events(t)).select("id")


@query("j14_trades_with_side", f"""SELECT t.id, coalesce(s.signal, 'BULLISH') AS signal FROM trades t LEFT JOIN (SELECT ticker, exit_date AS date, max(side) AS signal FROM trades GROUP BY 1,2) s ON s.ticker=t.ticker AND s.date=t.entry_date""")
def _(t):
    sig = t.trades().select("ticker", F.col("exit_date").alias("date"), F.col("side").alias("signal"))
    return joins.trades_with_side(t.trades().select("id", "ticker", "entry_date"), sig).select("id", "signal")


@query("j15_sector_enrichment", "SELECT b.ticker, b.date, coalesce(s.sector,'Unknown') AS sector FROM brand_bars b LEFT JOIN sector s ON s.ticker=b.ticker")
def _(t):
    return joins.with_sector(t.brand_bars().select("ticker", "date"), t.sector())


@query("j17_u06_split_key_overlap", "SELECT DISTINCT a.ticker, a.date FROM news_a a JOIN news_c c ON a.ticker=c.ticker AND a.date=c.date")
def _(t):
    return setops.shared_keys(t.news_a(), t.news_c())


@query("j20_prefer_right_values", f"SELECT a.ticker, a.date, {r('coalesce(b.news_sentiment_1d, a.news_sentiment_1d)', 'news_sentiment_1d')}, coalesce(b.news_count_1d, a.news_count_1d) AS news_count_1d FROM news_a a LEFT JOIN news_b b ON a.ticker=b.ticker AND a.date=b.date")
def _(t):
    return joins.prefer_right(t.news_a(), t.news_b(), ["ticker", "date"], ["news_sentiment_1d", "news_count_1d"]).select(
        "ticker", "date", "news_sentiment_1d", "news_count_1d")


# aggregations ----------------------------------------------------------------------------------------
@query("a08_put_call_ratio", f"""WITH n AS (SELECT ticker, expiry, sum(CASE WHEN side='put' THEN volume ELSE 0 END) AS put_volume, sum(CASE WHEN side='call' THEN volume ELSE 0 END) AS call_volume FROM chain GROUP BY 1,2)
SELECT ticker, expiry, {rs('put_volume', 'call_volume')}, {r('round(put_volume/nullif(call_volume,0),3)', 'pcr')} FROM n WHERE expiry = (SELECT min(expiry) FROM n m WHERE m.ticker=n.ticker)""")
def _(t):
    return rollups.put_call_ratio(t.chain())


@query("a09_coverage", f"""SELECT k.ticker, count(*) AS n_days, {r('100*avg(CASE WHEN coalesce(p.posts,0) > 0 THEN 1.0 ELSE 0 END)', 'coverage_pct')} FROM event_bars k LEFT JOIN {DC} p ON p.ticker=k.ticker AND p.date=k.date GROUP BY 1""")
def _(t):
    d = joins.left_chain(t.event_bars().select("ticker", "date"), [(_sparse_counts(t), {"posts": 0})])
    return rollups.coverage(d, "posts")


@query("a09_coverage_by_year", f"SELECT CAST(year(date) AS INT) AS year, count(*) AS n_rows, count(DISTINCT ticker) AS n_keys, {r('avg(sentiment_1d)', 'mean_value')} FROM panel GROUP BY 1")
def _(t):
    return rollups.coverage_by_year(t.panel(), "sentiment_1d")


@query("a11_quartile_returns", f"""WITH p AS (SELECT sentiment_1d AS f, target_return_5d AS y FROM panel WHERE target_return_5d IS NOT NULL AND split='train'),
e AS (SELECT quantile_cont(f,0.25) AS e1, quantile_cont(f,0.5) AS e2, quantile_cont(f,0.75) AS e3 FROM p),
g AS (SELECT 1 + CAST(f > e1 AS INT) + CAST(f > e2 AS INT) + CAST(f > e3 AS INT) AS bucket, count(*) AS n, avg(y) AS m FROM p, e GROUP BY 1)
SELECT bucket, n, {r('m', 'mean_target')}, (SELECT arg_min(m,bucket) > arg_max(m,bucket) FROM g) AS contrarian FROM g""")
def _(t):
    return rollups.quartile_returns(t.panel().where("split = 'train'"), "sentiment_1d", "target_return_5d")


@query("a13_trade_summary", f"""SELECT count(*) AS n_trades, {r('avg(CASE WHEN pnl_pct > 0 THEN 1.0 ELSE 0 END)', 'win_rate')}, {r('avg(pnl_pct)', 'mean_pnl')}, {r('sum(pnl_pct)', 'total_pnl')},
 {r('sum(CASE WHEN pnl_pct > 0 THEN pnl_pct ELSE 0 END)/abs(sum(CASE WHEN pnl_pct < 0 THEN pnl_pct END))', 'profit_factor')} FROM trades""")
def _(t):
    return rollups.trade_summary(t.trades())


@query("a13_trade_summary_by_key", f"""SELECT ticker, count(*) AS n_trades, {r('avg(CASE WHEN pnl_pct > 0 THEN 1.0 ELSE 0 END)', 'win_rate')}, {r('avg(pnl_pct)', 'mean_pnl')}, {r('sum(pnl_pct)', 'total_pnl')},
 {r('sum(CASE WHEN pnl_pct > 0 THEN pnl_pct ELSE 0 END)/abs(sum(CASE WHEN pnl_pct < 0 THEN pnl_pct END))', 'profit_factor')} FROM trades GROUP BY 1""")
def _(t):
    return rollups.trade_summary(t.trades(), group=["ticker"])


@query("a14_exit_histogram", f"SELECT exit_reason, count(*) AS n, {r('avg(hold_days)', 'mean_hold')}, {r('avg(stop_pct)', 'mean_stop')} FROM trades GROUP BY 1")
def _(t):
    return rollups.exit_histogram(t.trades())


MONTH = "SELECT strftime(date, '%Y-%m') AS month, count(*) AS n_points, (arg_max(close,date)-arg_min(close,date))/arg_min(close,date)*100 AS x FROM bench GROUP BY 1 HAVING count(*) >= 2"


@query("a15_monthly_returns", f"SELECT month, n_points, {r('x', 'return_pct')} FROM ({MONTH})")
def _(t):
    return rollups.monthly_returns(t.bench(), value="close")


_mm = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


@query("a15_monthly_pivot", f"""SELECT CAST(substr(month,1,4) AS INT) AS year, {', '.join(r(f"max(CASE WHEN substr(month,6,2)='{i + 1:02d}' THEN x END)", n) for i, n in enumerate(_mm))} FROM ({MONTH}) GROUP BY 1""")
def _(t):
    return rollups.monthly_pivot(rollups.monthly_returns(t.bench(), value="close"))


@query("a16_null_rates", " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'100*avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END)', 'null_pct')}, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) > 0.05 AS warn FROM panel" for c in FEATS))
def _(t):
    return rollups.null_rates(t.panel(), FEATS)


def _moments(c):
    n = f"count({c})"
    m = f"(SELECT avg({c}) FROM panel)"
    mk = lambda k: f"avg(pow({c}-{m},{k}))"
    return (f"SELECT '{c}' AS target, {n} AS n, {r(f'avg({c})', 'mean')}, {r(f'stddev_samp({c})', 'std')}, {r(f'{mk(3)}/pow({mk(2)},1.5)', 'skew')}, {r(f'{mk(4)}/pow({mk(2)},2)-3', 'kurtosis')},"
            f" {r(f'100*avg(CASE WHEN {c} > 0 THEN 1.0 WHEN {c} IS NOT NULL THEN 0 END)', 'pct_positive')}, {r(f'100*avg(CASE WHEN abs({c}) > 0.2 THEN 1.0 WHEN {c} IS NOT NULL THEN 0 END)', 'pct_outlier')} FROM panel")


@query("a17_target_moments", _moments("target_return_1d") + " UNION ALL " + _moments("target_return_5d"))
def _(t):
    return rollups.target_moments(t.panel(), ["target_return_1d", "target_return_5d"])


def _drift(c):
    return f"SELECT '{c}' AS feature, year, avg({c}) AS m FROM panel GROUP BY year"


@query("a18_yearly_drift", f"""WITH y AS ({_drift('post_count_1d')} UNION ALL {_drift('sentiment_1d')} UNION ALL {_drift('relative_volume')})
SELECT feature, year, {r('m', 'yearly_mean')}, abs(m - avg(m) OVER (PARTITION BY feature)) > 2*coalesce(nullif(stddev_samp(m) OVER (PARTITION BY feature),0),1) AS drift FROM y""")
def _(t):
    return rollups.yearly_drift(t.panel(), ["post_count_1d", "sentiment_1d", "relative_volume"])


@query("a19_live_drift", " UNION ALL ".join(f"""SELECT '{c}' AS feature, {r(f"avg({c}) FILTER (split='live')", 'live_mean')}, {r(f"avg(coalesce({c},0)) FILTER (split='train')", 'train_mean')}, {r(f"greatest(stddev_samp(coalesce({c},0)) FILTER (split='train'), 1e-6)", 'train_std')},
 abs(avg({c}) FILTER (split='live') - avg(coalesce({c},0)) FILTER (split='train')) > 3*greatest(stddev_samp(coalesce({c},0)) FILTER (split='train'),1e-6) AS drift FROM panel""" for c in FEATS))
def _(t):
    p = t.panel()
    return rollups.live_drift(p.where("split = 'live'"), p.where("split = 'train'"), FEATS)


@query("a20_directional_accuracy", f"SELECT split, count(*) AS n, {r('avg(CASE WHEN sign(returns_1d)=sign(target_return_5d) THEN 1.0 ELSE 0 END)', 'dir_acc')} FROM panel WHERE returns_1d IS NOT NULL AND target_return_5d IS NOT NULL GROUP BY 1")
def _(t):
    return rollups.directional_accuracy(t.panel(), "returns_1d", "target_return_5d", ["split"])


@query("a20_side_accuracy", f"SELECT count(*) AS n, {r('round(avg(CASE WHEN side=' + chr(39) + 'BEARISH' + chr(39) + ' THEN CAST(pnl_pct < 0 AS INT) ELSE CAST(pnl_pct > 0 AS INT) END),3)', 'accuracy')} FROM trades")
def _(t):
    return rollups.side_accuracy(t.trades(), "side", "pnl_pct")


@query("a21_label_agreement", f"""SELECT count(*) AS n, {r("100*avg(CASE WHEN (CASE WHEN sentiment_score <= -0.05 THEN 'negative' WHEN sentiment_score <= 0.05 THEN 'neutral' ELSE 'positive' END) = (CASE WHEN post_id % 5 = 0 THEN 'neutral' ELSE sentiment_label END) THEN 1.0 ELSE 0 END)", 'agreement_pct')} FROM posts WHERE sentiment_score IS NOT NULL""")
def _(t):
    names = F.create_map(F.lit("positive"), F.lit("BULLISH"), F.lit("negative"), F.lit("BEARISH"), F.lit("neutral"), F.lit("NEUTRAL"))
    lab = F.try_element_at(names, F.when(F.col("post_id") % 5 == 0, "neutral").otherwise(F.col("sentiment_label")))
    return rollups.label_agreement(t.posts().withColumn("label", lab), "sentiment_score", "label")


@query("a22_class_balance", f"SELECT count(*) FILTER (f=1) AS bull, count(*) FILTER (f=0) AS bear, {r('100.0*count(*) FILTER (f=0)/count(*)', 'bear_pct')}, 100.0*count(*) FILTER (f=0)/count(*) < 20 AS warn FROM (SELECT CASE WHEN returns_1d > 0 THEN 1.0 ELSE 0.0 END AS f FROM panel)")
def _(t):
    return rollups.class_balance(t.panel().withColumn("f", F.when(F.col("returns_1d") > 0, 1.0).otherwise(0.0)), "f")


_q = ", ".join(r(f"quantile_cont(post_count_1d + sentiment_1d, {p})", f"p{round(p * 100):02d}") for p in (0.01, 0.05, 0.95, 0.99))


@query("a23_describe_percentiles", f"SELECT count(*) AS n, {r('avg(post_count_1d + sentiment_1d)', 'mean')}, {r('max(post_count_1d + sentiment_1d)', 'max')}, {_q} FROM panel")
def _(t):
    return rollups.describe_percentiles(t.panel().withColumn("v", F.col("post_count_1d") + F.col("sentiment_1d")), "v")


@query("a23_describe_by_key", f"SELECT ticker, count(returns_1d) AS n, {r('avg(returns_1d)', 'mean')}, {r('max(returns_1d)', 'max')}, {r('quantile_cont(returns_1d,0.95)', 'p95')} FROM panel GROUP BY 1")
def _(t):
    return rollups.describe_percentiles(t.panel(), "returns_1d", ["ticker"], (0.95,))


@query("a24_run_funnel", f"""SELECT (SELECT count(*) FROM posts_small) AS total_posts, (SELECT count(*) FROM {DC}) AS keys_found, (SELECT count(*) FROM {DC} WHERE posts >= 3) AS keys_passing,
 (SELECT count(*) FROM trades) AS n_signals, (SELECT count(*) FROM trades WHERE id % 3 = 0) AS n_opens""")
def _(t):
    sig = t.trades().select(F.when(F.col("id") % 3 == 0, "OPEN").otherwise("SIGNAL").alias("action"))
    return rollups.run_funnel(t.posts_small(), _sparse_counts(t).withColumnRenamed("posts", "post_count_1d"), sig)


@query("a25_frozen_features", f"""SELECT ticker, 'relative_volume' AS feature, count(DISTINCT round(relative_volume,4)) AS n_values, count(DISTINCT round(relative_volume,4)) = 1 AS frozen FROM panel GROUP BY 1
UNION ALL SELECT ticker, 'flat', 1, true FROM panel GROUP BY 1""")
def _(t):
    return rollups.frozen_features(t.panel().withColumn("flat", F.lit(3.0)), ["relative_volume", "flat"])


@query("a27_confusion_report", f"""WITH c AS (SELECT quality AS l, CASE WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END AS p FROM labels)
SELECT k.c AS class, (SELECT count(*) FROM c WHERE l=k.c) AS support, (SELECT count(*) FROM c WHERE p=k.c) AS predicted, {r('(SELECT count(*) FROM c WHERE l=k.c AND p=k.c)/(SELECT count(*) FROM c WHERE p=k.c)', 'precision')},
 {r('(SELECT count(*) FROM c WHERE l=k.c AND p=k.c)/(SELECT count(*) FROM c WHERE l=k.c)', 'recall')} FROM (SELECT DISTINCT l AS c FROM c) k""")
def _(t):
    d = t.base("labels").withColumn("p", F.when(F.col("doc_id") % 4 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return rollups.confusion(d, "quality", "p")


DAILY = "(SELECT date, close AS portfolio_value, close/lag(close) OVER (ORDER BY date) - 1 AS daily_return FROM bench)"


def _daily(t):
    from pyspark.sql import Window
    return t.bench().select("date", F.col("close").alias("portfolio_value"), (F.col("close") / F.lag("close").over(Window.orderBy("date")) - 1).alias("daily_return"))


@query("a28_trading_summary", f"""SELECT count(*) AS n_days, min(date) AS start_date, max(date) AS end_date, {r('arg_max(portfolio_value,date)', 'final_value')}, {r('arg_max(portfolio_value,date)/1000.0E0-1', 'total_return')}, {r('avg(daily_return)*sqrt(252)/stddev_pop(daily_return)', 'sharpe_ratio')},
 {r('(SELECT arg_max(value,date)/arg_min(value,date)-1 FROM index_series)', 'benchmark_return')}, {r('arg_max(portfolio_value,date)/1000.0E0-1-(SELECT arg_max(value,date)/arg_min(value,date)-1 FROM index_series)', 'alpha')} FROM {DAILY}""")
def _(t):
    return rollups.trading_summary(_daily(t), 1000.0, benchmark=rollups.period_return(t.index_series(), value="value"))


@query("a29_closed_trade_report", f"""SELECT id, {r('round(n_shares*entry_price,2)', 'cost_basis')}, {r('pnl_pct', 'pnl_pct')}, abs(pnl_pct) > 0.0001 AS has_real_pnl, CASE WHEN pnl_pct > 0.0001 THEN 'WIN' WHEN pnl_pct < -0.0001 THEN 'LOSS' ELSE 'ZERO' END AS result FROM
 (SELECT id, n_shares, floor(entry_price) AS entry_price, pnl_pct FROM trades)""")
def _(t):
    d = t.trades().withColumn("entry_price", F.floor("entry_price").cast("double")).withColumn("exit_price", F.col("entry_price") * (1 + F.col("pnl_pct")))
    return rollups.closed_trade_report(d.select("id", "n_shares", "entry_price", "exit_price", "pnl_pct")).select("id", "cost_basis", "pnl_pct", "has_real_pnl", "result")


@query("a29_closed_trade_totals", f"""SELECT count(*) AS n_total, count(*) FILTER (abs(pnl_pct) > 0.0001) AS n_real, {r('sum(n_shares*100.0E0)', 'total_pnl_dollars')} FROM trades""")
def _(t):
    d = t.trades().select("n_shares", F.lit(50.0).alias("entry_price"), F.lit(150.0).alias("exit_price"), "pnl_pct")
    return rollups.closed_trade_totals(rollups.closed_trade_report(d))


ACT = "SELECT id, CAST(CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS opens, CAST(CASE WHEN id % 3 = 1 THEN 1 ELSE 0 END AS BIGINT) AS closes, CASE WHEN id % 3 = 2 THEN concat('SKIP ', ticker) END AS skip_reason FROM trades"


def _actions(t):
    """Runs with their action arrays: opens, a close, or a skip with its reason."""
    tag = lambda p: F.concat(F.lit(p), "ticker")
    a = (F.when(F.col("id") % 3 == 0, F.array(tag("OPEN "), tag("OPEN "))).when(F.col("id") % 3 == 1, F.array(tag("CLOSE ")))
         .otherwise(F.array(tag("SKIP "))))
    return t.trades().select("id", a.alias("actions"))


@query("a30_action_summary", ACT)
def _(t):
    return rollups.action_summary(_actions(t), time="id")


@query("a30_action_totals", f"SELECT skip_reason, count(*) AS n_days, CAST(sum(opens) AS BIGINT) AS opens, CAST(sum(closes) AS BIGINT) AS closes FROM ({ACT}) GROUP BY 1")
def _(t):
    return rollups.action_totals(rollups.action_summary(_actions(t), time="id"))


# quality ---------------------------------------------------------------------------------------------
def _suite_parts(t):
    p = t.panel()
    return p.withColumns({
        "target_return_5d": F.when(F.col("date") >= "2001-10-25", 0.01).otherwise(F.col("target_return_5d")),
        "returns_1d": F.when((F.dayofmonth("date") == 13) & (F.col("ticker") == "PROMO"), 0.9).otherwise(F.col("returns_1d"))})


SUITE_VIEW = {"faulty": """SELECT * REPLACE (CASE WHEN date >= DATE '2001-10-25' THEN 0.01 ELSE target_return_5d END AS target_return_5d,
 CASE WHEN day(date) = 13 AND ticker='PROMO' THEN 0.9 ELSE returns_1d END AS returns_1d) FROM panel"""}
TODAY = "2001-11-05"


@query("m12_check1_future_targets", f"SELECT '1_future_targets' AS \"check\", CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n AS n_violations FROM (SELECT count(*) AS n FROM faulty WHERE date >= DATE '{TODAY}' - 7 AND target_return_5d IS NOT NULL AND target_return_5d <> 0)", views=SUITE_VIEW)
def _(t):
    return quality.check_future_targets(_suite_parts(t), TODAY)


@query("m12_check2_return_recomputation", """WITH c AS (SELECT ticker, date, returns_1d, returns_20d, close, lag(close,1) OVER w AS p1, lag(close,20) OVER w AS p20, row_number() OVER w AS i FROM faulty WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT '2_return_recomputation' AS "check", CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n AS n_violations FROM (SELECT count(*) FILTER (abs(returns_1d-(close-p1)/p1) > 0.005) + count(*) FILTER (abs(returns_20d-(close-p20)/p20) > 0.005) AS n FROM c WHERE i > 20)""", views=SUITE_VIEW)
def _(t):
    return quality.check_return_recomputation(_suite_parts(t))


@query("m12_check4_target_correlation", """WITH l AS (SELECT 'leak' AS feature, leak AS x, target_return_5d AS y FROM leaky UNION ALL SELECT 'returns_1d', returns_1d, target_return_5d FROM leaky),
v AS (SELECT * FROM l WHERE x IS NOT NULL AND y IS NOT NULL),
k AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1)/2.0 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1)/2.0 AS ry FROM v),
c AS (SELECT feature, abs(corr(rx,ry)) AS a FROM k GROUP BY 1)
SELECT '4_target_correlation' AS "check", CASE WHEN count(*) FILTER (a > 0.85) > 0 THEN 'FAIL' WHEN count(*) FILTER (a > 0.5 AND a <= 0.85) > 0 THEN 'WARN' ELSE 'PASS' END AS status, count(*) FILTER (a > 0.5) AS n_violations FROM c""",
       views={"leaky": "SELECT *, target_return_5d*3 + sentiment_1d*0.01 AS leak FROM panel"})
def _(t):
    p = t.panel().withColumn("leak", F.col("target_return_5d") * 3 + F.col("sentiment_1d") * 0.01)
    return quality.check_target_correlation(p, ["leak", "returns_1d"])


@query("m12_check5_normalisation", """WITH l AS (SELECT 'scaled' AS f, (post_count_1d % 10)/10.0E0 AS v FROM panel UNION ALL SELECT 'volume', volume FROM panel UNION ALL SELECT 'returns_1d', returns_1d FROM panel),
s AS (SELECT f, min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_samp(v) AS sd FROM l WHERE v IS NOT NULL GROUP BY 1 HAVING count(*) >= 100)
SELECT '5_normalisation' AS "check", CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'PASS' END AS status, count(*) AS n_violations FROM s WHERE (lo >= -0.01 AND hi <= 1.01 AND m > 0.1 AND m < 0.9) OR (abs(m) < 0.05 AND sd > 0.9 AND sd < 1.1 AND abs(lo) < 5 AND abs(hi) < 5)""")
def _(t):
    p = t.panel().withColumn("scaled", (F.col("post_count_1d") % 10) / 10.0)
    return quality.check_normalisation(p, ["scaled", "volume", "returns_1d"])


@query("m12_check6_duplicates", """WITH d AS (SELECT ticker, date FROM panel UNION ALL SELECT ticker, date FROM panel WHERE ticker='PROMO' AND day(date)=1),
g AS (SELECT ticker, date, count(*) AS n FROM d GROUP BY 1,2) SELECT '6_duplicates' AS "check", CASE WHEN sum(n) FILTER (n > 1) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CAST(coalesce(sum(n) FILTER (n > 1),0) AS BIGINT) AS n_violations FROM g""")
def _(t):
    k = t.panel().select("ticker", "date")
    return quality.check_duplicates(k.unionByName(k.where("ticker = 'PROMO' AND day(date) = 1")), "1998-12-31", "1999-01-01")


LATE = """WITH d AS (SELECT * FROM panel WHERE NOT (ticker = 'PROMO' AND date < DATE '1996-01-01')), f AS (SELECT ticker, min(date) AS first_seen FROM d GROUP BY 1)
SELECT d.ticker, d.date, d.sentiment_accel, row_number() OVER (PARTITION BY d.ticker ORDER BY d.date) AS row_in_key FROM d JOIN f ON f.ticker=d.ticker WHERE f.first_seen >= (SELECT min(first_seen) FROM f) + 60"""


@query("w27_late_key_first_rows", f"SELECT ticker, date, CAST(row_in_key AS INT) AS row_in_key FROM ({LATE}) WHERE row_in_key <= 3")
def _(t):
    d = t.panel().where("NOT (ticker = 'PROMO' AND date < DATE '1996-01-01')")
    return quality.late_key_rows(d).select("ticker", "date", "row_in_key")


@query("m12_check7_timestamps", f"""SELECT '7_timestamps' AS "check", CASE WHEN b > 0 THEN 'FAIL' WHEN w > 0 THEN 'WARN' ELSE 'PASS' END AS status, b + w AS n_violations FROM (SELECT
 (SELECT count(*) FROM panel WHERE date >= DATE '{TODAY}' - 7 AND post_count_1d > 0 AND target_return_5d IS NOT NULL AND target_return_5d <> 0) AS b, (SELECT count(*) FROM ({LATE}) WHERE row_in_key <= 3 AND abs(sentiment_accel) > 0.001) AS w)""")
def _(t):
    d = t.panel().where("NOT (ticker = 'PROMO' AND date < DATE '1996-01-01')")
    return quality.check_timestamps(d, TODAY)


@query("m13_split_invariants", "SELECT count(target_return_5d) > 0 AS has_targets, max(date) FILTER (split='train') AS max_train, min(date) FILTER (split='test') AS min_test, max(date) FILTER (split='train') < DATE '1999-01-01' AS train_ok, min(date) FILTER (split='test') >= DATE '1999-01-01' AS test_ok FROM panel")
def _(t):
    return quality.split_invariants(t.panel(), "1999-01-01")


@query("m14_feed_drift", f"""WITH c AS (SELECT ticker, count(*) AS n FROM posts_small WHERE date = DATE '2024-01-29' GROUP BY 1), y AS (SELECT ticker, count(*) AS n FROM posts_small WHERE date = DATE '2024-01-22' GROUP BY 1),
g AS (SELECT max(c.n) AS max_posts, avg(CASE WHEN c.n/greatest(coalesce(y.n,c.n),1) <> 1 THEN c.n/greatest(coalesce(y.n,c.n),1) END) AS live FROM c LEFT JOIN y ON y.ticker=c.ticker)
SELECT max_posts, {r('live', 'live_growth')}, true AS mature, max_posts < 3 AS skip_day, CASE WHEN max_posts < 3 THEN 'NO_POSTS' WHEN live < 0.116 THEN 'GROWTH_LOW' WHEN live > 0.464 THEN 'GROWTH_HIGH' END AS alert,
 NOT (max_posts < 3 OR live < 0.116 OR live > 0.464) AS clean FROM g""")
def _(t):
    from pulsegrid.operators.windows import mention_growth
    hist = t.daily_small()
    day = mention_growth(hist).where("date = DATE '2024-01-29'").withColumnRenamed("count", "post_count_1d")
    return quality.feed_drift(day, hist, "2024-01-29")


# set operations on dates -------------------------------------------------------------------------------
@query("u05_missing_weekdays", """SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM bench) WHERE isodow(d) <= 5 AND CAST(d AS DATE) NOT IN (SELECT date FROM bench)""")
def _(t):
    return setops.missing_weekdays(t.bench())


@query("u04_append_completed", f"""SELECT ticker, date, {r('x', 'target_return_5d')} FROM (SELECT ticker, date, target_return_5d + 1 AS x FROM panel WHERE split='test' AND target_return_5d IS NOT NULL
UNION ALL SELECT ticker, date, target_return_5d FROM panel p WHERE split='train' OR (split='test' AND target_return_5d IS NULL))""")
def _(t):
    p = t.panel().select("ticker", "date", "split", "target_return_5d")
    live = p.where("split = 'test'").withColumn("target_return_5d", F.col("target_return_5d") + 1)
    return setops.append_completed(p.where("split <> 'live'"), live).select("ticker", "date", "target_return_5d")


@query("s11_newest_snapshots", "SELECT id, ticker FROM (SELECT id, ticker FROM trades ORDER BY id DESC LIMIT 25)")
def _(t):
    return setops.newest_snapshots(t.trades().select("id", "ticker"), 25)
