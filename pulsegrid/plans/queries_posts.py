"""Queries over posts, comments, news and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import dates, text as tx
from pulsegrid.models import lexicon
from pulsegrid.operators import filters, joins, rollups, setops, windows
from pulsegrid.plans.catalog import query, r, rs

SYMBOLS = ["Is", "The", "And", "Of", "In", "To", "Thon", "Le", "La", "De", "Que"]

# attention windows before the market open: the sample lies in January, 09:30 New York = 14:30 UTC
W1_SQL = f"""WITH cut AS (SELECT DISTINCT date, CAST(date AS TIMESTAMP) + INTERVAL 870 MINUTE AS c FROM posts),
j AS (SELECT p.*, cut.date AS day, timestamp >= c - INTERVAL 24 HOUR AS d1, timestamp >= c - INTERVAL 72 HOUR AS d3
  FROM {{src}} p JOIN cut ON p.timestamp < c AND p.timestamp >= c - INTERVAL 168 HOUR),
g AS (SELECT ticker, day AS date, count(*) FILTER (d1) AS post_count_1d, count(*) FILTER (d3) AS post_count_3d, count(*) AS post_count_7d,
 count(DISTINCT post_id) FILTER (d1) AS unique_posts_1d, sum(score) FILTER (d1) AS total_upvotes_1d, sum(num_comments) FILTER (d1) AS total_comments_1d,
 avg(sentiment_score) FILTER (d1) AS m1, avg(sentiment_score) FILTER (d3) AS m3, count(sentiment_score) FILTER (d1) AS ns,
 sum(sentiment_score * ln(1 + greatest(score, 0))) FILTER (d1) AS sw, stddev_samp(sentiment_score) FILTER (d1) AS sd,
 count(*) FILTER (d1 AND sentiment_label='positive') AS pos, avg(sentiment_score) FILTER (d1 AND sentiment_conf >= 0.8) AS hc
 FROM j GROUP BY 1,2)
SELECT ticker, date, post_count_1d, post_count_3d, post_count_7d, unique_posts_1d, {r('total_upvotes_1d', 'total_upvotes_1d', 9)},
 {r('total_comments_1d', 'total_comments_1d', 9)}, {r('post_count_1d/(post_count_3d+1)', 'mention_growth_1d', 9)}, {r('post_count_1d/(post_count_7d+1)', 'mention_growth_7d', 9)},
 {r('m1', 'avg_sentiment_1d', 9)}, {r('m3', 'avg_sentiment_3d', 9)}, {r('CASE WHEN ns > 0 THEN sw/post_count_1d END', 'weighted_sentiment', 9)},
 {r('CASE WHEN ns > 1 THEN sd END', 'sentiment_std', 9)}, {r('m1 - m3', 'sentiment_accel', 9)}, {r('pos/post_count_1d', 'bullish_ratio', 9)},
 {r('hc', 'avg_sentiment_hc', 9)} FROM g WHERE post_count_1d >= 10"""


@query("w01_w03_attention_before_open", digits=9, sql=W1_SQL.format(src="posts"))
def _(t):
    return windows.attention_before_open(t.posts(), t.posts().select("date"))


@query("w01_w03_attention_small_keys", digits=9, sql=W1_SQL.format(src="posts_small"))
def _(t):
    return windows.attention_before_open(t.posts_small(), t.posts().select("date"))


@query("w02_mention_growth_windows", digits=9, sql=f"SELECT ticker, date, mention_growth_1d, mention_growth_7d FROM ({W1_SQL.format(src='posts')})")
def _(t):
    return windows.attention_before_open(t.posts(), t.posts().select("date")).select(
        "ticker", "date", "mention_growth_1d", "mention_growth_7d")


A1_SQL = """SELECT ticker, date, count(*) AS count_d, CAST(sum(num_comments) AS BIGINT) AS comments_d,
 coalesce(sum(CASE WHEN NOT (sentiment_score = 0 AND NOT has_body) THEN sentiment_score END), 0) AS score_sum_d,
 count(CASE WHEN NOT (sentiment_score = 0 AND NOT has_body) THEN sentiment_score END) AS score_cnt_d,
 coalesce(sum(abs(sentiment_score)), 0) AS abs_sum_d FROM {src} GROUP BY 1,2"""


@query("a01_daily_post_rollup", f"SELECT ticker, date, count_d, comments_d, {r('score_sum_d', 'score_sum_d')}, score_cnt_d, {r('abs_sum_d', 'abs_sum_d')} FROM ({A1_SQL.format(src='posts_small')})")
def _(t):
    return rollups.daily_post_rollup(t.posts_small())


# sparse daily counts for gaps: only purchases, so days are missing for some keys
@query("j05_densify_calendar", """SELECT k.ticker, c.date, coalesce(s.count, 0) AS count FROM (SELECT DISTINCT ticker FROM sparse) k
CROSS JOIN (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM sparse) c
LEFT JOIN sparse s ON s.ticker=k.ticker AND s.date=c.date""",
       views={"sparse": "SELECT ticker, date, count(*) AS count FROM posts_by_user GROUP BY 1,2"})
def _(t):
    d = t.posts_by_user().groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("count"))
    return windows.densify(d, ["count"])


LAG_SQL = f"""WITH d AS ({A1_SQL.format(src="sparse_posts")}),
g AS (SELECT k.ticker, c.date, coalesce(count_d,0) AS count_d, coalesce(comments_d,0) AS comments_d, coalesce(score_sum_d,0.0) AS s, coalesce(score_cnt_d,0) AS n, coalesce(abs_sum_d,0.0) AS a
 FROM (SELECT DISTINCT ticker FROM d) k CROSS JOIN (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d) c
 LEFT JOIN d ON d.ticker=k.ticker AND d.date=c.date),
l AS (SELECT ticker, date, lag(count_d) OVER w AS c1, lag(comments_d) OVER w AS m1, coalesce(lag(s) OVER w/nullif(lag(n) OVER w,0),0) AS v1,
 coalesce(sum(s) OVER w3/nullif(sum(n) OVER w3,0),0) AS v3, coalesce(lag(a) OVER w/nullif(lag(count_d) OVER w,0),0) AS ext
 FROM g WINDOW w AS (PARTITION BY ticker ORDER BY date), w3 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT ticker, date, CAST(c1 AS BIGINT) AS post_count_1d, CAST(m1 AS BIGINT) AS total_comments_1d, {r('v1', 'avg_sentiment_1d')}, {r('v3', 'avg_sentiment_3d')},
 {r('ext', 'sentiment_extremity')}, {r('v1-v3', 'sentiment_accel')} FROM l"""
SPARSE = {"sparse_posts": "SELECT * FROM posts_by_user"}


@query("w04_w05_lagged_post_features", LAG_SQL, views=SPARSE)
def _(t):
    p = t.posts_by_user()
    d = windows.densify(rollups.daily_post_rollup(p), ["count_d", "comments_d", "score_sum_d", "score_cnt_d", "abs_sum_d"])
    return windows.lagged_post_features(d)


LINK = """post_keys AS (SELECT CAST(event_id % 200 AS VARCHAR) AS post_id, min(event_type) AS ticker FROM events GROUP BY 1)"""


def _linked(t):
    posts = t.base("events").select((F.col("event_id") % 200).alias("id"), F.col("event_type").alias("ticker"))
    return joins.comments_to_keys(t.comments(), posts)


@query("j06_comments_to_first_key", f"""WITH {LINK} SELECT c.id, p.ticker, c.date, {r('c.score', 'score')} FROM comments c JOIN post_keys p ON replace(c.link_id,'t3_','') = p.post_id""")
def _(t):
    return _linked(t).select("id", "ticker", "date", "score")


@query("j06_comments_to_all_keys", f"""SELECT c.id, p.ticker FROM comments c JOIN (SELECT DISTINCT CAST(event_id % 200 AS VARCHAR) AS post_id, event_type AS ticker FROM events) p ON replace(c.link_id,'t3_','') = p.post_id""")
def _(t):
    posts = t.base("events").select((F.col("event_id") % 200).alias("id"), F.col("event_type").alias("ticker"))
    return joins.comments_to_keys(t.comments(), posts, all_keys=True).select("id", "ticker")


@query("a02_daily_comment_rollup", f"""WITH {LINK} SELECT p.ticker, c.date, count(*) AS comment_count_d, {r('coalesce(sum(CASE WHEN c.score <> 0 THEN c.score END),0)', 'comment_sum_d')},
 count(CASE WHEN c.score <> 0 THEN 1 END) AS comment_cnt_d FROM comments c JOIN post_keys p ON replace(c.link_id,'t3_','') = p.post_id GROUP BY 1,2""")
def _(t):
    posts = t.base("events").select((F.col("event_id") % 200).alias("id"), F.col("event_type").alias("ticker"))
    return rollups.linked_comment_rollup(t.comments(), posts)


@query("a02_lagged_comment_features", f"""WITH {LINK},
d AS (SELECT p.ticker, c.date, count(*) AS n, coalesce(sum(CASE WHEN c.score <> 0 THEN c.score END),0) AS s, count(CASE WHEN c.score <> 0 THEN 1 END) AS k
 FROM comments c JOIN post_keys p ON replace(c.link_id,'t3_','') = p.post_id GROUP BY 1,2),
g AS (SELECT k.ticker, c.date, coalesce(n,0) AS n, coalesce(s,0.0) AS s, coalesce(d.k,0) AS k FROM (SELECT DISTINCT ticker FROM d) k
 CROSS JOIN (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d) c LEFT JOIN d ON d.ticker=k.ticker AND d.date=c.date)
SELECT ticker, date, CAST(lag(n) OVER w AS BIGINT) AS comment_count_1d, {r('coalesce(lag(s) OVER w/nullif(lag(k) OVER w,0),0)', 'comment_sentiment_1d')} FROM g WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
def _(t):
    d = windows.densify(rollups.daily_comment_rollup(_linked(t)), ["comment_count_d", "comment_sum_d", "comment_cnt_d"])
    return windows.lagged_comment_features(d)


@query("w25_keep_best_duplicate", """SELECT ticker, bucket, post_id, score, sentiment_conf FROM (
 SELECT ticker, post_id % 700 AS bucket, post_id, score, sentiment_conf, row_number() OVER (PARTITION BY ticker, post_id % 700 ORDER BY sentiment_conf DESC, score DESC, post_id) AS i FROM posts) WHERE i = 1""")
def _(t):
    d = t.posts().select("ticker", (F.col("post_id") % 700).alias("bucket"), "post_id", "score", "sentiment_conf")
    return setops.keep_best(d, ["ticker", "bucket"], [F.col("sentiment_conf"), F.col("score"), -F.col("post_id")])


@query("w32_mention_growth_history", f"""SELECT a.ticker, a.date, a.count, {r('a.count/greatest(coalesce(y.count,a.count),1)', 'mention_growth_1d')},
 {r('a.count/greatest(coalesce(w.count,a.count),1)', 'mention_growth_7d')} FROM daily_small a
 LEFT JOIN daily_small y ON y.ticker=a.ticker AND y.date = a.date - 1 LEFT JOIN daily_small w ON w.ticker=a.ticker AND w.date = a.date - 7""")
def _(t):
    return windows.mention_growth(t.daily_small())


# news ------------------------------------------------------------------------------------------
@query("a03_news_daily", f"""SELECT ticker, date, count(*) AS news_count_1d, {r('coalesce(avg(sentiment_score),0)', 'news_sentiment_1d')}, {r('coalesce(max(sentiment_score),0)', 'news_sentiment_max')},
 {r('coalesce(min(sentiment_score),0)', 'news_sentiment_min')}, count(DISTINCT CASE WHEN source <> 'error' THEN source END) AS news_source_count FROM posts_small GROUP BY 1,2""")
def _(t):
    a = t.posts_small().select(
        "ticker", F.unix_timestamp("timestamp").alias("datetime"), F.col("sentiment_score").alias("score"),
        F.when(F.col("source") == "error", "").otherwise(F.col("source")).alias("source"))
    return rollups.news_daily(a)


@query("a04_news_moments", f"""SELECT ticker, date, count(sentiment_score) AS news_count_1d, {r('avg(sentiment_score)', 'news_sentiment_1d')}, {r('coalesce(stddev_samp(sentiment_score),0)', 'news_sentiment_std')} FROM posts_small GROUP BY 1,2""")
def _(t):
    return rollups.news_moments(t.posts_small(), score="sentiment_score")


ALIASES = {"thon": "THON", "track(": "TRACK", "blees": "BLEES", "eaux": "EAUX", "and ": "ANDX", "eau": "EAUX"}
_alias_rows = ", ".join(f"('{a}','{k}')" for a, k in ALIASES.items())
FIN = "(organizations LIKE '%track(%' OR url LIKE '%example.com/fr%')"
TONE = "greatest(-1.0, least(1.0, CAST(split_part(tone_text, ',', 1) AS DOUBLE)/10))"
HITS = f"SELECT DISTINCT a.page_id, a.date, l.k AS ticker, {TONE} AS tone, a.source_urls FROM articles a JOIN (VALUES {_alias_rows}) l(al,k) ON contains(lower(a.organizations), l.al) WHERE {FIN}"


def _tagged(t):
    fin = filters.finance_articles(t.articles(), "organizations", "url", ["track("], ["example.com/fr"])
    return joins.alias_matches(fin, "organizations", ALIASES).withColumn("tone", tx.parse_tone("tone_text"))


@query("p18_finance_articles", f"SELECT page_id, date FROM articles WHERE {FIN}")
def _(t):
    return filters.finance_articles(t.articles(), "organizations", "url", ["track("], ["example.com/fr"]).select("page_id", "date")


@query("j10_alias_substring_join", f"SELECT page_id, date, ticker, {r('tone', 'tone')} FROM ({HITS})")
def _(t):
    return _tagged(t).select("page_id", "date", "ticker", "tone")


@query("f04_parse_tone", f"SELECT page_id, {r('CASE WHEN page_id % 9 = 0 THEN 0 ELSE ' + TONE + ' END', 'tone')} FROM articles")
def _(t):
    raw = F.when(F.col("page_id") % 9 == 0, "n/a,1").otherwise(F.col("tone_text"))
    return t.articles().select("page_id", tx.parse_tone(raw).alias("tone"))


@query("a05_tone_daily", f"""WITH h AS ({HITS}), b AS (SELECT ticker, date, count(*) AS article_count, avg(tone) AS tm, coalesce(avg(CASE WHEN tone > 0 THEN tone END),0) AS tp,
 coalesce(avg(CASE WHEN tone < 0 THEN tone END),0) AS tn FROM h GROUP BY 1,2 HAVING count(*) >= 3),
u AS (SELECT ticker, date, count(DISTINCT u) AS c FROM (SELECT ticker, date, unnest(string_split(source_urls, ';')) AS u FROM h) WHERE u <> '' GROUP BY 1,2)
SELECT b.ticker, b.date, article_count, {r('tm', 'tone_mean')}, {r('tp', 'tone_positive')}, {r('tn', 'tone_negative')}, coalesce(u.c,0) AS source_count FROM b LEFT JOIN u ON u.ticker=b.ticker AND u.date=b.date""")
def _(t):
    return rollups.tone_daily(_tagged(t))


@query("a06_tagged_ratio", f"""SELECT ticker, st_count_1d, {r('coalesce((b-s)/nullif(b+s,0),0)', 'st_sentiment_1d', 4)}, {r('coalesce(b/nullif(b+s,0),0.5)', 'st_bull_pct', 4)} FROM (
 SELECT ticker, count(*) AS st_count_1d, count(*) FILTER (sentiment_label='positive') AS b, count(*) FILTER (sentiment_label='negative') AS s FROM posts_small GROUP BY 1) WHERE st_count_1d >= 3""")
def _(t):
    """The tag sits in a nested, possibly null struct."""
    tag = F.when(F.col("sentiment_label") == "positive", "Bullish").when(F.col("sentiment_label") == "negative", "Bearish")
    basic = F.when(tag.isNotNull(), F.struct(tag.alias("basic")))
    msg = F.struct(F.when(F.col("post_id") >= 0, F.struct(basic.alias("sentiment"))).alias("entities"))
    m = t.posts_small().select("ticker", msg.alias("message"))
    return rollups.tagged_ratio(m.select("ticker", tx.nested_sentiment().alias("basic")))


@query("f07_nested_sentiment", "SELECT post_id, CASE sentiment_label WHEN 'positive' THEN 'Bullish' WHEN 'negative' THEN 'Bearish' END AS basic FROM posts")
def _(t):
    tag = F.when(F.col("sentiment_label") == "positive", "Bullish").when(F.col("sentiment_label") == "negative", "Bearish")
    basic = F.when(tag.isNotNull(), F.struct(tag.alias("basic")))
    msg = F.struct(F.when(tag.isNotNull(), F.struct(basic.alias("sentiment"))).alias("entities"))
    return t.posts().select("post_id", msg.alias("message")).select("post_id", tx.nested_sentiment().alias("basic"))


@query("a07_live_counts", f"""SELECT source AS ticker, count(*) AS post_count_1d, CAST(sum(id % 13) AS BIGINT) AS total_comments_1d,
 {r("coalesce(avg(CASE WHEN trim(title) <> '' THEN (id % 21 - 10)/10.0E0 END),0)", 'sentiment_1d', 4)} FROM texts GROUP BY 1""")
def _(t):
    d = t.texts().select(F.col("source").alias("ticker"), "title", (F.col("id") % 13).alias("num_comments"),
                         ((F.col("id") % 21 - 10) / 10.0).alias("score"))
    return rollups.live_counts(d)


@query("f06_ticker_sentiments", f"""SELECT upper(event_type) AS ticker, CAST(ts AS DATE) AS date, {r('(event_id % 201 - 100)/100.0E0', 'score')} FROM events WHERE (event_id % 10)/10.0E0 > 0.3
UNION ALL SELECT 'ALL' AS ticker, CAST(ts AS DATE) AS date, {r('(event_id % 101 - 50)/100.0E0', 'score')} FROM events WHERE (event_id % 7)/10.0E0 > 0.3""")
def _(t):
    """Nested per-ticker scores kept as text, as news feeds deliver them."""
    e = t.base("events")
    def s(k, rel, sc):
        return F.struct(k.alias("ticker"), rel.cast("string").alias("relevance_score"), sc.cast("string").alias("ticker_sentiment_score"))
    arr = F.array(s(F.col("event_type"), (F.col("event_id") % 10) / 10.0, (F.col("event_id") % 201 - 100) / 100.0),
                  s(F.lit("all"), (F.col("event_id") % 7) / 10.0, (F.col("event_id") % 101 - 50) / 100.0))
    a = e.select(F.date_format("ts", "yyyyMMdd'T'HHmmss").alias("time_published"), arr.alias("ticker_sentiment"))
    return tx.ticker_sentiments(a)


@query("u02_merge_feeds_by_period", f"""SELECT ticker, date, {r('news_sentiment_1d', 'news_sentiment_1d')}, news_count_1d FROM (
SELECT * FROM news_a WHERE date <= DATE '2024-01-10'
UNION ALL SELECT * FROM news_b WHERE date > DATE '2024-01-10' AND date < DATE '2024-01-20'
UNION ALL SELECT a.* FROM news_a a WHERE a.date > DATE '2024-01-10' AND a.date < DATE '2024-01-20' AND NOT EXISTS (SELECT 1 FROM news_b b WHERE b.ticker=a.ticker AND b.date=a.date)
UNION ALL SELECT * FROM news_c WHERE date >= DATE '2024-01-20')""")
def _(t):
    return setops.merge_feeds_by_period(t.news_a(), t.news_b(), t.news_c(), "2024-01-10", "2024-01-20")


@query("u03_keep_highest_count", f"""SELECT ticker, date, {r('news_sentiment_1d', 'news_sentiment_1d')}, news_count_1d FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY news_count_1d DESC, p) AS i FROM (
 SELECT *, 0 AS p FROM news_a UNION ALL SELECT *, 1 AS p FROM news_b UNION ALL SELECT *, 2 AS p FROM news_c)) WHERE i = 1""")
def _(t):
    return setops.keep_highest([t.news_a(), t.news_b(), t.news_c()])


@query("u01_s08_keep_last_batch", f"""SELECT ticker, date, {r('news_sentiment_1d', 'news_sentiment_1d')}, news_count_1d FROM news_b
UNION ALL SELECT ticker, date, {r('news_sentiment_1d', 'news_sentiment_1d')}, news_count_1d FROM news_a a WHERE NOT EXISTS (SELECT 1 FROM news_b b WHERE a.ticker=b.ticker AND a.date=b.date)""")
def _(t):
    return setops.keep_last([t.news_a(), t.news_b()])


@query("s10_insert_new_keys", f"""SELECT ticker, date, {r('news_sentiment_1d', 'news_sentiment_1d')}, news_count_1d FROM news_a
UNION ALL SELECT ticker, date, {r('news_sentiment_1d', 'news_sentiment_1d')}, news_count_1d FROM news_b b WHERE NOT EXISTS (SELECT 1 FROM news_a a WHERE a.ticker=b.ticker AND a.date=b.date)""")
def _(t):
    return setops.insert_new(t.news_a(), t.news_b())


@query("j12_merge_live_feeds", f"""SELECT coalesce(a.ticker,b.ticker,c.ticker) AS ticker, coalesce(a.post_count_1d,0) AS post_count_1d, {r('coalesce(b.mention_growth_7d,1.0)', 'mention_growth_7d')}, {r('coalesce(c.st_bull_pct,0.5)', 'st_bull_pct')}
FROM (SELECT ticker, count(*) AS post_count_1d FROM posts_by_user WHERE date = DATE '2024-01-05' GROUP BY 1) a
FULL OUTER JOIN (SELECT ticker, count(*)/10.0E0 AS mention_growth_7d FROM posts_by_user WHERE date = DATE '2024-01-06' GROUP BY 1) b ON a.ticker=b.ticker
FULL OUTER JOIN (SELECT ticker, avg(CASE WHEN sentiment_label='positive' THEN 1.0 ELSE 0.0 END) AS st_bull_pct FROM posts_by_user WHERE date = DATE '2024-01-07' GROUP BY 1) c ON c.ticker=coalesce(a.ticker,b.ticker)""")
def _(t):
    p = t.posts_by_user()
    day = lambda d: p.where(F.col("date") == F.lit(d).cast("date")).groupBy("ticker")
    return joins.merge_live_feeds([
        (day("2024-01-05").agg(F.count(F.lit(1)).alias("post_count_1d")), {"post_count_1d": 0}),
        (day("2024-01-06").agg((F.count(F.lit(1)) / 10.0).alias("mention_growth_7d")), {"mention_growth_7d": 1.0}),
        (day("2024-01-07").agg(F.avg(F.when(F.col("sentiment_label") == "positive", 1.0).otherwise(0.0)).alias("st_bull_pct")), {"st_bull_pct": 0.5})])


# texts -------------------------------------------------------------------------------------------
_sym = ", ".join(f"('{s}')" for s in SYMBOLS)
MENTION = f"SELECT DISTINCT id, date, tok AS ticker FROM (SELECT id, date, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS tok FROM texts) WHERE tok IN (SELECT s FROM (VALUES {_sym}) v(s))"


@query("f01_symbol_mentions", f"SELECT id, date, ticker FROM ({MENTION})")
def _(t):
    return tx.symbol_mentions(t.texts().select("id", "date", "text"), "text", SYMBOLS).select("id", "date", "ticker")


@query("f02_unknown_symbols", """SELECT tok AS symbol, count(*) AS n_mentions FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS tok FROM texts)
WHERE regexp_full_match(tok, '[A-Z]{1,5}') AND tok NOT IN ('A','I','IT','US','UK','EU','THE') GROUP BY 1""")
def _(t):
    return tx.unknown_symbols(t.texts(), "text", known=["A", "I"], noise=["IT", "US", "UK", "EU", "THE"])


@query("o05_most_frequent_tokens", """SELECT tok AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS tok FROM texts) GROUP BY 1 ORDER BY n DESC, tok LIMIT 10""")
def _(t):
    d = t.texts().select(F.explode(F.regexp_extract_all("text", F.lit(tx.WORDS), F.lit(1))).alias("token"))
    return tx.most_frequent(d, "token")


@query("f03_build_text", """SELECT id, length(body) > 20 AS has_body, CASE WHEN length(body) > 20 THEN concat(trim(title), '. ', substr(body,1,500)) ELSE trim(title) END AS text FROM texts""")
def _(t):
    return tx.build_text(t.texts().drop("text")).select("id", "has_body", "text")


VALENCE = {"the": 0.5, "and": -0.3, "is": 1.1, "le": -0.7, "de": 0.2, "of": 0.9, "la": -1.3, "to": 0.4, "in": -0.6, "que": 0.8}
_val = ", ".join(f"('{k}',{v}::DOUBLE)" for k, v in VALENCE.items())
LEX = f"""SELECT t.id, coalesce(s.x,0) AS x FROM texts t LEFT JOIN (SELECT id, sum(v) AS x FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS tok FROM texts) JOIN (VALUES {_val}) l(w,v) ON tok=w GROUP BY 1) s ON s.id=t.id"""


@query("m25_lexicon_scores", f"SELECT id, {r('x/sqrt(x*x+15)', 'sentiment_score')} FROM ({LEX})")
def _(t):
    return lexicon.score_texts(t.texts().select("id", "text"), "text", VALENCE).select("id", "sentiment_score")


@query("m25_lexicon_table_form", f"SELECT id, {r('x/sqrt(x*x+15)', 'sentiment_score')} FROM ({LEX})")
def _(t):
    lex = t.spark.createDataFrame(list(VALENCE.items()), "token string, valence double")
    return lexicon.score_texts_by_table(t.texts().select("id", "text"), "text", "id", lex).select("id", "sentiment_score")


@query("m25_corpus_summary", f"""SELECT count(*) AS n, {r('avg(x/sqrt(x*x+15))', 'mean')}, {r('100*avg(CASE WHEN abs(x) < 1e-9 THEN 1.0 ELSE 0 END)', 'pct_zero')},
 {r('100*avg(CASE WHEN x >= 1e-9 THEN 1.0 ELSE 0 END)', 'pct_positive')}, {r('100*avg(CASE WHEN x <= -1e-9 THEN 1.0 ELSE 0 END)', 'pct_negative')} FROM ({LEX})""")
def _(t):
    s = lexicon.score_texts(t.texts().select("id", "text"), "text", VALENCE)
    return lexicon.corpus_summary(s.withColumn("sentiment_score", F.round("sentiment_score", 10)))


@query("x04_batch_text_scorer", """SELECT id, CASE WHEN length(text) % 3 = 0 THEN 'neutral' WHEN length(text) % 3 = 1 THEN 'positive' ELSE 'negative' END AS label FROM texts""")
def _(t):
    def by_length(batch):
        names = ["neutral", "positive", "negative"]
        return [(names[len(x) % 3], float(len(x) % 3) - 1.0, 1.0) for x in batch]
    return lexicon.score_batches(t.texts().select("id", "text"), "text", by_length).select("id", "label")


@query("j07_texts_to_keys", f"SELECT m.ticker, t.id, length(t.title) AS title_chars FROM texts t JOIN ({MENTION}) m ON m.id=t.id WHERE m.ticker <> 'Of'")
def _(t):
    bridge = tx.symbol_mentions(t.texts().select("id", "text"), "text", SYMBOLS).select(F.col("id").alias("post_id"), "ticker", "confidence", F.when(
        F.col("ticker") == "Of", "false_positive").otherwise(F.col("match_type")).alias("match_type"))
    return joins.texts_to_keys(t.texts().select("id", "title"), filters.matched(bridge)).select(
        "ticker", "id", F.char_length("title").cast("bigint").alias("title_chars"))


@query("p20_match_quality", f"SELECT id, ticker FROM ({MENTION}) WHERE ticker <> 'Of'")
def _(t):
    m = tx.symbol_mentions(t.texts().select("id", "text"), "text", SYMBOLS).withColumn(
        "match_type", F.when(F.col("ticker") == "Of", "false_positive").otherwise(F.col("match_type")))
    return filters.matched(m).select("id", "ticker")


@query("j11_alias_coverage", f"""SELECT r.k AS ticker, coalesce(n,0) AS n_posts, first_date, last_date FROM (SELECT DISTINCT k FROM (VALUES {_alias_rows}) l(al,k)) r LEFT JOIN (
 SELECT k, count(DISTINCT id) AS n, min(date) AS first_date, max(date) AS last_date FROM texts JOIN (VALUES {_alias_rows}) l(al,k) ON contains(lower(text), al) GROUP BY 1) h ON h.k=r.k""")
def _(t):
    return joins.alias_coverage(t.texts(), ALIASES)


@query("p10_normalise_posts", """SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 10 = 0 THEN 'deleted' ELSE source END AS author, trim(title) AS title, CASE WHEN id % 7 = 0 THEN '' ELSE trim(body) END AS selftext, id % 50 AS score,
 CAST(make_timestamp((1704067200 + id*3600)*1000000) AS DATE) AS date, CAST(year(make_timestamp((1704067200 + id*3600)*1000000)) AS INT) AS year FROM texts""")
def _(t):
    raw = t.texts().select(
        "id", F.col("source").alias("subreddit"),
        F.when(F.col("id") % 20 == 0, "[deleted]").when(F.col("id") % 20 == 10, "").otherwise(F.col("source")).alias("author"), "title",
        F.when(F.col("id") % 7 == 0, "[removed]").otherwise(F.col("body")).alias("selftext"), (F.col("id") % 50).alias("score"),
        F.lit(None).cast("bigint").alias("num_comments"), (1704067200 + F.col("id") * 3600).alias("created_utc"))
    return filters.normalise_posts(raw).select("id", "author", "title", "selftext", "score", "date", "year")


BOT = """SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'AutoModerator' ELSE role END AS author, CASE WHEN turn % 6 = 5 THEN '[removed]' ELSE text END AS body FROM conversations"""


def _raw_comments(t):
    return t.base("conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("t3_"), F.col("conv_id")).alias("link_id"),
        F.when(F.col("turn") % 4 == 3, "AutoModerator").otherwise(F.col("role")).alias("author"),
        F.when(F.col("turn") % 6 == 5, "[removed]").otherwise(F.col("text")).alias("body"), (F.col("turn") % 9).alias("score"),
        (1704067200 + F.col("conv_id") * 600).alias("created_utc"))


@query("p11_bot_and_empty_counts", f"""SELECT CASE WHEN author='AutoModerator' THEN 'bot' WHEN trim(body) IN ('','[removed]','[deleted]') THEN 'empty' ELSE 'kept' END AS drop_reason, count(*) AS n FROM ({BOT}) GROUP BY 1""")
def _(t):
    return filters.drop_counts(filters.with_drop_reason(_raw_comments(t), filters.comment_rules(filters.KNOWN_BOTS)))


@query("p10_normalise_comments", f"""SELECT CAST(conv_id*1000+turn AS VARCHAR) AS id, CAST(conv_id AS VARCHAR) AS link_id, author, turn % 9 AS score FROM ({BOT}) WHERE author <> 'AutoModerator' AND trim(body) NOT IN ('','[removed]','[deleted]')""")
def _(t):
    return filters.normalise_comments(_raw_comments(t)).select("id", "link_id", "author", "score")


@query("p12_sentiment_eligible", "SELECT post_id, sentiment_score FROM posts WHERE NOT (sentiment_score = 0 AND NOT has_body)")
def _(t):
    return t.posts().where(filters.sentiment_eligible()).select("post_id", "sentiment_score")


@query("p19_high_engagement", "SELECT post_id FROM posts WHERE score >= 10 OR num_comments >= 20")
def _(t):
    return filters.high_engagement(t.posts()).select("post_id")


@query("p19_high_engagement_titled", "SELECT id FROM texts WHERE (id % 100 >= 50 OR id % 90 >= 50) AND length(title) >= 10")
def _(t):
    d = t.texts().withColumns({"score": F.col("id") % 100, "num_comments": F.col("id") % 90})
    return filters.high_engagement(d, 50, 50, title="title").select("id")


@query("f20_classifier_features", f"""SELECT id, {r("len(list_filter(regexp_split_to_array(trim(title), '\\s+'), lambda w: w <> ''))", 'title_length')}, {r('CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END', 'has_body_f')}, {r('ln(1 + id % 50)', 'log_score')},
 {r('ln(1 + id % 40)', 'log_comments')}, {r('CAST(((1704067200 + id*977) % 86400)//3600 AS DOUBLE)', 'hour_of_day')}, {r("CASE source WHEN 'web' THEN 1 WHEN 'code' THEN 2 ELSE 0 END", 'source_code')} FROM texts""")
def _(t):
    d = t.texts().select("id", "title", "source", (F.col("id") % 3 == 0).alias("has_body"), (F.col("id") % 50).alias("score"),
                         (F.col("id") % 40).alias("num_comments"), (1704067200 + F.col("id") * 977).alias("created_utc"))
    return tx.classifier_features(d, {"web": 1, "code": 2}).select(
        "id", "title_length", "has_body_f", "log_score", "log_comments", "hour_of_day", "source_code")


# dates --------------------------------------------------------------------------------------------
@query("f08_market_times_utc", """SELECT DISTINCT CAST(ts AS DATE) AS date, strftime(CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 870 MINUTE, '%Y-%m-%d %H:%M:%S') AS open_utc,
 strftime(CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1260 MINUTE, '%Y-%m-%d %H:%M:%S') AS close_utc, isodow(ts) <= 5 AS weekday, strftime(CAST(ts AS DATE), '%Y%m%d') AS compact, CAST(ts AS DATE) AS parsed FROM events""")
def _(t):
    d = t.base("events").select(F.to_date("ts").alias("date")).distinct()
    f = "yyyy-MM-dd HH:mm:ss"
    return d.select("date", F.date_format(dates.market_open_utc(F.col("date")), f).alias("open_utc"),
                    F.date_format(dates.market_close_utc(F.col("date")), f).alias("close_utc"), dates.is_weekday(F.col("date")).alias("weekday"),
                    F.date_format("date", "yyyyMMdd").alias("compact"), dates.compact_date(F.date_format("date", "yyyyMMdd")).alias("parsed"))


@query("f08_date_windows", """SELECT CAST(w AS DATE) AS window_start, least(CAST(w AS DATE) + 7, e) AS window_end FROM (SELECT unnest(generate_series(s, e - 1, INTERVAL 7 DAY)) AS w, e FROM (SELECT min(CAST(o_orderdate AS DATE)) AS s, max(CAST(o_orderdate AS DATE)) AS e FROM orders))""")
def _(t):
    d = F.to_date("o_orderdate")
    return dates.date_windows(t.base("orders").agg(F.min(d).alias("start"), F.max(d).alias("end")), 7)


@query("f08_epoch_and_hour", "SELECT event_id, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INT) AS hour FROM events")
def _(t):
    e = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return t.base("events").select("event_id", F.to_date(dates.unix_to_utc(e)).alias("date"), dates.hour_of_day(e).alias("hour"))


@query("f09_regime_period", """SELECT date, CASE WHEN d < DATE '2020-02-01' THEN 'bull_2019' WHEN d < DATE '2020-06-01' THEN 'covid_crash' WHEN d < DATE '2021-01-01' THEN 'covid_recovery' WHEN d < DATE '2022-01-01' THEN 'meme_bull_2021'
 WHEN d < DATE '2023-01-01' THEN 'bear_2022' WHEN d < DATE '2024-01-01' THEN 'recovery_2023' ELSE 'ai_bull_2024' END AS regime FROM (SELECT DISTINCT date, date + 8766 AS d FROM bars)""")
def _(t):
    return t.bars().select("date").distinct().select("date", dates.regime_period(F.date_add("date", 8766)).alias("regime"))


@query("w36_shift_trading_days", """WITH days AS (SELECT DISTINCT date FROM bench), q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT q.date, EXISTS (SELECT 1 FROM days d WHERE d.date=q.date) AS is_trading_day,
 (SELECT d.date FROM days d WHERE d.date > q.date ORDER BY d.date LIMIT 1 OFFSET 2) AS next_3,
 (SELECT d.date FROM days d WHERE d.date < q.date ORDER BY d.date DESC LIMIT 1 OFFSET 1) AS prev_2 FROM q""")
def _(t):
    q = t.base("orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    days = t.bench().select("date")
    nxt = windows.shift_trading_days(q, days, 3, out="next_3")
    prv = windows.shift_trading_days(q, days, -2, out="prev_2").drop("is_trading_day")
    return nxt.join(prv, "date").select("date", "is_trading_day", "next_3", "prev_2")


# extension points ------------------------------------------------------------------------------------------
@query("x05_group_function", f"SELECT ticker, date, {r('count - avg(count) OVER (PARTITION BY ticker)', 'centred')} FROM daily_small")
def _(t):
    from pulsegrid.operators.extend import per_key

    def centre(pdf):
        return pdf[["ticker", "date"]].assign(centred=(pdf["count"] - pdf["count"].mean()).astype(float))
    return per_key(t.daily_small(), ["ticker"], centre, "ticker string, date date, centred double")


@query("x06_row_generator", """SELECT id, CAST(unnest(range(len(string_split(title, ' ')))) AS INT) AS pos, unnest(string_split(title, ' ')) AS word FROM texts""")
def _(t):
    from pulsegrid.operators.extend import generate_rows
    return generate_rows(t.texts(), "title", lambda v: enumerate(v.split(" ")), "pos int, word string", keep=["id"])


@query("x06_table_function", """SELECT id, CAST(unnest(range(len(string_split(title, ' ')))) AS INT) AS pos, unnest(string_split(title, ' ')) AS word FROM texts""")
def _(t):
    """The same rows from SQL: a table function over a partitioned table argument."""
    from pulsegrid.operators.extend import table_function

    t.spark.udtf.register("title_words", table_function(lambda v: enumerate((v or "").split(" ")), "pos int, word string"))
    t.texts().select("id", "title").createOrReplaceTempView("titled")
    return t.spark.sql("SELECT id, pos, word FROM title_words(TABLE(titled) PARTITION BY (id), 'title')")
