"""Queries that build whole panels, score them, or fit models."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from pulsegrid.models import learners, stumps as st
from pulsegrid.operators import ic, rollups, setops
from pulsegrid.operators.ordering import row_index
from pulsegrid.plans import panel as jobs, studies
from pulsegrid.plans.catalog import query, r
from pulsegrid.plans.queries_posts import ALIASES  # noqa: F401  (documents share the same feeds)
from pulsegrid.plans.queries_signals import BASE, STUMPS, SV
from pulsegrid.session import settle

FEATS = ["post_count_1d", "sentiment_1d", "returns_1d", "returns_20d", "relative_volume"]
Y = "target_return_5d"
FAM = {"market": ["returns_1d", "returns_20d", "relative_volume"], "attention": ["post_count_1d"], "sentiment": ["sentiment_1d"]}


def _calendar_inputs(t):
    bars = t.event_bars()
    bench = bars.where("ticker = 'U0'").select("date", "close")
    fear = t.base("events").groupBy(F.to_date("ts").alias("date")).agg(
        (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("value"))
    news = setops.merge_feeds_by_period(t.news_a(), t.news_b(), t.news_c(), "2024-01-10", "2024-01-20")
    return t.posts_small(), t.comments(), news, bars, bench, fear


def _calendar_panel(t):
    return jobs.calendar_panel(*_calendar_inputs(t), start="2024-01-03", end="2024-01-28")


L = "(PARTITION BY ticker ORDER BY date)"


def _f(n):
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_jump = " + ".join(f"coalesce(lag(j,{i}) OVER {L},0.0)*{1 - i / 20!r}" for i in range(1, 20))
PANEL2 = {
    "fear": "SELECT CAST(ts AS DATE) AS date, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE)/COUNT(*) AS value FROM events GROUP BY 1",
    "fear_pct": "SELECT date, CASE WHEN len(w) >= 20 THEN CAST(len(list_filter(w, lambda x: x < value)) AS DOUBLE)/len(w) ELSE 0.5 END AS p FROM (SELECT date, value, list(value) OVER (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS w FROM fear)",
    "b2": "SELECT date, close FROM event_bars WHERE ticker='U0'",
    "above": "SELECT date, CASE WHEN count(*) OVER (ORDER BY date) >= 100 AND close > avg(close) OVER (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) THEN 1.0 ELSE 0.0 END AS a FROM b2",
    "mk1": f"SELECT *, close/lag(close,1) OVER {L} - 1 AS ret, close - lag(close,1) OVER {L} AS dl FROM event_bars",
    "mk2": "SELECT *, CASE WHEN abs(ret) > 0.05 THEN ret ELSE 0.0 END AS j, CASE WHEN dl IS NOT NULL THEN greatest(dl,0) END AS up, CASE WHEN dl IS NOT NULL THEN greatest(-dl,0) END AS dn FROM mk1",
    "mk3": f"""SELECT ticker, date, close, volume, ret AS returns_1d, close/lag(close,20) OVER {L} - 1 AS returns_20d, CASE WHEN count(dl) OVER {_f(14)} >= 14 THEN avg(up) OVER {_f(14)} END AS g, CASE WHEN count(dl) OVER {_f(14)} >= 14 THEN avg(dn) OVER {_f(14)} END AS l,
 coalesce(CASE WHEN count(volume) OVER {_f(20)} >= 5 THEN volume/avg(volume) OVER {_f(20)} END,1.0) AS relative_volume, coalesce(CASE WHEN count(close) OVER {_f(20)} >= 10 THEN (close-avg(close) OVER {_f(20)})/avg(close) OVER {_f(20)} END,0.0) AS dist,
 greatest(-0.1,least(0.1,{_jump})) AS pead, lead(close,1) OVER {L}/close-1 AS t1, lead(close,3) OVER {L}/close-1 AS t3, lead(close,5) OVER {L}/close-1 AS t5 FROM mk2""",
    "days": "SELECT CAST(unnest(generate_series(DATE '2023-12-24', DATE '2024-01-28', INTERVAL 1 DAY)) AS DATE) AS date",
    "pd": """SELECT ticker, date, count(*) AS c, sum(num_comments) AS m, coalesce(sum(CASE WHEN NOT (sentiment_score = 0 AND NOT has_body) THEN sentiment_score END),0) AS s, count(CASE WHEN NOT (sentiment_score = 0 AND NOT has_body) THEN sentiment_score END) AS n, coalesce(sum(abs(sentiment_score)),0) AS a FROM posts_small GROUP BY 1,2""",
    "pg": "SELECT k.ticker, d.date, coalesce(c,0) AS c, coalesce(m,0) AS m, coalesce(s,0.0) AS s, coalesce(n,0) AS n, coalesce(a,0.0) AS a FROM (SELECT DISTINCT ticker FROM pd) k CROSS JOIN days d LEFT JOIN pd ON pd.ticker=k.ticker AND pd.date=d.date",
    "pf": """SELECT ticker, date, lag(c) OVER w AS c1, lag(m) OVER w AS m1, coalesce(lag(s) OVER w/nullif(lag(n) OVER w,0),0) AS v1, coalesce(sum(s) OVER w3/nullif(sum(n) OVER w3,0),0) AS v3, coalesce(lag(a) OVER w/nullif(lag(c) OVER w,0),0) AS ext FROM pg
 WINDOW w AS (PARTITION BY ticker ORDER BY date), w3 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
    "cd": "SELECT p.ticker, c.date, coalesce(sum(CASE WHEN c.score <> 0 THEN c.score END),0) AS s, count(CASE WHEN c.score <> 0 THEN 1 END) AS n FROM comments c JOIN (SELECT CAST(post_id AS VARCHAR) AS pid, min(ticker) AS ticker FROM posts_small GROUP BY 1) p ON replace(c.link_id,'t3_','')=p.pid GROUP BY 1,2",
    "cg": "SELECT k.ticker, d.date, coalesce(s,0.0) AS s, coalesce(n,0) AS n FROM (SELECT DISTINCT ticker FROM cd) k CROSS JOIN days d LEFT JOIN cd ON cd.ticker=k.ticker AND cd.date=d.date",
    "cf": "SELECT ticker, date, coalesce(lag(s) OVER w/nullif(lag(n) OVER w,0),0) AS cs FROM cg WINDOW w AS (PARTITION BY ticker ORDER BY date)",
    "nw": """SELECT * FROM news_a WHERE date <= DATE '2024-01-10' UNION ALL SELECT * FROM news_b WHERE date > DATE '2024-01-10' AND date < DATE '2024-01-20'
 UNION ALL SELECT a.* FROM news_a a WHERE a.date > DATE '2024-01-10' AND a.date < DATE '2024-01-20' AND NOT EXISTS (SELECT 1 FROM news_b b WHERE b.ticker=a.ticker AND b.date=a.date) UNION ALL SELECT * FROM news_c WHERE date >= DATE '2024-01-20'""",
    "grid": "SELECT k.ticker, d.date FROM (SELECT DISTINCT ticker FROM event_bars) k CROSS JOIN (SELECT date FROM b2 WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-28') d",
    "jn": """SELECT g.ticker, g.date, m.*EXCLUDE(ticker,date), coalesce(pf.c1,0) AS pc, coalesce(pf.m1,0) AS tc, coalesce(v1,0) AS v1, coalesce(ext,0) AS ext, coalesce(v1-v3,0) AS acc, coalesce(cs,0) AS cs, coalesce(news_sentiment_1d,0) AS ns, coalesce(news_count_1d,0) AS nc,
 coalesce((SELECT arg_max(p,f.date) FROM fear_pct f WHERE f.date <= g.date),0.5) AS vp, coalesce((SELECT arg_max(a,f.date) FROM above f WHERE f.date <= g.date),0.0) AS sa
FROM grid g LEFT JOIN mk3 m ON m.ticker=g.ticker AND m.date=g.date LEFT JOIN pf ON pf.ticker=g.ticker AND pf.date=g.date LEFT JOIN cf ON cf.ticker=g.ticker AND cf.date=g.date LEFT JOIN nw ON nw.ticker=g.ticker AND nw.date=g.date""",
}


@query("e2_calendar_panel", f"""SELECT ticker, date, year, split, {r('1.5', 'sample_weight')}, {r('pc', 'post_count_1d')}, {r('abn', 'abnormal_attention_1d')}, {r('tc', 'total_comments_1d')}, {r('v1', 'vader_sentiment_1d')}, {r('ext', 'sentiment_extremity')}, {r('acc', 'sentiment_accel')},
 {r('cs', 'comment_sentiment_1d')}, {r('volume', 'volume')}, {r('relative_volume', 'relative_volume')}, {r('returns_1d', 'returns_1d')}, {r('returns_20d', 'returns_20d')}, {r('coalesce(100-100/(1+g/nullif(l,0)),50)', 'rsi_14')}, {r('dist', 'dist_from_20ma_pct')}, {r('pead', 'pead_proxy')},
 {r('ns', 'news_sentiment_1d')}, {r('nc', 'news_count_1d')}, {r('vp', 'vix_percentile')}, {r('sa', 'spy_above_200ma')}, {r('0.6*sa+0.4*(1-vp)', 'regime_score')}, {r('vp*relative_volume', 'vix_x_volume')}, {r('t1', 'target_return_1d')}, {r('t3', 'target_return_3d')}, {r('t5', 'target_return_5d')}, {r('close', 'close')}
FROM (SELECT *, CAST(year(date) AS INTEGER) AS year, 'test' AS split, least(10.0, pc/(coalesce(CASE WHEN count(pc) OVER {_f(20)} >= 5 THEN avg(pc) OVER {_f(20)} END,1.0)+1.0)) AS abn FROM jn) WHERE close IS NOT NULL AND volume > 0""", views=PANEL2)
def _(t):
    """Whole calendar-day panel from posts, comments, news and bars."""
    d = _calendar_panel(t)
    return d.withColumns({c: F.col(c).cast("double") for c in ("post_count_1d", "total_comments_1d", "news_count_1d")})


def _preopen(t, **kw):
    bars = t.event_bars()
    return jobs.preopen_panel(t.posts_small(), bars, test_start="2024-01-20", excluded=["U3"], min_count=10,
                              market_required=["close", "volume", "returns_1d"], **kw)


def _e1_sql() -> str:
    """The pre-open panel: attention windows, recursive indicators, filters and split."""
    from pulsegrid.plans.queries_posts import W1_SQL

    w = f"OVER {L}"
    def full(n, expr):
        return f"CASE WHEN count(*) OVER {_f(n)} >= {n} THEN {expr.format(f=_f(n))} END"
    soc = W1_SQL.format(src="(SELECT * FROM posts_small WHERE ticker <> 'U3')").replace("FROM posts)", "FROM event_bars)", 1)
    step = "UNION ALL SELECT s.ticker, s.i, {0} FROM {1} f JOIN {2} s ON s.ticker=f.ticker AND s.i=f.i+1"
    return f"""WITH RECURSIVE s1 AS (SELECT ticker, date, close, volume, high, low, row_number() {w} AS i, close-lag(close) {w} AS d, greatest(high-low, coalesce(abs(high-lag(close) {w}),0), coalesce(abs(low-lag(close) {w}),0)) AS tr FROM event_bars),
s2 AS (SELECT ticker, i-1 AS i, greatest(d,0) AS up, greatest(-d,0) AS dn FROM s1 WHERE d IS NOT NULL),
ra AS (SELECT ticker, i, tr AS atr FROM s1 WHERE i=1 {step.format('f.atr+(s.tr-f.atr)/14', 'ra', 's1')}),
rr AS (SELECT ticker, i, up AS g, dn AS l FROM s2 WHERE i=1 {step.format('f.g+(s.up-f.g)/14, f.l+(s.dn-f.l)/14', 'rr', 's2')}),
mk AS (SELECT s1.ticker, date, close, volume, close/lag(close,1) {w}-1 AS returns_1d, close/lag(close,5) {w}-1 AS returns_5d, close/lag(close,20) {w}-1 AS returns_20d, {full(20, 'volume/avg(volume) OVER {f}')} AS relative_volume,
 {full(20, 'close/avg(close) OVER {f}-1')} AS dist_from_20ma, {full(50, 'close/avg(close) OVER {f}-1')} AS dist_from_50ma, lead(close,5) {w}/close-1 AS target_return_5d, lead(close,3) {w}/close-1 AS target_return_3d, lead(close,1) {w}/close-1 AS target_return_1d, lead(close,10) {w}/close-1 AS target_return_10d, i FROM s1),
soc AS ({soc})
SELECT soc.*, {', '.join(r('m.' + c, c, 9) for c in ('close', 'volume', 'returns_1d', 'returns_5d', 'returns_20d'))}, {r('CASE WHEN m.i >= 15 THEN 100*rr.g/nullif(rr.g+rr.l,0) END', 'rsi_14', 9)}, {r('ra.atr/m.close', 'atr_14', 9)},
 {', '.join(r('m.' + c, c, 9) for c in ('relative_volume', 'dist_from_20ma', 'dist_from_50ma', 'target_return_5d', 'target_return_3d', 'target_return_1d', 'target_return_10d'))}, CASE WHEN soc.date < DATE '2024-01-20' THEN 'train' ELSE 'test' END AS split
FROM soc JOIN mk m ON m.ticker=soc.ticker AND m.date=soc.date JOIN ra ON ra.ticker=m.ticker AND ra.i=m.i LEFT JOIN rr ON rr.ticker=m.ticker AND rr.i=m.i-1
WHERE m.target_return_5d IS NOT NULL AND abs(m.target_return_5d) <= 0.5 AND m.returns_1d IS NOT NULL"""


@query("e1_preopen_panel", _e1_sql(), digits=9)
def _(t):
    return _preopen(t)[0]


@query("e1_preopen_drop_reasons", """WITH p AS (SELECT b.ticker, b.date, b.close, count(*) AS n FROM event_bars b JOIN posts_small s ON s.ticker=b.ticker AND s.timestamp < CAST(b.date AS TIMESTAMP) + INTERVAL 870 MINUTE AND s.timestamp >= CAST(b.date AS TIMESTAMP) + INTERVAL 870 MINUTE - INTERVAL 24 HOUR WHERE b.ticker <> 'U3' GROUP BY 1,2,3),
m AS (SELECT ticker, date, close/lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r1, lead(close,5) OVER (PARTITION BY ticker ORDER BY date)/close-1 AS t5 FROM event_bars)
SELECT CASE WHEN t5 IS NULL THEN 'null_target' WHEN abs(t5) > 0.5 THEN 'extreme_target' WHEN r1 IS NULL THEN 'null_market' ELSE 'kept' END AS drop_reason, count(*) AS n FROM p JOIN m ON m.ticker=p.ticker AND m.date=p.date WHERE p.n >= 10 GROUP BY 1""")
def _(t):
    return _preopen(t)[1]


MODEL = ["returns_1d", "returns_20d", "relative_volume", "sentiment_1d", "post_count_1d"]


@query("e3_daily_signals", f"""WITH w AS (SELECT ticker, date, max(CASE WHEN horizon='1d' THEN s+0.001 END) AS p1, max(CASE WHEN horizon='3d' THEN s+0.002 END) AS p3, max(CASE WHEN horizon='5d' THEN s+0.0045 END) AS p5 FROM (SELECT ticker, date, horizon, sum(leaf) AS s FROM leaves GROUP BY 1,2,3) GROUP BY 1,2),
c AS (SELECT w.ticker, w.date, CASE WHEN p5 >= 0.015 OR p3 >= 0.015 OR p1 >= 0.015 THEN 'BULLISH' WHEN p5 <= -0.015 OR p3 <= -0.015 OR p1 <= -0.015 THEN 'BEARISH' ELSE 'NEUTRAL' END AS signal, round(p5,9)+0.0E0 AS pred_5d, CASE WHEN w.ticker='SMALL' THEN 'Unknown' ELSE 'goods' END AS sector
 FROM w JOIN panel p ON p.ticker=w.ticker AND p.date=w.date WHERE p.post_count_1d >= 3 AND greatest(abs(p1),abs(p3),abs(p5)) >= 0.005),
k AS (SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY CASE signal WHEN 'BULLISH' THEN 0 WHEN 'NEUTRAL' THEN 1 ELSE 2 END, CASE signal WHEN 'BULLISH' THEN -pred_5d WHEN 'NEUTRAL' THEN -abs(pred_5d) ELSE pred_5d END, ticker) AS i FROM c)
SELECT ticker, date, signal, sector FROM k WHERE i <= 3 OR sector = 'Unknown'""", views=SV)
def _(t):
    sectors = t.bars().select("ticker").distinct().withColumn("sector", F.when(F.col("ticker") == "SMALL", "Unknown").otherwise("goods"))
    model = t.spark.createDataFrame(STUMPS, st.STUMP_SCHEMA)
    return jobs.daily_signals(t.panel(), model, BASE, MODEL, sectors=sectors).select("ticker", "date", "signal", "sector")


# models ------------------------------------------------------------------------------------------------
@query("m20_boosted_stumps")
def _(t):
    """Both horizons: tree count chosen on validation rows; IC, accuracy and the stumps per period."""
    p = settle(t.panel(), "panel")
    of = lambda y, h: learners.train_horizon(p, FEATS, y, val_start="1998-07-01", test_start="1999-01-01", gate=3, n_trees=1000, horizon=h)
    return of("target_return_1d", "1d").unionByName(of(Y, "5d"))


#: Every combination of the sources.
LATTICE = {"+".join(k): [f for s in k for f in FAM[s]] for n in (1, 2, 3) for k in combinations(FAM, n)}


@query("m21_walk_forward_ablation")
def _(t):
    p = settle(t.panel(), "panel")
    return learners.walk_forward_ics(p, LATTICE, learners.year_windows(p, Y), Y, n_trees=500, depth=4)


def _refits(t):
    p = settle(t.panel().where(F.col(Y).isNotNull()).select("ticker", "date", "year", Y, *FEATS), "panel")
    tr = row_index(p.where("year <= 1997"), ["date", "ticker"], F.datediff("date", F.lit("1970-01-01").cast("date")).cast("double"))
    return tr, p.where("year > 1997")


@query("m22_refit_permutation")
def _(t):
    tr, te = _refits(t)
    return learners.refit_permutation(tr, te, FEATS, ["sentiment_1d"], Y, "row_index", n=100, n_trees=500, depth=4)


@query("m23_learning_curve")
def _(t):
    return learners.learning_curve(t.panel(), FEATS, Y, test_start="1999-01-01", shares=(0.25, 0.5, 0.75, 1.0), n_trees=100)


@query("m23_selection_bias")
def _(t):
    return learners.selection_bias(t.panel(), FEATS, Y, test_start="1999-01-01")


@query("m26_source_lattice")
def _(t):
    """Every combination of sources in expanding windows, with the Granger years of each source and the verdict."""
    return studies.source_lattice(settle(t.panel(), "panel"), FAM, Y, "market")


@query("m27_adoption_from_runs")
def _(t):
    """Gates from a refit permutation, the monthly ICs of the panel and two walk-forward runs."""
    p = settle(t.panel(), "panel")
    tr, te = _refits(t)
    perm = learners.refit_permutation(tr, te, FEATS, ["sentiment_1d"], Y, "row_index", n=100, n_trees=500, depth=4)
    runs = settle(learners.walk_forward_ics(p, {"clean": FAM["market"], "original": FEATS}, learners.year_windows(p, Y), Y), "runs")
    monthly = ic.grouped_ic(p, "returns_1d", Y, F.date_format("date", "yyyy-MM"))
    return studies.adoption_from_runs(p, monthly, perm, runs, Y)


@query("m24_logistic_regime")
def _(t):
    """Balanced two-class model on bars, by-year split, precision and recall on later years."""
    p = t.panel().where(F.col(Y).isNotNull()).withColumn("up", F.when(F.col(Y) > 0, "up").otherwise("down"))
    tr = learners.balanced_weights(p.where("split = 'train'"), "up")
    model, labels = learners.fit_logistic(tr, FEATS, "up", weight="class_weight", max_iter=1000)
    return rollups.confusion(learners.predict_logistic(model, labels, p.where("split = 'test'"), FEATS), "up", "pred_label")


@query("m24_logistic_text_label")
def _(t):
    """Three-class label of posts from scores and counts, 80/20 by date."""
    cols = ["sentiment_score", "log_score", "log_comments", "sentiment_conf"]
    d = t.posts().where("sentiment_label IS NOT NULL").withColumns({
        "log_score": F.log1p(F.greatest(F.col("score"), F.lit(0)).cast("double")), "log_comments": F.log1p(F.col("num_comments").cast("double"))})
    d = learners.time_ordered_share(d)
    model, labels = learners.fit_logistic(d.where("is_train"), cols, "sentiment_label", max_iter=1000)
    return rollups.confusion(learners.predict_logistic(model, labels, d.where("NOT is_train"), cols), "sentiment_label", "pred_label")
