"""Queries over signals: scores, rules, sizing, exits, ranking, universe staging, stump models."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import signals as sig
from pulsegrid.models import stumps as st
from pulsegrid.operators import equity, filters, joins, ranking, resample, technical as tech
from pulsegrid.plans.catalog import query, r, rs
from pulsegrid.plans.queries_stats import mix_sql

W = "(PARTITION BY ticker ORDER BY date)"
W20 = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("f10_regime_score", f"""SELECT ticker, date, {r('0.6*a + 0.4*(1-p)', 'regime_score')}, {r('p*rv', 'vix_x_volume')} FROM (SELECT ticker, date, CASE WHEN count(close) OVER {W20} >= 20 AND close > avg(close) OVER {W20} THEN 1.0 ELSE 0.0 END AS a,
 (n_lines % 10)/10.0E0 AS p, coalesce(CASE WHEN count(volume) OVER {W20} >= 5 THEN volume/avg(volume) OVER {W20} END,1.0) AS rv FROM bars)""")
def _(t):
    d = tech.above_average(t.bars(), 20, 20, out="spy_above_200ma")
    d = tech.relative_volume(d, 20, 5, 1.0).withColumn("vix_percentile", (F.col("n_lines") % 10) / 10.0)
    return d.select("ticker", "date", sig.regime_score().alias("regime_score"), sig.fear_volume().alias("vix_x_volume"))


@query("f11_composite_and_vol_adjusted", f"""SELECT ticker, date, {r('s', 'composite_score')}, {r('CASE WHEN v IS NULL OR v <= 0 THEN s ELSE s*0.02/greatest(0.005,least(0.08,v)) END', 'adj_score')}
FROM (SELECT ticker, date, 0.5*pred_5d+0.3*pred_3d+0.2*pred_1d AS s, CASE WHEN n_lines > 2 THEN (n_lines % 9)/100.0E0 - 0.01 END AS v FROM predictions)""")
def _(t):
    d = t.predictions().withColumn("vol", F.when(F.col("n_lines") > 2, (F.col("n_lines") % 9) / 100.0 - 0.01))
    return d.select("ticker", "date", sig.composite_score().alias("composite_score"), sig.volatility_adjusted(sig.composite_score(), "vol").alias("adj_score"))


SIDE = """CASE WHEN pred_5d >= 0.015 THEN 'BULLISH' WHEN pred_3d >= 0.015 THEN 'BULLISH' WHEN pred_1d >= 0.015 THEN 'BULLISH' WHEN pred_5d <= -0.015 THEN 'BEARISH' WHEN pred_3d <= -0.015 THEN 'BEARISH' WHEN pred_1d <= -0.015 THEN 'BEARISH' ELSE 'NEUTRAL' END"""
HZ = "CASE WHEN pred_5d >= 0.015 THEN '5D' WHEN pred_3d >= 0.015 THEN '3D' WHEN pred_1d >= 0.015 THEN '1D' WHEN pred_5d <= -0.015 THEN '5D' WHEN pred_3d <= -0.015 THEN '3D' WHEN pred_1d <= -0.015 THEN '1D' ELSE '5D' END"
SIGNALS = {
    "signals": f"""SELECT *, {SIDE} AS signal, {HZ} AS horizon FROM predictions WHERE greatest(abs(pred_1d),abs(pred_3d),abs(pred_5d)) >= 0.005""",
    "sigs": "SELECT *, CASE horizon WHEN '5D' THEN pred_5d WHEN '3D' THEN pred_3d ELSE pred_1d END AS best, CAST(substr(horizon,1,1) AS INT) AS hold_days FROM signals",
}


def _signals(t):
    return sig.classify_signals(t.predictions())


@query("f12_signal_rule", f"SELECT ticker, date, signal, hold_days, horizon, {r('round(least(abs(best)/0.03,1.0),4)', 'confidence')}, {r('best', 'predicted_return')} FROM sigs", views=SIGNALS)
def _(t):
    return _signals(t).select("ticker", "date", "signal", "hold_days", "horizon", "confidence", "predicted_return")


@query("f12_price_targets", f"SELECT ticker, date, {r('100*(1+pred_1d)', 'price_target_1d')}, {r('100*(1+pred_3d)', 'price_target_3d')}, {r('100*(1+pred_5d)', 'price_target_5d')} FROM sigs", views=SIGNALS)
def _(t):
    d = sig.classify_signals(t.predictions().withColumn("close", F.lit(100.0)))
    return d.select("ticker", "date", "price_target_1d", "price_target_3d", "price_target_5d")


@query("f13_put_call_label", f"""SELECT ticker, expiry, {r('pcr', 'pcr')}, CASE WHEN pcr IS NULL THEN 'UNKNOWN' WHEN pcr < 0.7 THEN 'CONFIRM' WHEN pcr <= 1.0 THEN 'NEUTRAL' ELSE 'CAUTION' END AS confirmation, {r('CASE WHEN pcr > 1.0 THEN 0.5 ELSE 1.0 END', 'size_multiplier')}
FROM (SELECT ticker, expiry, sum(CASE WHEN side='put' THEN volume ELSE 0 END)/nullif(sum(CASE WHEN side='call' THEN volume ELSE 0 END),0) AS pcr FROM chain GROUP BY 1,2)""")
def _(t):
    from pulsegrid.functions.exprs import ratio
    g = t.chain().groupBy("ticker", "expiry").agg(F.sum(F.when(F.col("side") == "put", F.col("volume")).otherwise(0.0)).alias("p"),
                                                  F.sum(F.when(F.col("side") == "call", F.col("volume")).otherwise(0.0)).alias("c"))
    return g.select("ticker", "expiry", ratio("p", "c").alias("pcr")).withColumns({"confirmation": sig.put_call_label(), "size_multiplier": sig.put_call_multiplier()})


@query("f14_market_regime", f"""WITH b AS (SELECT date, count(close) OVER w200 >= 200 AND close > avg(close) OVER w200 AS a, close/lag(close,60) OVER w - 1 AS x FROM bench WINDOW w AS (ORDER BY date), w200 AS (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
g AS (SELECT date, CASE WHEN x IS NULL THEN 'neutral' WHEN NOT a OR x < -0.1 THEN 'negative' WHEN a AND x > 0 THEN 'positive' ELSE 'neutral' END AS regime FROM b)
SELECT date, regime, {r("CASE regime WHEN 'positive' THEN 1.0 WHEN 'negative' THEN 0.5 ELSE 0.75 END", 'multiplier')} FROM g""")
def _(t):
    d = tech.above_average(tech.pct_change(t.bench(), (60,), prefix="ret_"), 200, out="a")
    d = d.withColumn("regime", sig.market_regime(F.col("a") == 1.0, F.col("ret_60d")))
    return d.select("date", "regime", sig.regime_multiplier(F.col("regime")).alias("multiplier"))


ATR = f"""(SELECT ticker, date, close, CASE WHEN count(tr) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) >= 14 THEN avg(tr) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS atr
 FROM (SELECT ticker, date, close, greatest(high-low, coalesce(abs(high-lag(close,1) OVER {W}),0), coalesce(abs(low-lag(close,1) OVER {W}),0)) AS tr FROM bars))"""


@query("f16_position_size", f"""SELECT ticker, date, coalesce(CAST(CASE WHEN atr > 0 THEN floor(least(100000*0.02/(atr/close)*0.75, 25000.0)/close) ELSE 0 END AS BIGINT),0) AS n_shares FROM {ATR}""")
def _(t):
    d = tech.atr_simple(t.bars()).withColumn("regime_multiplier", F.lit(0.75))
    return sig.position_size(d, 100000.0).select("ticker", "date", "n_shares")


RB = f"""(SELECT ticker, date, close, atr, atr/close AS rng, greatest(-0.12, least(-0.04, -2.5*atr/close)) AS stop, least(0.005*(CASE WHEN ticker='PROMO' THEN 1.0 WHEN ticker='SMALL' THEN 0.5 ELSE 0.3 END)*0.8*0.75*(CASE WHEN day(date) % 2 = 0 THEN 0.5 ELSE 1.0 END), 0.0075) AS risk,
 CASE WHEN ticker='PROMO' THEN 0.20 WHEN ticker='SMALL' THEN 0.10 ELSE 0.15 END AS cap FROM {ATR})"""


@query("f16_risk_budget_position", f"""SELECT ticker, date, coalesce(CAST(CASE WHEN atr > 0 THEN CASE WHEN floor(least(1e6*risk/rng, 1e6*cap)/close)*close*abs(stop) > 1e6*0.0075 THEN floor(1e6*0.0075/(close*abs(stop))) ELSE floor(least(1e6*risk/rng, 1e6*cap)/close) END ELSE 0 END AS BIGINT),0) AS n_shares,
 {r('round(CASE WHEN atr > 0 THEN stop ELSE -0.08 END, 6)', 'stop_pct')} FROM {RB}""")
def _(t):
    d = tech.atr_simple(t.bars()).withColumns({
        "regime": F.when(F.col("ticker") == "PROMO", "POSITIVE").when(F.col("ticker") == "SMALL", "bear").otherwise("choppy"),
        "confidence": F.lit(0.5), "signal_rank": F.lit(2), "below_ma20": F.dayofmonth("date") % 2 == 0})
    return sig.risk_budget_position(d, 1e6).select("ticker", "date", "n_shares", "stop_pct")


@query("f17_slippage_and_allocation", f"""SELECT ticker, date, {r('0.001+0.0005*least(n_lines/2.0E0,3.0)', 'slippage')}, {r('CASE WHEN pred_1d >= 0 AND pred_3d < 0 THEN 0.35 WHEN pred_1d < 0 OR pred_3d > 0.02 THEN 0.20 ELSE 0.30 END', 'allocation')},
 {r('greatest(least(10000*0.15*(0.01/greatest(0.005,least(0.05,abs(pred_5d))))*(0.5+0.5*least(abs(pred_1d)/0.05,1.0)),2500),500)', 'size')} FROM predictions""")
def _(t):
    d = t.predictions()
    a = F.when(F.col("pred_1d") >= 0, 1.0).otherwise(0.0)
    v = F.when(F.col("pred_3d") < 0, 0.1).when(F.col("pred_3d") > 0.02, 0.9).otherwise(0.6)
    return d.select("ticker", "date", sig.slippage(F.col("n_lines") / 2.0).alias("slippage"), sig.regime_allocation(a, v).alias("allocation"),
                    sig.volatility_target_size(F.lit(10000.0), "pred_1d", F.abs("pred_5d")).alias("size"))


POS = {"positions": "SELECT id, CASE WHEN id % 7 = 0 THEN 'NONE' ELSE concat('Brand#', 1 + id % 25) END AS ticker, entry_date, entry_date + 400 AS stop_date, entry_price*20 AS entry_price, n_shares, stop_pct FROM trades",
       "quotes": "SELECT ticker, arg_max(close, date) AS price FROM brand_bars WHERE date <= DATE '1999-06-30' GROUP BY 1"}


def _positions(t):
    d = t.trades()
    return d.select("id", F.when(F.col("id") % 7 == 0, "NONE").otherwise(F.concat(F.lit("Brand#"), 1 + F.col("id") % 25)).alias("ticker"), "entry_date",
                    F.date_add("entry_date", 400).alias("stop_date"), (F.col("entry_price") * 20).alias("entry_price"), "n_shares", "stop_pct")


def _quotes(t):
    return t.brand_bars().where("date <= DATE '1999-06-30'").groupBy("ticker").agg(F.max_by("close", "date").alias("price"))


@query("f18_check_exits", """SELECT id, reason AS exit_reason FROM (SELECT p.id, CASE WHEN (q.price-p.entry_price)/p.entry_price <= p.stop_pct THEN 'stop_loss' WHEN (q.price-p.entry_price)/p.entry_price >= 0.15 THEN 'take_profit_cap' WHEN DATE '1999-06-30' >= p.stop_date THEN 'hold_period_expired' END AS reason
 FROM positions p JOIN quotes q ON q.ticker=p.ticker WHERE p.entry_date <= DATE '1999-06-30') WHERE reason IS NOT NULL""", views=POS)
def _(t):
    held = _positions(t).where("entry_date <= DATE '1999-06-30'")
    return sig.check_exits(held, _quotes(t), "1999-06-30").select("id", "exit_reason")


@query("a26_portfolio_value", f"SELECT count(*) AS n_positions, {r('sum(n_shares*coalesce(price,entry_price))', 'position_value', 2)}, {r('sum(n_shares*coalesce(price,entry_price))+1000', 'total_value', 2)} FROM positions p LEFT JOIN quotes q ON q.ticker=p.ticker", views=POS, digits=2)
def _(t):
    return equity.portfolio_value(_positions(t), _quotes(t), 1000.0)


@query("a26_mark_positions", f"SELECT p.id, {r('coalesce((price-entry_price)/entry_price,0)', 'unrealized_pct', 4)}, CAST(date_diff('day', entry_date, DATE '1999-06-30') AS INT) AS days_held, CAST(greatest(date_diff('day', DATE '1999-06-30', stop_date),0) AS INT) AS days_remaining FROM positions p LEFT JOIN quotes q ON q.ticker=p.ticker WHERE entry_date <= DATE '1999-06-30'", views=POS)
def _(t):
    held = _positions(t).where("entry_date <= DATE '1999-06-30'")
    return equity.mark_positions(held, _quotes(t), "1999-06-30").select("id", "unrealized_pct", "days_held", "days_remaining")


@query("f19_feature_map_round_trip", f"SELECT ticker, date, {rs('pred_1d', 'pred_5d')}, {r('0', 'absent')} FROM predictions")
def _(t):
    d = t.predictions().select("ticker", "date", sig.features_to_map(["pred_1d", "pred_3d", "pred_5d"]).alias("fv"))
    return sig.map_to_features(d, "fv", ["pred_1d", "pred_5d", "absent"]).drop("fv")


@query("f21_density_boost", "SELECT ticker, date, CAST(count + least(floor(count*11/20), 5) AS BIGINT) AS boosted FROM daily_small")
def _(t):
    return t.daily_small().select("ticker", "date", sig.density_boost("count", F.col("count") * 11).cast("bigint").alias("boosted"))


# ranking ---------------------------------------------------------------------------------------------------
PICK = {"social": """SELECT ticker, date, count(*) AS post_count_1d, sum(score) AS total_upvotes_1d, avg(sentiment_score) AS avg_sentiment_1d, count(*)/25.0E0 AS mention_growth_1d, sum(num_comments)/600.0E0 AS relative_volume,
 coalesce(sum(sentiment_score*num_comments),0)/count(*) AS weighted_sentiment FROM posts_small GROUP BY 1,2"""}


def _social(t):
    return t.posts_small().groupBy("ticker", "date").agg(
        F.count(F.lit(1)).alias("post_count_1d"), F.sum("score").alias("total_upvotes_1d"), F.avg("sentiment_score").alias("avg_sentiment_1d"),
        (F.count(F.lit(1)) / 25.0).alias("mention_growth_1d"), (F.sum("num_comments") / 600.0).alias("relative_volume"),
        (F.coalesce(F.sum(F.col("sentiment_score") * F.col("num_comments")), F.lit(0.0)) / F.count(F.lit(1))).alias("weighted_sentiment"))


def _top(score, cond):
    return f"SELECT date, ticker, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY {score} DESC, ticker) AS INT) AS rank FROM social WHERE {cond}) WHERE rank <= 3"


@query("w24_select_mention_growth", _top("mention_growth_1d", "post_count_1d >= 10"), views=PICK)
def _(t):
    return ranking.by_mention_growth(_social(t)).select("date", "ticker", "rank")


@query("w24_select_weighted_sentiment", _top("round(weighted_sentiment,9)", "post_count_1d >= 10 AND avg_sentiment_1d > 1e-9"), views=PICK)
def _(t):
    d = _social(t).withColumns({"weighted_sentiment": F.round("weighted_sentiment", 9), "avg_sentiment_1d": F.round("avg_sentiment_1d", 9)})
    return ranking.by_weighted_sentiment(d).select("date", "ticker", "rank")


@query("w24_select_upvotes_volume", _top("total_upvotes_1d", "post_count_1d >= 5 AND relative_volume >= 1.5 AND mention_growth_1d >= 0.3"), views=PICK)
def _(t):
    return ranking.by_upvotes_with_volume(_social(t)).select("date", "ticker", "rank")


@query("x01_selector_callback", "SELECT date, ticker, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY n_lines*100 + length(ticker) DESC, ticker) AS INT) AS rank FROM brand_bars WHERE volume > 20) WHERE rank <= 2")
def _(t):
    return ranking.select_per_day(t.brand_bars(), F.col("n_lines") * 100 + F.length("ticker"), F.col("volume") > 20, 2).select("date", "ticker", "rank")


@query("x02_prefilter_callback", "SELECT ticker, date, n_lines FROM brand_bars WHERE n_lines >= 2")
def _(t):
    return t.brand_bars().transform(lambda d: filters.density_gate(d, 2, "n_lines")).select("ticker", "date", "n_lines")


@query("x03_plugin_scorer", f"SELECT ticker, date, {r('2*pred_1d - pred_3d + 0.5*pred_5d', 'pred')} FROM predictions")
def _(t):
    from pulsegrid.models.lexicon import predict
    cols = ["pred_1d", "pred_3d", "pred_5d"]
    return predict(t.predictions(), cols, lambda x: 2 * x["pred_1d"] - x["pred_3d"] + 0.5 * x["pred_5d"]).select("ticker", "date", "pred")


ORD = "CASE signal WHEN 'BULLISH' THEN 0 WHEN 'NEUTRAL' THEN 1 ELSE 2 END, CASE signal WHEN 'BULLISH' THEN -pred_5d WHEN 'NEUTRAL' THEN -abs(pred_5d) ELSE pred_5d END"


@query("w26_sector_cap", f"""WITH s AS (SELECT g.ticker, g.date, g.signal, g.pred_5d, coalesce(x.sector,'Unknown') AS sector FROM sigs g LEFT JOIN sector x ON x.ticker=g.ticker)
SELECT ticker, date, sector FROM (SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY {ORD}, ticker) AS i FROM s) WHERE i <= 3 OR sector IN ('Index','Unknown')""", views=SIGNALS)
def _(t):
    d = joins.with_sector(_signals(t).select("ticker", "date", "signal", "pred_5d"), t.sector())
    return ranking.cap_per_group(d, [*ranking.side_order(), F.col("ticker")]).select("ticker", "date", "sector")


@query("o01_latest_signals", f"SELECT ticker, date, signal, CAST(row_number() OVER (ORDER BY {ORD}, ticker) AS INT) AS position FROM sigs WHERE date = (SELECT max(date) FROM sigs)", views=SIGNALS)
def _(t):
    return ranking.latest_signals(_signals(t)).select("ticker", "date", "signal", "position")


@query("o02_top_composite", f"SELECT ticker, date, {r('0.5*pred_5d+0.3*pred_3d+0.2*pred_1d', 'composite_score')} FROM predictions WHERE date = (SELECT max(date) FROM predictions) ORDER BY 0.5*pred_5d+0.3*pred_3d+0.2*pred_1d DESC, ticker LIMIT 5")
def _(t):
    return ranking.top_composite(t.predictions()).select("ticker", "date", "composite_score")


@query("o03_top_predictions", f"SELECT ticker, date, {r('pred_5d', 'pred_5d')} FROM predictions ORDER BY pred_5d DESC, date, ticker LIMIT 10")
def _(t):
    return ranking.top_predictions(t.predictions(), tie=("date", "ticker")).select("ticker", "date", "pred_5d")


@query("o04_last_n_oldest_first", "SELECT id, ticker FROM (SELECT id, ticker FROM trades ORDER BY id DESC LIMIT 40) ORDER BY id")
def _(t):
    return ranking.last_n(t.trades().select("id", "ticker"), 40)


@query("o06_best_row", f"SELECT arg_max(id, pnl_pct*1e9 - id) AS id, {r('max(pnl_pct)', 'pnl_pct')} FROM trades")
def _(t):
    return ranking.best_row(t.trades(), "pnl_pct", "id")


@query("o07_stratified_sample", f"""WITH q AS (SELECT quantile_cont(actual,1/3.0) AS a, quantile_cont(actual,2/3.0) AS b FROM trades), d AS (SELECT id, year(entry_date) AS y, ticker, CASE WHEN actual <= a THEN 'low' WHEN actual <= b THEN 'mid' ELSE 'high' END AS bin, {mix_sql('id', '42')} AS h FROM trades, q),
f AS (SELECT *, row_number() OVER (PARTITION BY y, ticker, bin ORDER BY h, id) AS i FROM d), p AS (SELECT id, h FROM f WHERE i <= 4 ORDER BY h, id LIMIT 600), x AS (SELECT id, h FROM d WHERE id NOT IN (SELECT id FROM p) ORDER BY h, id LIMIT (SELECT 600 - count(*) FROM p))
SELECT id FROM p UNION ALL SELECT id FROM x""")
def _(t):
    from pulsegrid.operators.ordering import exact_quantiles
    e = exact_quantiles(t.trades(), "actual", [1 / 3, 2 / 3], names=["e1", "e2"])
    b = F.when(F.col("actual") <= F.col("e1"), "low").when(F.col("actual") <= F.col("e2"), "mid").otherwise("high")
    d = t.trades().crossJoin(F.broadcast(e)).select("id", F.year("entry_date").alias("y"), "ticker", b.alias("bin"))  # one row
    return resample.stratified_sample(d, ["y", "ticker", "bin"], 4, 600, "id").select("id")


@query("o08_first_keys", "SELECT ticker, date, n_lines FROM brand_bars WHERE ticker IN (SELECT DISTINCT ticker FROM brand_bars ORDER BY ticker LIMIT 3)")
def _(t):
    return ranking.first_keys(t.brand_bars(), 3).select("ticker", "date", "n_lines")


@query("o08_first_rows", "SELECT ticker, date, n_lines FROM brand_bars ORDER BY ticker, date LIMIT 1000")
def _(t):
    return ranking.first_rows(t.brand_bars(), 1000, ["ticker", "date"]).select("ticker", "date", "n_lines")


# universe staging -----------------------------------------------------------------------------------------------
CAND = {"cand": "SELECT ticker AS symbol, date, count(*) AS n_mentions FROM posts_small GROUP BY 1,2"}


def _cand(t):
    return t.posts_small().groupBy(F.col("ticker").alias("symbol"), "date").agg(F.count(F.lit(1)).alias("n_mentions"))


@query("w28_promote_candidates", """WITH q AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS i, date_diff('day', date, lag(date) OVER (PARTITION BY symbol ORDER BY date DESC)) AS gap FROM cand WHERE n_mentions >= 11 AND date BETWEEN DATE '2024-01-30' - 14 AND DATE '2024-01-30')
SELECT symbol, count(*) AS n_days, CAST(max(gap) AS INT) AS max_gap, max(date) AS last_day FROM q WHERE i <= 3 GROUP BY 1 HAVING count(*) >= 3 AND max(gap) <= 3""", views=CAND)
def _(t):
    return ranking.promote_candidates(_cand(t), "2024-01-30", min_mentions=11)


ELIG = """SELECT ticker, price, history_days, CASE WHEN history_days >= 20 THEN adv ELSE 0 END AS adv, CASE WHEN price < 2000 THEN 'price_too_low' WHEN history_days < 1500 THEN 'insufficient_history' WHEN CASE WHEN history_days >= 20 THEN adv ELSE 0 END < 50000 THEN 'low_dollar_volume' WHEN ticker IN ('Brand#3') THEN 'is_etf' END AS reason
FROM (SELECT ticker, arg_max(close,date) AS price, count(*) AS history_days, avg(close*volume) FILTER (i <= 20) AS adv FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS i FROM brand_bars) GROUP BY 1)"""


def _elig(t):
    return ranking.price_eligibility(t.brand_bars(), ["Brand#3"], 2000.0, 1500, 50000.0)


@query("m28_price_eligibility", f"SELECT ticker, {r('price', 'price', 3)}, history_days, {r('adv', 'avg_dollar_vol', 3)}, reason IS NULL AS passes, reason AS fail_reason FROM ({ELIG})", digits=3)
def _(t):
    return _elig(t)


ACTIVE = "SELECT ticker, CAST(sum(count) AS BIGINT) AS post_count_7d, count(*) FILTER (count >= 18) AS active_days, count(*) FILTER (count >= 18) >= 3 AS sustained FROM daily_small WHERE date >= DATE '2024-01-30' - 7 AND date <= DATE '2024-01-30' AND ticker NOT IN ('U1') GROUP BY 1"


@query("m28_active_mentions", ACTIVE)
def _(t):
    return ranking.active_mentions(t.daily_small(), "2024-01-30", min_posts=18, core=["U1"], count="count")


@query("m28_universe_stage", f"""WITH e AS ({ELIG}), m AS (SELECT ticker, sum(n_lines) FILTER (date > DATE '2001-10-01') >= 10 AS sustained FROM brand_bars GROUP BY 1), w AS (SELECT ticker, DATE '2001-10-20' + CAST(CAST(regexp_extract(ticker,'[0-9]+',0) AS INT) AS INT) AS pd FROM sector WHERE sector IN ('S1','S2')),
c AS (SELECT ticker, CAST(10*CAST(regexp_extract(ticker,'[0-9]+',0) AS INT) AS BIGINT) AS days_observed, (CAST(regexp_extract(ticker,'[0-9]+',0) AS INT) - 10)/100.0E0 AS avg_ic FROM sector WHERE sector IN ('S3'))
SELECT m.ticker, CASE WHEN days_observed >= 30 AND avg_ic >= 0.01 THEN 'PROMOTED' WHEN days_observed >= 30 THEN 'DEMOTED' WHEN days_observed IS NOT NULL THEN 'PROBATION' WHEN pd <= DATE '2001-11-05' - 7 AND e.reason IS NULL THEN 'PROBATION_START' WHEN pd <= DATE '2001-11-05' - 7 THEN 'REMOVED'
 WHEN pd IS NOT NULL THEN 'WATCHLIST' WHEN sustained AND e.reason IS NULL THEN 'WATCHLIST_ADD' WHEN sustained THEN 'INELIGIBLE' ELSE 'MONITORING' END AS stage, e.reason AS fail_reason, days_observed, {r('avg_ic', 'avg_ic')}
FROM m LEFT JOIN w ON w.ticker=m.ticker LEFT JOIN c ON c.ticker=m.ticker LEFT JOIN e ON e.ticker=m.ticker""")
def _(t):
    n = F.regexp_extract("ticker", "[0-9]+", 0).cast("int")
    m = t.brand_bars().groupBy("ticker").agg((F.sum(F.when(F.col("date") > "2001-10-01", F.col("n_lines"))) >= 10).alias("sustained"))
    w = t.sector().where("sector IN ('S1','S2')").select("ticker", F.date_add(F.lit("2001-10-20").cast("date"), n).alias("promoted_date"))
    c = t.sector().where("sector = 'S3'").select("ticker", (10 * n).cast("bigint").alias("days_observed"), ((n - 10) / 100.0).alias("avg_ic"))
    return ranking.universe_stage(m, _elig(t), w, c, "2001-11-05")


# stump ensembles ----------------------------------------------------------------------------------------------------
STUMPS = [
    ("1d", 0, "returns_1d", 0.01, True, -0.002, 0.004, 80.0, 20.0), ("1d", 1, "relative_volume", 1.1, False, 0.001, -0.003, 55.0, 45.0),
    ("3d", 0, "returns_20d", -0.02, True, 0.006, -0.001, 30.0, 70.0), ("3d", 1, "returns_1d", -0.05, False, 0.01, 0.002, 25.0, 75.0),
    ("5d", 0, "sentiment_1d", 0.0, True, 0.012, -0.004, 50.0, 50.0), ("5d", 1, "post_count_1d", 4.5, True, -0.006, 0.009, 60.0, 40.0),
    ("5d", 2, "returns_20d", 0.1, False, 0.003, 0.02, 65.0, 35.0),
]
BASE = {"1d": 0.001, "3d": 0.002, "5d": 0.0045}
MODEL = ["returns_1d", "returns_20d", "relative_volume", "sentiment_1d", "post_count_1d"]
_stump_rows = ", ".join(f"('{h}',{i},'{f}',{t}::DOUBLE,{str(d).lower()},{a}::DOUBLE,{b}::DOUBLE,{x}::DOUBLE,{y}::DOUBLE)" for h, i, f, t, d, a, b, x, y in STUMPS)
SV = {
    "stumps": f"SELECT * FROM (VALUES {_stump_rows}) v(horizon,tree_id,feature,threshold,dl,wl,wr,hl,hr)",
    "long_panel": " UNION ALL ".join(f"SELECT ticker, date, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM panel" for c in MODEL),
    "leaves": """SELECT p.ticker, p.date, s.horizon, s.feature, CASE WHEN p.x IS NULL THEN CASE WHEN s.dl THEN s.wl ELSE s.wr END WHEN CAST(p.x AS FLOAT) < CAST(s.threshold AS FLOAT) THEN s.wl ELSE s.wr END AS leaf, (s.wl*s.hl+s.wr*s.hr)/(s.hl+s.hr) AS mean FROM long_panel p JOIN stumps s ON s.feature=p.feature""",
}
BASE_SQL = "CASE horizon WHEN '1d' THEN 0.001 WHEN '3d' THEN 0.002 ELSE 0.0045 END"


def _stumps(t):
    return t.spark.createDataFrame(STUMPS, st.STUMP_SCHEMA)


@query("m18_stump_scores", f"SELECT ticker, date, horizon, {r('sum(leaf) + any_value(' + BASE_SQL + ')', 'score', 9)} FROM leaves GROUP BY 1,2,3", views=SV, digits=9)
def _(t):
    return st.score_stumps(t.panel(), _stumps(t), ["ticker", "date"], MODEL, BASE)


@query("m18_stump_scores_leaf_table", f"SELECT ticker, date, horizon, {r('sum(leaf)', 'score', 9)} FROM leaves GROUP BY 1,2,3", views=SV, digits=9)
def _(t):
    """Form with one row per (row, tree), used when tree prefixes are compared."""
    d = st.leaf_values(t.panel(), _stumps(t), ["ticker", "date"], MODEL)
    return d.groupBy("ticker", "date", "horizon").agg(F.sum("leaf").alias("score"))


@query("m19_attributions", f"SELECT ticker, date, horizon, feature, {r('sum(leaf-mean)', 'attribution', 9)} FROM leaves GROUP BY 1,2,3,4", views=SV, digits=9)
def _(t):
    return st.attributions(t.panel(), _stumps(t), ["ticker", "date"], MODEL)


@query("m19_mean_abs_attribution", f"SELECT horizon, feature, {r('avg(abs(a))', 'mean_abs', 9)} FROM (SELECT ticker, date, horizon, feature, sum(leaf-mean) AS a FROM leaves GROUP BY 1,2,3,4) GROUP BY 1,2", views=SV, digits=9)
def _(t):
    return st.mean_abs_attribution(st.attributions(t.panel(), _stumps(t), ["ticker", "date"], MODEL))


FAMS = {"market": ["returns_1d", "returns_20d", "relative_volume"], "social": ["post_count_1d", "sentiment_1d"]}


@query("m19_family_shares", f"""WITH f AS (SELECT ticker, date, horizon, CASE WHEN feature IN ('post_count_1d','sentiment_1d') THEN 'social' ELSE 'market' END AS family, sum(leaf-mean) AS a FROM leaves GROUP BY 1,2,3,4)
SELECT ticker, date, horizon, family, {r('a', 'attribution', 6)}, {r('coalesce(100*abs(a)/nullif(sum(abs(a)) OVER (PARTITION BY ticker, date, horizon),0),0)', 'share_pct')} FROM f""", views=SV)
def _(t):
    return st.family_shares(st.attributions(t.panel(), _stumps(t), ["ticker", "date"], MODEL), FAMS, ["ticker", "date"])


@query("j21_repair_predictions", f"""WITH s AS (SELECT ticker, date, sum(leaf)+0.001 AS p FROM leaves WHERE horizon='1d' GROUP BY 1,2), l AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'PROMO' ELSE 'NONE' END AS ticker, entry_date AS date, CASE WHEN id % 3 = 0 THEN 0.5 END AS pred_1d FROM trades)
SELECT l.id, {r('coalesce(l.pred_1d, s.p)', 'pred_1d', 9)}, s.ticker IS NULL AS unmatched FROM l LEFT JOIN s ON s.ticker=l.ticker AND s.date=l.date""", views=SV, digits=9)
def _(t):
    scored = st.add_predictions(t.panel(), _stumps(t), MODEL, BASE)
    log = t.trades().select("id", F.when(F.col("id") % 2 == 0, "PROMO").otherwise("NONE").alias("ticker"), F.col("entry_date").alias("date"),
                            F.when(F.col("id") % 3 == 0, 0.5).alias("pred_1d"))
    fixed = joins.repair_predictions(log, scored, ["pred_1d"])
    gone = joins.not_repairable(log, scored).select("id", F.lit(True).alias("unmatched"))
    return fixed.join(gone, "id", "left").fillna({"unmatched": False}).select("id", "pred_1d", "unmatched")
