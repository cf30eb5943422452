"""Queries over daily bars: technical features, as-of joins, correlations, rank study."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import joins, technical as tech
from pulsegrid.operators import rollups
from pulsegrid.plans.catalog import query, r, rs
from pulsegrid.plans.studies import rank_study, rank_study_days

W = "(PARTITION BY ticker ORDER BY date)"


def frame(n: int, last: str = "CURRENT ROW") -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n} PRECEDING AND {last})"


@query("w06_pct_change", f"""SELECT ticker, date, {', '.join(r(f'close/lag(close,{n}) OVER {W} - 1', f'returns_{n}d') for n in (1, 5, 20, 60))} FROM bars""")
def _(t):
    return tech.pct_change(t.bars()).select("ticker", "date", *[f"returns_{n}d" for n in (1, 5, 20, 60)])


RSI = f"""SELECT ticker, date, CASE WHEN count(d) OVER {frame(13)} >= 14 THEN avg(CASE WHEN d IS NULL THEN NULL ELSE greatest(d,0) END) OVER {frame(13)} END AS g,
 CASE WHEN count(d) OVER {frame(13)} >= 14 THEN avg(CASE WHEN d IS NULL THEN NULL ELSE greatest(-d,0) END) OVER {frame(13)} END AS l
 FROM (SELECT ticker, date, close - lag(close,1) OVER {W} AS d FROM bars)"""


@query("w07a_rsi_simple", f"""SELECT ticker, date, {r('coalesce(100 - 100/(1 + g/nullif(l,0)), 50)', 'rsi_14')},
 {r('100 - 100/(1 + g/nullif(l,0))', 'rsi_live')} FROM ({RSI})""")
def _(t):
    d = tech.rsi_simple(t.bars())
    return tech.rsi_simple(d, no_loss=None, out="rsi_live").select("ticker", "date", "rsi_14", "rsi_live")


def _fold_sql(source: str, cols: list[str], outs: list[str]) -> str:
    step = ", ".join(f"f.{o} + ({'s.' + c} - f.{o})/14" for c, o in zip(cols, outs))
    first = ", ".join(f"{c} AS {o}" for c, o in zip(cols, outs))
    return f"""WITH RECURSIVE s AS ({source}),
 f AS (SELECT ticker, i, {first} FROM s WHERE i = 1
   UNION ALL SELECT s.ticker, s.i, {step} FROM f JOIN s ON s.ticker = f.ticker AND s.i = f.i + 1)"""


TR = f"""SELECT ticker, date, close, row_number() OVER {W} AS i,
 greatest(high-low, coalesce(abs(high-lag(close,1) OVER {W}),0), coalesce(abs(low-lag(close,1) OVER {W}),0)) AS tr FROM bars"""


@query("w08_atr_wilder", f"""{_fold_sql(TR, ['tr'], ['atr'])}
SELECT s.ticker, s.date, {r('f.atr', 'atr_14')}, {r('f.atr/s.close', 'atr_14_norm')} FROM s JOIN f ON s.ticker=f.ticker AND s.i=f.i""")
def _(t):
    return tech.atr_wilder(t.bars()).select("ticker", "date", "atr_14", "atr_14_norm")


@query("w08_atr_simple", f"""SELECT ticker, date, {r(f'CASE WHEN count(tr) OVER {frame(13)} >= 14 THEN avg(tr) OVER {frame(13)} END', 'atr_14')} FROM ({TR})""")
def _(t):
    return tech.atr_simple(t.bars()).select("ticker", "date", "atr_14")


CH = f"""SELECT ticker, date, greatest(d,0) AS up, greatest(-d,0) AS dn, row_number() OVER {W} AS i
 FROM (SELECT ticker, date, close - lag(close,1) OVER {W} AS d FROM bars) WHERE d IS NOT NULL"""


@query("w07b_rsi_wilder", f"""{_fold_sql(CH, ['up', 'dn'], ['g', 'l'])}
SELECT b.ticker, b.date, {r('CASE WHEN s.i >= 14 THEN 100*f.g/nullif(f.g+f.l,0) END', 'rsi_14')}
FROM bars b LEFT JOIN s ON b.ticker=s.ticker AND b.date=s.date LEFT JOIN f ON s.ticker=f.ticker AND s.i=f.i""")
def _(t):
    return tech.rsi_wilder(t.bars()).select("ticker", "date", "rsi_14")


@query("w09_relative_volume", f"""SELECT ticker, date,
 {r(f'CASE WHEN count(volume) OVER {frame(19)} >= 20 THEN volume/avg(volume) OVER {frame(19)} END', 'relative_volume')},
 {r(f'coalesce(CASE WHEN count(volume) OVER {frame(19)} >= 5 THEN volume/avg(volume) OVER {frame(19)} END, 1.0)', 'relative_volume_5')} FROM bars""")
def _(t):
    d = tech.relative_volume(t.bars())
    return tech.relative_volume(d, 20, 5, 1.0, out="relative_volume_5").select("ticker", "date", "relative_volume", "relative_volume_5")


def _dist(n, m):
    f = frame(n - 1)
    return f"CASE WHEN count(close) OVER {f} >= {m} THEN (close - avg(close) OVER {f})/avg(close) OVER {f} END"


@query("w10_ma_distance", f"""SELECT ticker, date, {r(_dist(20, 20), 'dist_from_20ma')}, {r(_dist(50, 50), 'dist_from_50ma')},
 {r('coalesce(' + _dist(20, 10) + ', 0.0)', 'dist_from_20ma_pct')} FROM bars""")
def _(t):
    d = tech.ma_distance(tech.ma_distance(t.bars(), 20), 50)
    return tech.ma_distance(d, 20, 10, 0.0, out="dist_from_20ma_pct").select(
        "ticker", "date", "dist_from_20ma", "dist_from_50ma", "dist_from_20ma_pct")


def _above(n, m):
    f = frame(n - 1)
    return f"CASE WHEN count(close) OVER {f} >= {m} AND close > avg(close) OVER {f} THEN 1.0 ELSE 0.0 END"


@query("w11_above_200ma", f"SELECT date, {r(_above(200, 100), 'spy_above_200ma')} FROM bench")
def _(t):
    return tech.above_average(t.bench(), 200, 100, out="spy_above_200ma").select("date", "spy_above_200ma")


@query("w12_rolling_percentile", f"""SELECT ticker, date,
 {r("CASE WHEN len(win) >= 20 THEN CAST(len(list_filter(win, lambda x: x < close)) AS DOUBLE)/len(win) ELSE 0.5 END", 'percentile')}
FROM (SELECT ticker, date, close, list(close) OVER {frame(251)} AS win FROM bars)""")
def _(t):
    return tech.rolling_percentile(t.bars()).select("ticker", "date", "percentile")


@query("w13_forward_returns", f"""SELECT ticker, date, {', '.join(r(f'lead(close,{n}) OVER {W}/close - 1', f'target_return_{n}d') for n in (1, 3, 5, 10))} FROM bars""")
def _(t):
    return tech.forward_returns(t.bars()).select("ticker", "date", *[f"target_return_{n}d" for n in (1, 3, 5, 10)])


_jumps = " + ".join(f"coalesce(lag(j,{i}) OVER {W},0.0)*{1 - i / 20!r}" for i in range(1, 20))


@query("w14_jump_decay", f"""SELECT ticker, date, {r(f'greatest(-0.1, least(0.1, {_jumps}))', 'pead_proxy')}
FROM (SELECT ticker, date, CASE WHEN abs(x) > 0.05 THEN x ELSE 0.0 END AS j FROM
 (SELECT ticker, date, close/lag(close,1) OVER {W} - 1 AS x FROM bars))""")
def _(t):
    return tech.jump_decay(t.bars()).select("ticker", "date", "pead_proxy")


@query("w15_abnormal_attention", f"""SELECT ticker, date,
 {r(f'least(10.0, n_lines/(coalesce(CASE WHEN count(n_lines) OVER {frame(19)} >= 5 THEN avg(n_lines) OVER {frame(19)} END, 1.0) + 1.0))', 'abnormal_attention_1d')} FROM bars""")
def _(t):
    return tech.abnormal_attention(t.bars(), count="n_lines").select("ticker", "date", "abnormal_attention_1d")


@query("w16_realised_volatility", f"""SELECT ticker, date, {r(f'CASE WHEN count(x) OVER {frame(19)} >= 10 THEN stddev_samp(x) OVER {frame(19)} END', 'vol_20d')}
FROM (SELECT ticker, date, close/lag(close,1) OVER {W} - 1 AS x FROM bars)""")
def _(t):
    return tech.realised_volatility(t.bars()).select("ticker", "date", "vol_20d")


@query("w17_benchmark_regime_features", f"""SELECT date, {r('ret_20d', 'ret_20d')}, {r('ret_60d', 'ret_60d')},
 {r(f'CASE WHEN count(x) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20 THEN stddev_samp(x) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END', 'vol_20d')},
 {r('a200', 'above_200')}, {r('a50', 'above_50')}, {r('ret_20d - ret_60d', 'momentum_diff')}
FROM (SELECT date, close/lag(close,1) OVER {W} - 1 AS x, close/lag(close,20) OVER {W} - 1 AS ret_20d, close/lag(close,60) OVER {W} - 1 AS ret_60d,
 {_above(200, 200)} AS a200, {_above(50, 50)} AS a50 FROM bench)""")
def _(t):
    return tech.benchmark_regime_features(t.bench()).select(
        "date", "ret_20d", "ret_60d", "vol_20d", "above_200", "above_50", "momentum_diff")


@query("w30_below_trend", f"""SELECT ticker, date,
 coalesce(count(close) OVER {frame(19)} >= 20 AND close < avg(close) OVER {frame(19)}, false) AS below_ma20,
 coalesce(count(close) OVER {frame(20, '1 PRECEDING')} >= 15 AND lag(close,1) OVER {W} <= avg(close) OVER {frame(20, '1 PRECEDING')}, false) AS below_past_ma20
FROM bars""")
def _(t):
    d = tech.below_trend(t.bars())
    return tech.below_trend(d, 20, 15, True, out="below_past_ma20").select("ticker", "date", "below_ma20", "below_past_ma20")


@query("j04_asof_series", f"""SELECT ticker, date, {r('value', 'value')} FROM (
 SELECT b.ticker, b.date, coalesce((SELECT arg_max(i.value, i.date) FROM idx i WHERE i.date <= b.date), 0.5) AS value FROM brand_bars b)""",
       views={"idx": "SELECT CAST(date_trunc('week', date) AS DATE) AS date, max(value) AS value FROM index_series GROUP BY 1"})
def _(t):
    idx = t.index_series().groupBy(F.to_date(F.date_trunc("week", "date")).alias("date")).agg(F.max("value").alias("value"))
    return joins.asof_series(t.brand_bars().select("ticker", "date"), idx, "value", 0.5)


@query("j13_forward_row_lookup", f"""SELECT t.id, t.ticker, t.entry_date, {rs('realised_1d', 'realised_3d', 'realised_5d')}
FROM tr t LEFT JOIN (SELECT ticker, date, lead(close,1) OVER {W}/close-1 AS realised_1d, lead(close,3) OVER {W}/close-1 AS realised_3d,
 lead(close,5) OVER {W}/close-1 AS realised_5d FROM bars) f ON f.ticker=t.ticker AND f.date=t.entry_date""",
       views={"tr": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'STANDARD' ELSE 'PROMO' END AS ticker, CAST(o_orderdate AS DATE) AS entry_date FROM orders"})
def _(t):
    tr = t.base("orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "STANDARD").otherwise("PROMO").alias("ticker"),
        F.to_date("o_orderdate").alias("date"))
    return joins.with_forward_rows(tr, t.bars()).withColumnRenamed("date", "entry_date")


@query("j16_pairwise_correlation", f"""WITH ret AS (SELECT ticker, date, close/lag(close,1) OVER {W} - 1 AS x,
 row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS i FROM bars)
SELECT a.ticker AS key_a, b.ticker AS key_b, count(*) AS n, {r('corr(a.x, b.x)', 'corr')}
FROM ret a JOIN ret b ON a.date=b.date AND b.ticker IN ('STANDARD','PROMO') AND a.ticker <> b.ticker
WHERE a.i <= 60 AND b.i <= 60 AND a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1,2 HAVING count(*) >= 20""")
def _(t):
    from pulsegrid.plans.tables import HELD
    keys = t.bars().select(F.col("ticker").alias("key_a")).distinct()
    pairs = keys.withColumn("key_b", F.explode(F.array(*[F.lit(h) for h in HELD]))).where("key_a <> key_b")
    return joins.pairwise_correlation(t.bars(), pairs)


@query("j16_correlated_pairs", f"""WITH ret AS (SELECT ticker, date, close/lag(close,1) OVER {W} - 1 AS x,
 row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS i FROM bars)
SELECT a.ticker AS key_a, b.ticker AS key_b, count(*) AS n, {r('corr(a.x, b.x)', 'corr')}
FROM ret a JOIN ret b ON a.date=b.date AND a.ticker < b.ticker
WHERE a.i <= 60 AND b.i <= 60 AND a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1,2 HAVING count(*) >= 20 AND abs(corr(a.x, b.x)) >= 0.05""")
def _(t):
    return joins.correlated_pairs(t.bars(), limit=0.05, tiles=3)


@query("j16_correlation_gate", f"""WITH ret AS (SELECT ticker, date, close/lag(close,1) OVER {W} - 1 AS x,
 row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS i FROM bars),
c AS (SELECT a.ticker AS ka, b.ticker AS kb, corr(a.x,b.x) AS c, count(*) AS n FROM ret a JOIN ret b ON a.date=b.date AND b.ticker IN ('STANDARD','PROMO') AND a.ticker<>b.ticker
 WHERE a.i<=60 AND b.i<=60 AND a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1,2 HAVING count(*)>=20)
SELECT DISTINCT ticker FROM bars WHERE ticker NOT IN (SELECT ka FROM c WHERE abs(c) >= 0.1) AND ticker NOT IN (SELECT kb FROM c WHERE abs(c) >= 0.1 AND ka IN ('STANDARD','PROMO')) AND ticker <> 'ECONOMY'""")
def _(t):
    from pulsegrid.plans.tables import HELD
    keys = t.bars().select("ticker").distinct()
    pairs = keys.select(F.col("ticker").alias("key_a")).withColumn("key_b", F.explode(F.array(*[F.lit(h) for h in HELD]))).where("key_a <> key_b")
    held = keys.where(F.col("ticker").isin(HELD))
    return joins.correlation_allows(keys, held, joins.pairwise_correlation(t.bars(), pairs), max_corr=0.1,
                                    cluster=["ECONOMY", "STANDARD", "PROMO"], max_cluster=3).where("ticker <> 'ECONOMY'")


@query("j18_last_value_before", digits=9, sql=f"""SELECT t.id, {r('l.last_value', 'last_value', 9)} FROM trades0 t LEFT JOIN LATERAL (
 SELECT arg_max(b.close, b.date) AS last_value FROM brand_bars b WHERE b.ticker=t.ticker AND b.date < t.date) l ON true""",
       views={"trades0": "SELECT o_orderkey AS id, concat('Brand#', 1 + o_orderkey % 25) AS ticker, CAST(o_orderdate AS DATE) AS date FROM orders"})
def _(t):
    tr = t.base("orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Brand#"), 1 + F.col("o_orderkey") % 25).alias("ticker"),
        F.to_date("o_orderdate").alias("date"))
    return joins.last_value_before(tr, t.brand_bars()).select("id", "last_value")


PICKS = """SELECT date, count(*) AS n_picks, avg(target_return_5d) - 0.002 AS daily_return FROM (
 SELECT *, row_number() OVER (PARTITION BY date ORDER BY returns_1d DESC, ticker) AS rk FROM panel
 WHERE relative_volume >= 1.0 AND returns_1d IS NOT NULL) WHERE rk <= 3 AND target_return_5d IS NOT NULL GROUP BY date"""


@query("m17_daily_rank_study_days", f"SELECT date, n_picks, {r('daily_return', 'daily_return')} FROM ({PICKS})")
def _(t):
    return rank_study_days(t.panel(), F.col("returns_1d"), F.col("relative_volume") >= 1.0)


@query("m17_daily_rank_study", f"""SELECT count(*) AS n_days, {r('avg(CASE WHEN daily_return > 0 THEN 1.0 ELSE 0.0 END)', 'win_rate')},
 {r('avg(daily_return)', 'mean_pnl')}, {r('sum(daily_return)', 'total_pnl')},
 {r('sum(CASE WHEN daily_return > 0 THEN daily_return ELSE 0 END)/abs(sum(CASE WHEN daily_return < 0 THEN daily_return END))', 'profit_factor')},
 {r('avg(daily_return)*sqrt(252)/stddev_samp(daily_return)', 'sharpe')}, CAST(sum(n_picks) AS BIGINT) AS n_picks,
 {r('(SELECT arg_max(close,date)/arg_min(close,date)-1 FROM bench)', 'benchmark_return')} FROM ({PICKS})""")
def _(t):
    return rank_study(t.panel(), F.col("returns_1d"), F.col("relative_volume") >= 1.0, bench=t.bench())


@query("a32_benchmark_period_return", f"""SELECT {r('arg_max(close,date)/arg_min(close,date)-1', 'benchmark_return')} FROM bench
WHERE date >= DATE '1996-01-01' AND date < DATE '2000-01-01'""")
def _(t):
    return rollups.period_return(t.bench(), start="1996-01-01", end="2000-01-01")
