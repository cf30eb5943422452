"""Queries over rank correlations, trade sequences, resampling, folds and Granger tests."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.operators import equity, folds, granger, ic, joins, quality, resample, rollups
from pulsegrid.operators.ordering import exact_quantiles, row_index, running
from pulsegrid.plans import studies
from pulsegrid.plans.catalog import ORACLES, query, r, rs
from pulsegrid.session import settle

FEATS = ["post_count_1d", "sentiment_1d", "returns_1d", "returns_20d", "relative_volume"]
Y = "target_return_5d"


def ranked(source: str, x: str, y: str, group: str = "") -> str:
    """SQL rows with average ranks rx, ry within a group."""
    g = f"PARTITION BY {group} " if group else ""
    gx, gy = (f"PARTITION BY {group}, {x}", f"PARTITION BY {group}, {y}") if group else (f"PARTITION BY {x}", f"PARTITION BY {y}")
    return f"""SELECT *, rank() OVER ({g}ORDER BY {x}) + (count(*) OVER ({gx}) - 1)/2.0E0 AS rx, rank() OVER ({g}ORDER BY {y}) + (count(*) OVER ({gy}) - 1)/2.0E0 AS ry
FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL"""


@query("m01_spearman_pooled", f"SELECT count(*) AS n, {r('corr(rx,ry)', 'ic')} FROM ({ranked('panel', 'returns_1d', Y)})")
def _(t):
    return ic.spearman(t.panel(), "returns_1d", Y)


@query("m01_spearman_pooled_bucketed", f"SELECT count(*) AS n, {r('corr(rx,ry)', 'ic')} FROM ({ranked('panel', 'returns_1d', Y)})")
def _(t):
    return ic.spearman(t.panel(), "returns_1d", Y, n_buckets=16)


@query("m01_spearman_grouped_bucketed", f"SELECT ticker, count(*) AS n, {r('corr(rx,ry)', 'ic')} FROM ({ranked('panel', 'post_count_1d', Y, 'ticker')}) GROUP BY 1")
def _(t):
    return ic.spearman(t.panel(), "post_count_1d", Y, ["ticker"], n_buckets=16)


@query("a23_quantiles_bucketed", f"SELECT ticker, {r('quantile_cont(returns_1d,0.01)', 'p01')}, {r('quantile_cont(returns_1d,0.5)', 'p50')}, {r('quantile_cont(returns_1d,0.95)', 'p95')} FROM panel GROUP BY 1")
def _(t):
    return exact_quantiles(t.panel(), "returns_1d", [0.01, 0.5, 0.95], ["ticker"], names=["p01", "p50", "p95"], n_buckets=16)


@query("m01_spearman_with_ties", f"SELECT ticker, count(*) AS n, {r('corr(rx,ry)', 'ic')} FROM ({ranked('panel', 'post_count_1d', Y, 'ticker')}) GROUP BY 1")
def _(t):
    return ic.spearman(t.panel(), "post_count_1d", Y, ["ticker"])


@query("m01_spearman_small_group_rules", f"SELECT date, count(*) AS n, {r('CASE WHEN count(*) < 5 THEN 0.0 ELSE coalesce(corr(rx,ry),0.0) END', 'ic')} FROM ({ranked('panel', 'returns_1d', Y, 'date')}) GROUP BY 1")
def _(t):
    return ic.spearman(t.panel(), "returns_1d", Y, ["date"], min_n=5, on_small=0.0)


def simpson(density: str, upper: str, n: int = 2000) -> str:
    """SQL for the integral of ``density`` (in x) from 0 to ``upper``."""
    return (f"(SELECT sum(CASE WHEN k=0 OR k={n} THEN 1 WHEN k%2=1 THEN 4 ELSE 2 END * ({density.replace('{x}', f'(k*({upper})/{n})')}))*({upper})/{3 * n} "
            f"FROM (SELECT unnest(generate_series(0,{n})) AS k))")


def t_two_sided_sql(t: str, v: str) -> str:
    pdf = f"exp(lgamma((({v})+1)/2.0)-lgamma(({v})/2.0))/sqrt(({v})*pi())*pow(1+{{x}}*{{x}}/({v}), -(({v})+1)/2.0)"
    return f"greatest(0, 1-2*{simpson(pdf, f'abs({t})')})"


def normal_cdf_sql(z: str) -> str:
    part = simpson("exp(-{x}*{x}/2)/sqrt(2*pi())", f"least(abs({z}),9)")
    return f"(0.5 + sign({z})*{part})"


@query("m01_spearman_p_value", f"""WITH c AS (SELECT ticker, count(*) AS n, corr(rx,ry) AS ic FROM ({ranked('panel', 'returns_1d', Y, 'ticker')}) GROUP BY 1), d AS (SELECT *, ic*sqrt((n-2)/(1-ic*ic)) AS t, n-2.0E0 AS v FROM c)
SELECT ticker, n, {r('ic', 'ic')}, {r(t_two_sided_sql('d.t', 'd.v'), 'p_value')} FROM d""")
def _(t):
    return ic.spearman(t.panel(), "returns_1d", Y, ["ticker"], with_p=True)


@query("a10_ic_by_year", f"SELECT period, count(*) AS n, {r('CASE WHEN count(*) >= 20 THEN corr(rx,ry) END', 'ic')} FROM ({ranked('(SELECT *, year AS period FROM panel)', 'sentiment_1d', Y, 'period')}) GROUP BY 1")
def _(t):
    return ic.grouped_ic(t.panel(), "sentiment_1d", Y, F.year("date"))


MONTHLY = f"SELECT period, corr(rx,ry) AS ic, count(*) AS n FROM ({ranked('(SELECT *, strftime(date, chr(37) || chr(89) || chr(45) || chr(37) || chr(109)) AS period FROM panel)', 'returns_1d', Y, 'period')}) GROUP BY 1 HAVING count(*) >= 20"


@query("a10_monthly_ic_moments", f"SELECT count(*) AS n_periods, {r('avg(ic)', 'mean_ic')}, {r('stddev_samp(ic)', 'std_ic')} FROM ({MONTHLY})")
def _(t):
    return ic.ic_moments(ic.grouped_ic(t.panel(), "returns_1d", Y, F.date_format("date", "yyyy-MM")))


LONG = "(" + " UNION ALL ".join(f"SELECT '{c}' AS feature, year, CAST({c} AS DOUBLE) AS x, {Y} AS y FROM panel WHERE split='train'" for c in FEATS) + ")"
TABLE = f"SELECT feature, count(*) AS n, CASE WHEN count(*) >= 100 THEN corr(rx,ry) END AS ic FROM ({ranked(LONG, 'x', 'y', 'feature')}) GROUP BY 1"


@query("m02_feature_ic_table", f"SELECT feature, n, {r('ic', 'ic')} FROM ({TABLE})")
def _(t):
    return ic.feature_ic_table(t.panel().where("split = 'train'"), FEATS, Y)


@query("m02_mean_abs_ic", f"SELECT count(ic) AS n_features, {r('avg(abs(ic))', 'mean_abs_ic')}, avg(abs(ic)) > 0.0846 AS passes FROM ({TABLE})")
def _(t):
    return ic.mean_abs_ic(ic.feature_ic_table(t.panel().where("split = 'train'"), FEATS, Y))


@query("m02_compare_scores", f"""SELECT {r("max(CASE WHEN feature='returns_1d' THEN ic END)", 'ic_new')}, {r("max(CASE WHEN feature='sentiment_1d' THEN ic END)", 'ic_old')}, max(n) FILTER (feature IN ('returns_1d','sentiment_1d')) AS n,
 abs(max(CASE WHEN feature='returns_1d' THEN ic END)) > abs(max(CASE WHEN feature='sentiment_1d' THEN ic END)) AS improves FROM ({TABLE})""")
def _(t):
    return ic.compare_scores(t.panel().where("split = 'train'"), "returns_1d", "sentiment_1d", Y)


@query("w18_rolling_30_day_ic", f"""WITH j AS (SELECT d.date AS day, p.sentiment_1d AS x, p.{Y} AS y FROM (SELECT DISTINCT date FROM panel) d JOIN panel p ON p.date >= d.date - 30 AND p.date < d.date),
k AS ({ranked('j', 'x', 'y', 'day')}), c AS (SELECT day, count(*) AS n, CASE WHEN count(*) >= 20 THEN corr(rx,ry) END AS ic FROM k GROUP BY 1)
SELECT d.date, coalesce(n,0) AS n, {r('ic', 'rolling_ic')}, CASE WHEN ic > 0.03 THEN 1 WHEN ic IS NOT NULL THEN 0 END AS regime FROM (SELECT DISTINCT date FROM panel) d LEFT JOIN c ON c.day=d.date""")
def _(t):
    return ic.rolling_day_ic(t.panel(), "sentiment_1d", Y)


LAST60 = "(SELECT * FROM (SELECT * FROM trades ORDER BY exit_date DESC, id DESC LIMIT 60) WHERE actual <> 0)"


def _order():
    return ["exit_date", "id"], equity.sequence_key("exit_date", "id")


@query("w19_last_60_trades_ic", f"""SELECT (SELECT count(*) FROM trades) AS n_trades, n AS n_valid, {r('ic', 'rolling_ic')}, {r('ic*sqrt(n-2)/sqrt(1-ic*ic+1e-10)', 'ic_tstat')} FROM (SELECT count(*) AS n, corr(rx,ry) AS ic FROM ({ranked(LAST60, 'pred', 'actual')}))""")
def _(t):
    return ic.last_rows_ic(t.trades(), [F.col("exit_date").desc(), F.col("id").desc()], "pred", "actual")


CUS = """WITH s AS (SELECT id, exit_date, CASE WHEN pred*actual > 0 THEN 1.0E0 ELSE -1.0E0 END AS s FROM trades), m AS (SELECT avg(s) AS mu, greatest(stddev_pop(s),0.1) AS sd FROM s),
p AS (SELECT id, exit_date, sum(0.5 - (s-mu)/sd) OVER (ORDER BY exit_date, id) AS p FROM s, m), q AS (SELECT *, p - least(min(p) OVER (ORDER BY exit_date, id), 0) AS c FROM p)"""


@query("w20_cusum_series", digits=3, sql=f"{CUS} SELECT id, {r('c', 'cusum', 3)}, c > 4 AS breach FROM q")
def _(t):
    order, by = _order()
    return equity.cusum(t.trades(), order, by, "pred", "actual").select("id", "cusum", "breach")


@query("w20_cusum_last_60", f"""WITH s AS (SELECT id, exit_date, CASE WHEN pred*actual > 0 THEN 1.0E0 ELSE -1.0E0 END AS s FROM (SELECT * FROM trades ORDER BY exit_date DESC, id DESC LIMIT 60)), m AS (SELECT avg(s) AS mu, greatest(stddev_pop(s),0.1) AS sd FROM s),
p AS (SELECT id, exit_date, sum(0.5 - (s-mu)/sd) OVER (ORDER BY exit_date, id) AS p FROM s, m), q AS (SELECT *, p - least(min(p) OVER (ORDER BY exit_date, id), 0) AS c FROM p)
SELECT {r('arg_max(c, exit_date*1.0 IS NOT NULL)' if False else '(SELECT c FROM q ORDER BY exit_date DESC, id DESC LIMIT 1)', 'cusum_last')}, {r('max(c)', 'cusum_max')}, (SELECT c > 4 FROM q ORDER BY exit_date DESC, id DESC LIMIT 1) AS cusum_breach, {r('4.0', 'cusum_threshold')} FROM q""")
def _(t):
    order, by = _order()
    last = t.trades().orderBy(F.col("exit_date").desc(), F.col("id").desc()).limit(60)
    return equity.cusum_summary(equity.cusum(last, order, by, "pred", "actual"), F.struct("exit_date", "id"))


@query("f15_decay_status", f"""SELECT i.*, c.*, CASE WHEN rolling_ic IS NULL THEN 'GREY' WHEN rolling_ic < 0 OR cusum_breach THEN 'RED' WHEN rolling_ic < 0.02 THEN 'AMBER' ELSE 'GREEN' END AS color,
 CASE WHEN rolling_ic IS NULL THEN 'INSUFFICIENT_DATA' WHEN rolling_ic < 0 OR cusum_breach THEN 'SIGNAL_DEAD' WHEN rolling_ic < 0.02 THEN 'SIGNAL_WEAK' ELSE 'SIGNAL_ALIVE' END AS status FROM ({ORACLES['w19_last_60_trades_ic']}) i, ({ORACLES['w20_cusum_last_60']}) c""")
def _(t):
    order, by = _order()
    last = t.trades().orderBy(F.col("exit_date").desc(), F.col("id").desc()).limit(60)
    c = equity.cusum_summary(equity.cusum(last, order, by, "pred", "actual"), F.struct("exit_date", "id"))
    i = ic.last_rows_ic(t.trades(), [F.col("exit_date").desc(), F.col("id").desc()], "pred", "actual")
    return equity.decay_status(i, c)


EQ = "SELECT id, exit_date, 100000.0E0 + sum(pnl_pct*100) OVER (ORDER BY exit_date, id) AS equity FROM trades"


def _equity(t):
    order, by = _order()
    d = t.trades().withColumn("pnl", F.col("pnl_pct") * 100)
    return equity.equity_curve(d, order, by, initial=100000.0)


@query("w21_equity_drawdown", f"SELECT id, {r('equity', 'equity')}, {r('p', 'peak')}, {r('equity/p-1', 'drawdown')} FROM (SELECT *, max(equity) OVER (ORDER BY exit_date, id) AS p FROM ({EQ}))")
def _(t):
    order, by = _order()
    return equity.drawdown(_equity(t), order, by).select("id", "equity", "peak", "drawdown")


@query("w20_cusum_series_bucketed", digits=3, sql=f"{CUS} SELECT id, {r('c', 'cusum', 3)}, c > 4 AS breach FROM q")
def _(t):
    order, by = _order()
    return equity.cusum(t.trades(), order, by, "pred", "actual", n_buckets=16).select("id", "cusum", "breach")


@query("w21_equity_drawdown_bucketed", f"SELECT id, {r('equity', 'equity')}, {r('p', 'peak')}, {r('equity/p-1', 'drawdown')} FROM (SELECT *, max(equity) OVER (ORDER BY exit_date, id) AS p FROM ({EQ}))")
def _(t):
    order, by = _order()
    e = equity.equity_curve(t.trades().withColumn("pnl", F.col("pnl_pct") * 100), order, by, initial=100000.0, n_buckets=16)
    return equity.drawdown(e, order, by, n_buckets=16).select("id", "equity", "peak", "drawdown")


@query("w22_rolling_win_rate_bucketed", f"SELECT id, {r('avg(CASE WHEN pnl_pct > 0 THEN 100.0 ELSE 0 END) OVER (ORDER BY exit_date, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)', 'win_rate')} FROM trades")
def _(t):
    order, by = _order()
    return equity.rolling_win_rate(t.trades(), order, by, n_buckets=16).select("id", "win_rate")


@query("w22_rolling_win_rate", f"SELECT id, {r('avg(CASE WHEN pnl_pct > 0 THEN 100.0 ELSE 0 END) OVER (ORDER BY exit_date, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)', 'win_rate')} FROM trades")
def _(t):
    order, by = _order()
    return equity.rolling_win_rate(t.trades(), order, by).select("id", "win_rate")


DAYEQ = f"(SELECT exit_date AS date, arg_max(equity, id) AS equity FROM ({EQ}) GROUP BY 1)"


def _daily_equity(t):
    e = _equity(t)
    return e.groupBy(F.col("exit_date").alias("date")).agg(F.max_by("equity", "id").alias("equity"))


@query("w23_equity_statistics", f"""WITH d AS {DAYEQ}, q AS (SELECT date, equity, equity/lag(equity) OVER (ORDER BY date) - 1 AS x, equity/max(equity) OVER (ORDER BY date) - 1 AS dd FROM d),
g AS (SELECT count(x) AS n, arg_min(equity,date) AS a, arg_max(equity,date) AS b, avg(x) AS m, stddev_samp(x) AS s, stddev_samp(CASE WHEN x < 0 THEN x END) AS ds, min(dd) AS dd FROM q)
SELECT n AS n_periods, {r('b/a-1', 'total_return')}, {r('pow(b/a,252.0/n)-1', 'annualized_return')}, {r('m*sqrt(252)/s', 'sharpe_ratio')}, {r('m*sqrt(252)/ds', 'sortino_ratio')}, {r('dd', 'max_drawdown')}, {r('abs((b/a-1)/dd)', 'calmar')}, {r('b/a-1-0.05', 'alpha')}, b/a-1 > 0.05 AS beats_benchmark FROM g""")
def _(t):
    return equity.equity_statistics(_daily_equity(t), benchmark=0.05)


@query("w31_normalised_curve", f"""SELECT date, {r('10000*equity/first_value(equity) OVER (ORDER BY date)', 'portfolio')}, {r('10000+2610*(row_number() OVER (ORDER BY date)-1)/(count(*) OVER ()-1)', 'benchmark')} FROM {DAYEQ}""")
def _(t):
    return equity.normalised_curve(_daily_equity(t), 0.261)


@query("w33_trailing_pnl_limits", f"""WITH d AS (SELECT ticker, exit_date AS date, sum(pnl_pct)/50 AS daily_pnl FROM trades GROUP BY 1,2), w AS (SELECT *, sum(daily_pnl) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS weekly_pnl FROM d)
SELECT ticker, date, {rs('daily_pnl', 'weekly_pnl')}, daily_pnl < -0.00301 AS daily_hit, weekly_pnl < -0.00701 AS weekly_hit, NOT (daily_pnl < -0.00301 OR weekly_pnl < -0.00701) AS can_open FROM w""")
def _(t):
    d = t.trades().groupBy("ticker", F.col("exit_date").alias("date")).agg((F.sum("pnl_pct") / 50).alias("daily_pnl"))
    return equity.trailing_pnl_limits(d, daily_limit=-0.00301, weekly_limit=-0.00701, group=["ticker"])


@query("w33_position_limit", f"""WITH f AS (SELECT ticker, entry_date AS date, 1 AS k FROM trades UNION ALL SELECT ticker, exit_date, -1 FROM trades), o AS (SELECT ticker, date, sum(k) AS k FROM f GROUP BY 1,2),
c AS (SELECT ticker, date, CAST(sum(k) OVER (PARTITION BY ticker ORDER BY date) AS BIGINT) // 4 AS n_open FROM o), d AS (SELECT ticker, exit_date AS date, sum(pnl_pct)/50 AS daily_pnl FROM trades GROUP BY 1,2),
w AS (SELECT d.*, n_open, CASE day(d.date) % 3 WHEN 0 THEN 'BULL' WHEN 1 THEN 'bear' ELSE 'neutral' END AS regime, sum(daily_pnl) OVER (PARTITION BY d.ticker ORDER BY d.date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS weekly_pnl FROM d JOIN c ON c.ticker=d.ticker AND c.date=d.date),
m AS (SELECT *, n_open >= CASE regime WHEN 'BULL' THEN 6 WHEN 'bear' THEN 3 ELSE 2 END AS reached FROM w)
SELECT ticker, date, n_open, regime, reached AS max_positions_reached, NOT (daily_pnl < -0.00301 OR weekly_pnl < -0.00701 OR reached) AS can_open FROM m""")
def _(t):
    """Open positions per key and day (entries less exits so far, in lots of four) against what the regime allows."""
    tr = t.trades()
    flow = tr.select("ticker", F.col("entry_date").alias("date"), F.lit(1).alias("k")).unionByName(tr.select("ticker", F.col("exit_date").alias("date"), F.lit(-1).alias("k")))
    daily = flow.groupBy("ticker", "date").agg(F.sum("k").alias("k"))
    n_open = daily.select("ticker", "date", F.floor(F.sum("k").over(Window.partitionBy("ticker").orderBy("date")) / 4).alias("n_open"))
    regime = F.when(F.day("date") % 3 == 0, "BULL").when(F.day("date") % 3 == 1, "bear").otherwise("neutral")
    d = tr.groupBy("ticker", F.col("exit_date").alias("date")).agg((F.sum("pnl_pct") / 50).alias("daily_pnl")).join(n_open, ["ticker", "date"]).withColumn("regime", regime)
    out = equity.trailing_pnl_limits(d, daily_limit=-0.00301, weekly_limit=-0.00701, group=["ticker"], n_open="n_open", regime="regime")
    return out.select("ticker", "date", "n_open", "regime", "max_positions_reached", "can_open")


@query("m06_effective_ic", f"""WITH w AS ({MONTHLY}), g AS (SELECT count(*) AS n, stddev_pop(ic) AS sd, avg(abs(ic)) AS m FROM w), c AS (SELECT count(*) FILTER (post_count_1d >= 5)/count(*) AS cov FROM panel)
SELECT n AS n_windows, {r('0.05*least(cov,1)*greatest(0,least(1,1-sd/m)) - 0.12/252*5', 'effective_ic')}, {r('round(cov,4)', 'coverage')}, {r('round(greatest(0,least(1,1-sd/m)),4)', 'stability')}, {r('round(0.12/252*5,6)', 'turnover_penalty')} FROM g, c""")
def _(t):
    w = ic.grouped_ic(t.panel(), "returns_1d", Y, F.date_format("date", "yyyy-MM"))
    cov = t.panel().agg(F.count_if(F.col("post_count_1d") >= 5).alias("k"), F.count(F.lit(1)).alias("t"))
    both = w.where("ic IS NOT NULL").crossJoin(F.broadcast(cov))  # one row
    return ic.effective_ic(both, 0.05, F.max("k"), F.max("t"))


@query("m07_regime_gate", f"""WITH w AS ({MONTHLY}), g AS (SELECT count(*) AS n_windows, avg(ic) AS mean_ic, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) AS pp, min(ic) AS worst, stddev_pop(ic) AS sd FROM w)
SELECT n_windows, {r('mean_ic', 'mean_ic')}, {r('pp', 'pct_positive')}, {r('worst', 'worst_ic')}, {r('sd', 'ic_std')}, mean_ic > 0 AS gate_mean, pp >= 0.6 AS gate_sign, worst > -0.02 AS gate_worst, sd < 0.08 AS gate_spread,
 CASE CAST(mean_ic > 0 AS INT)+CAST(pp >= 0.6 AS INT)+CAST(worst > -0.02 AS INT)+CAST(sd < 0.08 AS INT) WHEN 4 THEN 'ADOPT' WHEN 3 THEN 'MARGINAL' ELSE 'REJECT' END AS verdict FROM g""")
def _(t):
    return ic.regime_gate(ic.grouped_ic(t.panel(), "returns_1d", Y, F.date_format("date", "yyyy-MM")))


LIVE = """SELECT p.ticker, p.date, p.pred_5d AS pred, f.x AS actual FROM predictions p LEFT JOIN (SELECT ticker, date, lead(close,5) OVER (PARTITION BY ticker ORDER BY date)/close-1 AS x FROM predictions) f ON f.ticker=p.ticker AND f.date=p.date
WHERE p.date >= DATE '2001-10-31' - 30 AND p.date <= DATE '2001-10-31'"""


@query("m15_live_ic_monitor", f"""WITH l AS ({LIVE}), k AS ({ranked('l', 'pred', 'actual')}), c AS (SELECT corr(rx,ry) AS ic FROM k)
SELECT (SELECT count(*) FROM l) AS n_signals, (SELECT count(actual) FROM l) AS n_completed, (SELECT count(*)-count(actual) FROM l) AS n_skipped, {r('ic', 'live_ic')}, CASE WHEN ic >= 0.03 THEN 'GREEN' WHEN ic >= 0.01 THEN 'AMBER' ELSE 'RED' END AS gate, {r('ic-0.0562', 'ic_vs_baseline')},
 {r('(SELECT avg(pred) FROM l WHERE actual IS NOT NULL)', 'mean_pred_ret')}, {r('(SELECT avg(actual) FROM l)', 'mean_actual_ret')} FROM c""")
def _(t):
    p = t.predictions()
    return ic.live_ic_monitor(p.select("ticker", "date", F.col("pred_5d").alias("pred")), p, "2001-10-31")


@query("m16_model_gate", f"""WITH a AS ({MONTHLY}), b AS ({MONTHLY.replace("'returns_1d'", "'sentiment_1d'").replace("returns_1d", "sentiment_1d")})
SELECT {r('(SELECT avg(ic) FROM a)', 'ic_combined')}, {r('(SELECT stddev_samp(ic) FROM a)', 'std_combined')}, {r('(SELECT avg(ic) FROM b)', 'ic_market')}, (SELECT avg(ic) FROM a) - (SELECT avg(ic) FROM b) > 0.005 AS adds_value""")
def _(t):
    m = lambda c: ic.grouped_ic(t.panel(), c, Y, F.date_format("date", "yyyy-MM"))
    return ic.model_gate(m("returns_1d"), m("sentiment_1d"))


@query("w29_f15_consecutive_red", f"""WITH g AS (SELECT period, {r('ic', 'ic')}, CASE WHEN ic >= 0.03 THEN 'GREEN' WHEN ic >= 0.01 THEN 'AMBER' ELSE 'RED' END AS gate FROM ({MONTHLY})) SELECT period, ic, gate, coalesce(gate='RED' AND lag(gate) OVER (ORDER BY period)='RED', false) AS switch FROM g""")
def _(t):
    from pulsegrid.functions.signals import ic_gate
    m = ic.grouped_ic(t.panel(), "returns_1d", Y, F.date_format("date", "yyyy-MM")).where("ic IS NOT NULL")
    return ic.consecutive_red(m.select("period", "ic", ic_gate(F.col("ic")).alias("gate")), time="period")


# resampling --------------------------------------------------------------------------------------------
def mix_sql(row: str, b: str) -> str:
    def half(row: str) -> str:
        h1 = f"((({row})::BIGINT % 2147483647) * 48271 + ({b})::BIGINT * 69621 + 11) % 2147483647"
        h2 = f"((({h1})*({h1}) + ({h1})*1103515245) % 2147483647)"
        return f"(({h2}*{h2} + ({b})::BIGINT*40692) % 2147483647)"

    return f"({half(row)} * 2147483647 + {half(f'({row}) + ({row}) // 2147483647')})"


def half_sql(row: str, b: str) -> str:
    h1 = f"((({row})::BIGINT % 2147483647) * 48271 + ({b})::BIGINT * 69621 + 11) % 2147483647"
    h2 = f"((({h1})*({h1}) + ({h1})*1103515245) % 2147483647)"
    return f"(({h2}*{h2} + ({b})::BIGINT*40692) % 2147483647)"


def shuffled_sql(rows: str, rounds: int) -> str:
    """SQL rows (with ``x``, ``b`` and ``n``) after every round of the keyed shuffle."""
    for k in range(1, rounds + 1):
        paired = f"SELECT *, ({half_sql(str(k * 7919), 'b')} % n + n - x) % n AS y FROM ({rows})"
        rows = f"SELECT * EXCLUDE (y) REPLACE (CASE WHEN (({half_sql(f'greatest(x, y) * 31 + {k}', 'b')}) >> 16) & 1 = 1 THEN y ELSE x END AS x) FROM ({paired})"
    return rows


NUM = {"numbered": "SELECT id, row_number() OVER (ORDER BY id) AS row_index, pred, actual, pnl_pct FROM trades"}
PERMUTED, BOOTSTRAPPED, BLOCKED = 100, 50, 1000  # replicates of the three tests


def _numbered(t):
    d = t.trades().select("id", "pred", "actual", "pnl_pct")
    return row_index(d, ["id"], F.col("id").cast("double"))


@query("m03_permutation_test", f"""WITH k AS ({ranked('numbered', 'pred', 'actual')}), s AS ({shuffled_sql(f"SELECT b, rx, CAST(row_index - 1 AS BIGINT) AS x, (SELECT count(*) FROM k) AS n FROM k, (SELECT unnest(generate_series(1,{PERMUTED})) AS b)", resample.ROUNDS)}),
n AS (SELECT s.b, corr(s.rx, k.ry) AS ic FROM k JOIN s ON s.x + 1 = k.row_index GROUP BY 1), o AS (SELECT corr(rx,ry) AS o FROM k)
SELECT {r('max(o)', 'observed_ic')}, count(*) AS n_permutations, {r('avg(ic)', 'null_ic_mean')}, {r('stddev_pop(ic)', 'null_ic_std')}, {r('quantile_cont(ic,0.95)', 'null_ic_p95')}, {r('avg(CASE WHEN ic >= o THEN 1.0 ELSE 0 END)', 'p_value')},
 CASE WHEN avg(CASE WHEN ic >= o THEN 1.0 ELSE 0 END) < 0.05 THEN 'SIGNIFICANT' ELSE 'SPURIOUS' END AS verdict FROM n, o""", views=NUM)
def _(t):
    return resample.permutation_test(_numbered(t), "row_index", "pred", "actual", PERMUTED)


BOOT = f"""WITH d AS (SELECT b, {mix_sql('row_index', 'b')} % (SELECT count(*) FROM numbered) + 1 AS row_index FROM numbered, (SELECT unnest(generate_series(1,{BOOTSTRAPPED})) AS b)), j AS (SELECT d.b, n.pred, n.actual FROM d JOIN numbered n ON n.row_index=d.row_index),
k AS ({ranked('j', 'pred', 'actual', 'b')}), c AS (SELECT b, count(*) AS n, corr(rx,ry) AS ic FROM k GROUP BY 1)"""


@query("m04_bootstrap_ic", f"{BOOT} SELECT CAST(b AS INT) AS b, CAST(n AS BIGINT) AS n, {r('ic', 'ic')} FROM c", views=NUM)
def _(t):
    return resample.bootstrap_ic(_numbered(t), "row_index", "pred", "actual", BOOTSTRAPPED)


@query("m04_bootstrap_summary", f"""{BOOT} SELECT count(*) AS n_bootstrap, {r('avg(ic)', 'ic_mean')}, {r('stddev_pop(ic)', 'ic_std')}, {r('quantile_cont(ic,0.025)', 'ic_ci_low')}, {r('quantile_cont(ic,0.975)', 'ic_ci_high')}, CASE WHEN stddev_pop(ic) < 0.03 THEN 'STABLE' ELSE 'UNSTABLE' END AS verdict FROM c""", views=NUM)
def _(t):
    return resample.bootstrap_summary(resample.bootstrap_ic(_numbered(t), "row_index", "pred", "actual", BOOTSTRAPPED))


BLOCK = f"""WITH n AS (SELECT count(*) AS n FROM numbered), s AS (SELECT b, row_index AS slot, {mix_sql('row_index', 'b')} % greatest(1, n.n-4) AS st, n.n FROM numbered, n, (SELECT unnest(generate_series(1,{BLOCKED})) AS b) WHERE (row_index-1) % 5 = 0),
p AS (SELECT b, st + k + 1 AS row_index FROM s, (SELECT unnest(generate_series(0,4)) AS k) WHERE slot + k <= n AND st + k < n), g AS (SELECT p.b, avg(pnl_pct) AS m, stddev_pop(pnl_pct) AS sd FROM p JOIN numbered x ON x.row_index=p.row_index GROUP BY 1)"""


@query("m05_block_bootstrap_sharpe", f"{BLOCK} SELECT CAST(b AS INT) AS b, {r('m/sd*sqrt(252)', 'sharpe')} FROM g WHERE sd > 0", views=NUM)
def _(t):
    return resample.block_bootstrap(_numbered(t), "row_index", "pnl_pct", 5, BLOCKED)


@query("m05_sharpe_interval", f"{BLOCK}, c AS (SELECT m/sd*sqrt(252) AS s FROM g WHERE sd > 0) SELECT count(*) AS n_bootstrap, {r('avg(s)', 'sharpe_mean')}, {r('quantile_cont(s,0.025)', 'sharpe_ci_low')}, {r('quantile_cont(s,0.975)', 'sharpe_ci_high')} FROM c", views=NUM)
def _(t):
    return resample.sharpe_interval(resample.block_bootstrap(_numbered(t), "row_index", "pnl_pct", 5, BLOCKED))


@query("m08_win_interval", f"""WITH g AS (SELECT count(*) AS n, count(*) FILTER (pnl_pct > 0) AS k FROM trades), p AS (SELECT *, k/n AS p, 1.96*1.96 AS z2 FROM g)
SELECT n AS n_trades, k AS n_wins, {r('p', 'win_rate')}, {r('(p + z2/(2*n))/(1+z2/n) - 1.96/(1+z2/n)*sqrt(p*(1-p)/n + z2/(4.0*n*n))', 'ci_low')}, {r('(p + z2/(2*n))/(1+z2/n) + 1.96/(1+z2/n)*sqrt(p*(1-p)/n + z2/(4.0*n*n))', 'ci_high')} FROM p""")
def _(t):
    return resample.win_interval(t.trades())


UPPER = "(SELECT sum(exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1)-n*ln(2))) FROM (SELECT unnest(generate_series(CAST({k} AS BIGINT), n)) AS i))"


@query("m08_significance", f"""WITH g AS (SELECT count(*) AS n, count(*) FILTER (pnl_pct > 0) AS k FROM trades), p AS (SELECT *, k/n AS p, least(1, 2*{UPPER.format(k='greatest(k,n-k)')}) AS two, {UPPER.format(k='k')} AS up FROM g)
SELECT w.*, {r('two', 'p_two_sided')}, {r('up', 'p_greater')}, two < 0.05 AS significant, CASE WHEN two >= 0.05 AND p > 0.5 THEN CAST(ceil(pow(1.96/(2*(p-0.5)),2)*p*(1-p)) AS BIGINT) END AS n_needed FROM ({ORACLES['m08_win_interval']}) w, p""")
def _(t):
    return resample.significance(t.trades())


@query("m09_return_moments", f"""WITH m AS (SELECT avg(pnl_pct) AS m FROM trades) SELECT count(*) AS n, {r('avg(pnl_pct)', 'mean')}, {r('stddev_pop(pnl_pct)', 'sd_pop')}, {r('stddev_samp(pnl_pct)', 'sd_samp')},
 {r('avg(pow(pnl_pct-m.m,3))/pow(avg(pow(pnl_pct-m.m,2)),1.5)', 'skew')}, {r('avg(pow(pnl_pct-m.m,4))/pow(avg(pow(pnl_pct-m.m,2)),2)-3', 'kurt')} FROM trades, m""")
def _(t):
    return resample.return_moments(t.trades(), "pnl_pct")


RAW = """SELECT count(*) AS n, avg(pnl_pct) AS mean, stddev_pop(pnl_pct) AS sp, stddev_samp(pnl_pct) AS ss, avg(pow(pnl_pct-m,3))/pow(avg(pow(pnl_pct-m,2)),1.5) AS sk, avg(pow(pnl_pct-m,4))/pow(avg(pow(pnl_pct-m,2)),2)-3 AS ku FROM trades, (SELECT avg(pnl_pct) AS m FROM trades)"""
# fixed values: standard normal quantiles of 1 - 1/50, 1 - 1/(50 e), 0.95 and 1 - 1/23
Z50, Z50E, Z95, Z23 = 2.053748910631822, 2.4393139538578943, 1.6448536269514715, 1.7116753065097288


@query("m09_sharpe_significance", f"""WITH q AS ({RAW}), a AS (SELECT n, mean/(sp+1e-10) AS sr, sk*sqrt(n*(n-1.0E0))/(n-2) AS g1, (n-1.0E0)/((n-2.0E0)*(n-3.0E0))*((n+1)*ku+6)+3 AS g2 FROM q),
b AS (SELECT *, 1-g1*sr+(g2-1)/4*sr*sr AS sp, 0.5*((1-0.5772156649)*{Z50}+0.5772156649*{Z50E}) AS sr0 FROM a), c AS (SELECT *, sqrt(greatest(sp/(n-1),1e-12)) AS se FROM b), d AS (SELECT *, sr/se AS z1, (sr-sr0)/se AS z2 FROM c)
SELECT n, {r('sr', 'sharpe')}, {r(normal_cdf_sql('d.z1'), 'psr')}, {r(normal_cdf_sql('d.z2'), 'dsr')}, {r('sr0', 'sr0')}, CAST(ceil({Z95}*{Z95}*sp/(sr*sr)+1) AS BIGINT) AS min_track_record FROM d""")
def _(t):
    return resample.sharpe_significance(t.trades(), "pnl_pct")


@query("m09_deflated_confidence", f"""WITH q AS ({RAW}), a AS (SELECT *, mean/ss AS sr FROM q), b AS (SELECT *, (sr-{Z23})/sqrt(abs((1-sk*sr+(ku+2)/4*sr*sr)/(n-1))) AS z FROM a) SELECT n, {r('sr', 'sharpe')}, {r('z', 'z')}, {r(normal_cdf_sql('b.z'), 'confidence')} FROM b""")
def _(t):
    return resample.deflated_confidence(t.trades(), "pnl_pct", 23)


# folds ---------------------------------------------------------------------------------------------------
FOLD = """d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bench)),
f AS (SELECT 1 + (i-252)//63 AS fold, (SELECT min(date) FROM d) AS train_start, (SELECT e.date FROM d e WHERE e.i=d.i-10) AS train_end, date AS test_start, (SELECT e.date FROM d e WHERE e.i=d.i+63) AS test_end FROM d WHERE i >= 252 AND (i-252) % 63 = 0 AND i+63 < n)"""


@query("w34_expanding_folds", f"WITH {FOLD} SELECT CAST(fold AS INT) AS fold, train_start, train_end, test_start, test_end, 'bull_2019' AS regime FROM f")
def _(t):
    return folds.expanding_folds(t.bench())


@query("w35_sliding_folds", """WITH d AS (SELECT DISTINCT date FROM bench), a AS (SELECT min(date) AS a, max(date) AS z FROM d), k AS (SELECT k, z, CAST(a + to_months(CAST(6*k AS INT)) AS DATE) AS ts FROM a, (SELECT unnest(generate_series(0,30)) AS k)),
e AS (SELECT k, z, ts, CAST(ts + INTERVAL 48 MONTH AS DATE) AS te FROM k), v AS (SELECT *, CAST(te + INTERVAL 6 MONTH AS DATE) AS ve FROM e), x AS (SELECT *, ve + 21 AS s FROM v), y AS (SELECT *, CAST(s + INTERVAL 6 MONTH AS DATE) AS tx FROM x)
SELECT CAST(k+1 AS INT) AS fold, (SELECT min(date) FROM d WHERE date >= ts) AS train_start, (SELECT min(date) FROM d WHERE date >= te) AS train_end, (SELECT min(date) FROM d WHERE date >= ve) AS val_end, (SELECT min(date) FROM d WHERE date >= s) AS test_start, (SELECT min(date) FROM d WHERE date >= tx) AS test_end, 'bull_2019' AS regime FROM y WHERE tx <= z""")
def _(t):
    return folds.sliding_folds(t.bench())


@query("j19_panel_in_folds", f"WITH {FOLD} SELECT CAST(f.fold AS INT) AS fold, p.ticker, count(*) AS n, {r('avg(p.returns_1d)', 'mean_return')} FROM panel p JOIN f ON p.date BETWEEN f.test_start AND f.test_end GROUP BY 1,2")
def _(t):
    j = joins.in_folds(t.panel().select("ticker", "date", "returns_1d"), folds.expanding_folds(t.bench()))
    return j.groupBy("fold", "ticker").agg(F.count(F.lit(1)).alias("n"), F.avg("returns_1d").alias("mean_return"))


RET = "r AS (SELECT date, avg(returns_1d)/100 AS x FROM panel WHERE returns_1d IS NOT NULL GROUP BY 1)"
FR = f"""{FOLD}, {RET}, o AS (SELECT f.fold, count(x) AS n, sum(x) AS s, count(*) FILTER (x > 0) AS w, avg(x)*sqrt(252)/stddev_samp(x) AS sh FROM f JOIN r ON r.date BETWEEN test_start AND test_end GROUP BY 1),
i AS (SELECT f.fold, avg(x)*sqrt(252)/stddev_samp(x) AS sh FROM f JOIN r ON r.date BETWEEN train_start AND train_end GROUP BY 1),
t AS (SELECT CAST(f.fold AS INT) AS fold, CASE WHEN f.fold % 3 = 0 THEN 'bear_2022' ELSE 'bull_2019' END AS regime, o.s*100 AS total_return_pct, o.sh AS sharpe, i.sh AS is_sharpe, o.w AS wins, o.n AS n_trades, o.w/o.n AS win_rate FROM f JOIN o ON o.fold=f.fold JOIN i ON i.fold=f.fold)"""


def _fold_table(t):
    daily = t.panel().where("returns_1d IS NOT NULL").groupBy("date").agg((F.avg("returns_1d") / 100).alias("daily_return"))
    f = studies.fold_table(daily, t.bench())
    return daily, f.withColumn("regime", F.when(F.col("fold") % 3 == 0, "bear_2022").otherwise("bull_2019"))


@query("m10_fold_returns", f"WITH {FR} SELECT fold, regime, {rs('total_return_pct', 'sharpe', 'is_sharpe')}, wins, n_trades, {r('win_rate', 'win_rate')} FROM t")
def _(t):
    return _fold_table(t)[1].select("fold", "regime", "total_return_pct", "sharpe", "is_sharpe", "wins", "n_trades", "win_rate")


#: Standard normal quantiles of 1 - 1/n, the benchmark of the deflated confidence for n folds.
STARS = ", ".join(f"({n}, {NormalDist().inv_cdf(1 - 1 / n)!r}::DOUBLE)" for n in range(2, 100))


@query("m10_walk_forward_summary", f"""WITH {FR}, g AS (SELECT count(*) AS n_folds, avg(total_return_pct) AS a, avg(win_rate) AS w, CAST(sum(n_trades) AS BIGINT) AS k, avg(CASE WHEN total_return_pct > 0 THEN 1.0 ELSE 0 END) AS pp,
 coalesce(avg(CASE WHEN regime='bear_2022' THEN total_return_pct END),0) AS br, greatest(-2,least(5,avg(sharpe)/avg(is_sharpe))) AS wfe, (SELECT avg(x)*sqrt(252)/stddev_samp(x) FROM r) AS ps FROM t),
mo AS (SELECT count(*) AS n, avg(x) AS mean, stddev_samp(x) AS ss, avg(pow(x-m,3))/pow(avg(pow(x-m,2)),1.5) AS sk, avg(pow(x-m,4))/pow(avg(pow(x-m,2)),2)-3 AS ku FROM r, (SELECT avg(x) AS m FROM r)),
zz AS (SELECT (mean/ss - star)/sqrt(abs((1-sk*(mean/ss)+(ku+2)/4*(mean/ss)*(mean/ss))/(n-1))) AS z FROM mo, g JOIN (VALUES {STARS}) v(f, star) ON v.f = g.n_folds),
cc AS (SELECT {normal_cdf_sql('zz.z')} AS conf FROM zz)
SELECT n_folds, {r('a', 'avg_return_per_fold')}, {r('w', 'avg_win_rate')}, k AS total_trades, {r('pp', 'pct_positive_folds')}, {r('br', 'bear_return')}, {r('ps', 'pooled_sharpe')}, {r('conf', 'dsr_confidence')}, {r('wfe', 'wfe')},
 ps >= 0.8 AS g1, pp >= 0.6 AS g2, br > -20 AS g3, wfe >= 0.5 AS g4, conf >= 0.95 AS g5, ps >= 0.8 AND pp >= 0.6 AND br > -20 AND wfe >= 0.5 AND conf >= 0.95 AS overall FROM g, cc""")
def _(t):
    daily, f = _fold_table(t)
    f = settle(f, "folds")
    return folds.walk_forward_summary(f, daily, dsr=resample.deflated_confidence(daily, "daily_return", f.count()))


@query("a12_regime_fold_summary", f"WITH {FR} SELECT regime, count(*) AS n_folds, {r('round(avg(total_return_pct),2)', 'avg_return')}, {r('round(avg(sharpe),3)', 'avg_sharpe')}, {r('round(sum(wins)/sum(n_trades),4)', 'win_rate')}, CAST(sum(n_trades) AS BIGINT) AS n_trades FROM t GROUP BY 1")
def _(t):
    return rollups.group_fold_summary(_fold_table(t)[1])


@query("a31_fold_stability", f"""WITH {FR}, v AS (SELECT *, CASE WHEN abs(is_sharpe) > 1e-6 THEN sharpe/is_sharpe END AS wfe FROM t), oo AS (SELECT *, count(wfe) OVER (ORDER BY fold) AS i, count(wfe) OVER () AS n FROM v),
g AS (SELECT count(*) AS n_folds, stddev_pop(sharpe) AS sd, arg_min(fold, sharpe) AS wf, arg_max(fold, sharpe) AS bf, min(sharpe) > 0 AS ap, min(sharpe) < -0.5 AS fr, avg(wfe) FILTER (i <= n//2) AS e, avg(wfe) FILTER (i > n//2) AS l, avg(wfe) AS m, stddev_pop(wfe) AS s FROM oo)
SELECT n_folds, {r('sd', 'sharpe_std')}, wf AS worst_fold, bf AS best_fold, ap AS all_positive, fr AS fragile, {r('e', 'early_wfe')}, {r('l', 'late_wfe')}, {r('m', 'mean_wfe')}, {r('s', 'std_wfe')}, CASE WHEN sd > 0.5 THEN 'HIGH_VARIANCE' WHEN fr THEN 'FRAGILE' ELSE 'STABLE' END AS status,
 CASE WHEN l < e - 0.3 THEN 'LOSING_EDGE' WHEN m BETWEEN 0.5 AND 2.5 AND s < 1.5 THEN 'STABLE' ELSE 'NONE' END AS trend FROM g""")
def _(t):
    return rollups.fold_stability(_fold_table(t)[1])


@query("m12_check3_purge_gap", f"WITH {FOLD} SELECT '3_purge_gap' AS \"check\", CASE WHEN count(*) FILTER (date_diff('day', train_end, test_start) < 14) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) FILTER (date_diff('day', train_end, test_start) < 14) AS n_violations FROM f")
def _(t):
    return quality.check_purge_gap(folds.expanding_folds(t.bench()))


ALLF = "(" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, {Y} AS y FROM panel" for c in FEATS) + ")"
SUITE = f"""SELECT '1_future_targets' AS "check", CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS n_violations FROM panel WHERE date >= DATE '2001-11-23' AND {Y} <> 0
UNION ALL SELECT '2_return_recomputation', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FROM (SELECT *, lag(close,1) OVER w AS p1, lag(close,20) OVER w AS p20, row_number() OVER w AS i FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE i > 20 AND (abs(returns_1d-(close-p1)/p1) > 0.005 OR abs(returns_20d-(close-p20)/p20) > 0.005)
UNION ALL SELECT * FROM ({ORACLES['m12_check3_purge_gap']})
UNION ALL SELECT '4_target_correlation', CASE WHEN count(*) FILTER (a > 0.85) > 0 THEN 'FAIL' WHEN count(*) FILTER (a > 0.5) > 0 THEN 'WARN' ELSE 'PASS' END, count(*) FILTER (a > 0.5) FROM (SELECT feature, abs(corr(rx,ry)) AS a FROM ({ranked(ALLF, 'x', 'y', 'feature')}) GROUP BY 1)
UNION ALL SELECT '5_normalisation', CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'PASS' END, count(*) FROM (SELECT min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_samp(v) AS sd FROM (SELECT 'v' AS f, volume AS v FROM panel UNION ALL SELECT 'r', returns_1d FROM panel) WHERE v IS NOT NULL GROUP BY f)
 WHERE (lo >= -0.01 AND hi <= 1.01 AND m > 0.1 AND m < 0.9) OR (abs(m) < 0.05 AND sd > 0.9 AND sd < 1.1 AND abs(lo) < 5 AND abs(hi) < 5)
UNION ALL SELECT '6_duplicates', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, CAST(coalesce(sum(n),0) AS BIGINT) FROM (SELECT count(*) AS n FROM panel GROUP BY ticker, date HAVING count(*) > 1)
UNION ALL SELECT '7_timestamps', CASE WHEN w > 0 THEN 'WARN' ELSE 'PASS' END, w FROM (SELECT count(*) AS w FROM (SELECT p.*, row_number() OVER (PARTITION BY p.ticker ORDER BY p.date) AS i FROM panel p JOIN (SELECT ticker, min(date) AS f FROM panel GROUP BY 1) k ON k.ticker=p.ticker WHERE k.f >= (SELECT min(date) FROM panel) + 60) WHERE i <= 3 AND abs(sentiment_accel) > 0.001)"""


@query("m12_integrity_suite", SUITE)
def _(t):
    return quality.integrity_suite(t.panel(), folds.expanding_folds(t.bench()), FEATS, ["returns_1d", "volume"], today="2001-11-30",
                                   train_end="1998-12-31", test_start="1999-01-01")


# Granger -------------------------------------------------------------------------------------------------
G = ["sentiment_1d", "post_count_1d"]
GL = "(" + " UNION ALL ".join(f"SELECT '{c}' AS feature, year, date, ticker, {Y} AS y, CAST({c} AS DOUBLE) AS x FROM panel WHERE {Y} IS NOT NULL AND {c} IS NOT NULL" for c in G) + ")"


def _seq():
    return F.datediff("date", F.lit("1970-01-01").cast("date")).cast("double")


GSQL = f"""WITH l AS (SELECT feature, year, y, lag(y) OVER w AS y1, lag(x) OVER w AS x1 FROM {GL} WINDOW w AS (PARTITION BY feature, year ORDER BY date, ticker)),
s AS (SELECT feature, year, count(*) AS n, var_samp(y) AS vy, var_samp(y1) AS v1, var_samp(x1) AS v2, covar_samp(y,y1) AS c1, covar_samp(y,x1) AS c2, covar_samp(y1,x1) AS c12 FROM l WHERE y1 IS NOT NULL GROUP BY 1,2),
f AS (SELECT feature, year, n, vy - c1*c1/v1 AS sr, vy - (c1*v2-c2*c12)/(v1*v2-c12*c12)*c1 - (c2*v1-c1*c12)/(v1*v2-c12*c12)*c2 AS sf FROM s)
SELECT feature, year, n+1 AS n, n-3 AS dof, {r('(sr-sf)/(sf/(n-3))', 'f_stat')} FROM f"""


@query("m11_granger_lag1", GSQL)
def _(t):
    return granger.granger_lag1(t.panel(), G, Y, "year", ["date", "ticker"], _seq(), with_p=False)


@query("m11_granger_lag1_bucketed", GSQL)
def _(t):
    return granger.granger_lag1(t.panel(), G, Y, "year", ["date", "ticker"], _seq(), with_p=False, n_buckets=16)


@query("m11_granger_significant_years", f"""WITH t AS ({GSQL}), p AS (SELECT *, sqrt(f_stat) AS t, CAST(dof AS DOUBLE) AS v FROM t), q AS (SELECT feature, year, {t_two_sided_sql('p.t', 'p.v')} < 0.05 AS sig FROM p)
SELECT CASE feature WHEN 'sentiment_1d' THEN 'sentiment' ELSE 'attention' END AS family, count(DISTINCT year) AS n_groups, count(DISTINCT CASE WHEN sig THEN year END) AS n_significant FROM q GROUP BY 1""")
def _(t):
    tests = granger.granger_lag1(t.panel(), G, Y, "year", ["date", "ticker"], _seq())
    return granger.significant_groups(tests, {"sentiment": ["sentiment_1d"], "attention": ["post_count_1d"]}, "year")


# ordered scans on their own ---------------------------------------------------------------------------------
@query("x07_running_extremes", f"SELECT id, {r('sum(pnl_pct) OVER w', 's')}, {r('max(pnl_pct) OVER w', 'hi')}, {r('min(pnl_pct) OVER w', 'lo')} FROM trades WINDOW w AS (ORDER BY exit_date, id)")
def _(t):
    order, by = _order()
    return running(t.trades(), order, by, {"s": "pnl_pct"}, {"hi": "pnl_pct"}, {"lo": "pnl_pct"}).select("id", "s", "hi", "lo")


# studies -----------------------------------------------------------------------------------------------------
FAM = {"market": ["returns_1d", "returns_20d", "relative_volume"], "attention": ["post_count_1d"], "sentiment": ["sentiment_1d"]}
YL = "(" + " UNION ALL ".join(f"SELECT '{f}' AS family, '{c}' AS feature, year, CAST({c} AS DOUBLE) AS x, {Y} AS y FROM panel" for f, cs in FAM.items() for c in cs) + ")"


@query("m26_source_study", f"""WITH c AS (SELECT family, feature, year, CASE WHEN count(*) >= 20 THEN corr(rx,ry) END AS ic FROM ({ranked(YL, 'x', 'y', 'feature, year')}) GROUP BY 1,2,3), f AS (SELECT family, count(ic) AS n, avg(ic) AS m, avg(abs(ic)) AS a, stddev_pop(ic) AS s FROM c GROUP BY 1)
SELECT family, n AS n_cells, {r('m', 'mean_ic')}, {r('a', 'mean_abs_ic')}, {r('s', 'ic_std')}, {r("a - (SELECT a FROM f WHERE family='market')", 'improvement')}, a = (SELECT max(a) FROM f) AS best FROM f""")
def _(t):
    return studies.source_study(t.panel(), FAM, Y)


VERDICT = f"""WITH w AS ({MONTHLY}), e AS (SELECT 0.05*0.5*greatest(0,least(1,1-stddev_pop(ic)/avg(abs(ic)))) - 0.12/252*5 AS eff FROM w),
g AS (SELECT (SELECT verdict IN ('ADOPT','MARGINAL') FROM ({ORACLES['m07_regime_gate']})) AS r1, (SELECT p_value < 0.10 FROM ({ORACLES['m03_permutation_test']})) AS r2a, (SELECT p_value < 0.05 FROM ({ORACLES['m03_permutation_test']})) AS r2b,
 (SELECT eff > 0 FROM e) AS r3, (SELECT ic_combined >= ic_market - 0.005 FROM ({ORACLES['m16_model_gate']})) AS r4)
SELECT *, CASE WHEN r1 AND r2a AND r3 AND r4 AND r2b THEN 'ADOPT' WHEN r1 AND r2a AND r3 AND r4 THEN 'ADOPT_MARGINAL' ELSE 'REJECT' END AS verdict FROM g"""


@query("m27_adoption_verdict", VERDICT)
def _(t):
    m = lambda c: ic.grouped_ic(t.panel(), c, Y, F.date_format("date", "yyyy-MM"))
    perm = resample.permutation_test(_numbered(t), "row_index", "pred", "actual", PERMUTED)
    return studies.adoption_verdict(ic.regime_gate(m("returns_1d")), perm, ic.effective_ic(m("returns_1d").where("ic IS NOT NULL"), 0.05, 1, 2),
                                    m("returns_1d"), m("sentiment_1d"))


_ = Window
