"""Scores, signal rules, gates and sizing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import clamp, flag, ratio


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def regime_score(above_200="spy_above_200ma", pct="vix_percentile") -> Column:
    """F10."""
    return 0.6 * _c(above_200) + 0.4 * (1.0 - _c(pct))


def fear_volume(pct="vix_percentile", rel_volume="relative_volume") -> Column:
    return _c(pct) * _c(rel_volume)


def composite_score(p1="pred_1d", p3="pred_3d", p5="pred_5d") -> Column:
    """F11."""
    return 0.5 * _c(p5) + 0.3 * _c(p3) + 0.2 * _c(p1)


def volatility_adjusted(score, vol, target=0.02, floor=0.005, cap=0.08) -> Column:
    """score scaled to a common volatility; unknown volatility leaves it as is."""
    v = _c(vol)
    return F.when(v.isNull() | (v <= 0), _c(score)).otherwise(_c(score) * target / clamp(v, floor, cap))


def signal_rule(p1="pred_1d", p3="pred_3d", p5="pred_5d", threshold=0.015) -> Column:
    """struct(signal, hold_days, horizon, best_pred, confidence), 5D before 3D before 1D,
    bullish before bearish."""
    def pick(sig: str, hold: int, hz: str, p: Column) -> Column:
        return F.struct(F.lit(sig).alias("signal"), F.lit(hold).alias("hold_days"), F.lit(hz).alias("horizon"),
                        p.alias("best_pred"), F.least(F.abs(p) / (2 * threshold), F.lit(1.0)).alias("confidence"))
    a, b, c = _c(p1), _c(p3), _c(p5)
    return (
        F.when(c >= threshold, pick("BULLISH", 5, "5D", c))
        .when(b >= threshold, pick("BULLISH", 3, "3D", b))
        .when(a >= threshold, pick("BULLISH", 1, "1D", a))
        .when(c <= -threshold, pick("BEARISH", 5, "5D", c))
        .when(b <= -threshold, pick("BEARISH", 3, "3D", b))
        .when(a <= -threshold, pick("BEARISH", 1, "1D", a))
        .otherwise(pick("NEUTRAL", 5, "5D", c))
    )


def meaningful(p1="pred_1d", p3="pred_3d", p5="pred_5d", floor=0.005) -> Column:
    """Noise filter: some horizon moves by at least ``floor``."""
    return F.greatest(F.abs(_c(p1)), F.abs(_c(p3)), F.abs(_c(p5))) >= floor


def classify_signals(df: DataFrame, p1="pred_1d", p3="pred_3d", p5="pred_5d", price="close", threshold=0.015,
                     floor=0.005) -> DataFrame:
    """F12 on a table of predictions, with price targets."""
    d = df.where(meaningful(p1, p3, p5, floor)).withColumn("_s", signal_rule(p1, p3, p5, threshold))
    targets = {f"price_target_{h}": F.round(_c(price) * (1 + _c(p)), 2) for h, p in (("1d", p1), ("3d", p3), ("5d", p5))}
    return d.select("*", "_s.*").drop("_s").withColumns({
        "confidence": F.round("confidence", 4), "predicted_return": F.round("best_pred", 6), **targets}).drop("best_pred")


def put_call_label(pcr="pcr", confirm=0.7, caution=1.0) -> Column:
    """F13."""
    p = _c(pcr)
    return F.when(p.isNull(), "UNKNOWN").when(p < confirm, "CONFIRM").when(p <= caution, "NEUTRAL").otherwise("CAUTION")


def put_call_multiplier(pcr="pcr", caution=1.0, size=0.5) -> Column:
    return F.when(_c(pcr) > caution, size).otherwise(1.0)


def market_regime(above_200: Column, ret_60: Column, ic: Column | None = None, min_ic=0.03) -> Column:
    """positive / neutral / negative from trend, 60-row return and the live IC if known."""
    ok = (ic.isNull() | (ic > min_ic)) if ic is not None else F.lit(True)
    return (
        F.when(above_200.isNull() | ret_60.isNull(), "neutral")
        .when(~above_200 | (ret_60 < -0.10), "negative")
        .when(above_200 & (ret_60 > 0) & ok, "positive")
        .otherwise("neutral")
    )


# fixed values: sizing by regime
REGIME_SIZING = {"positive": 1.0, "neutral": 0.75, "negative": 0.5}


def regime_multiplier(label: Column, sizing: dict[str, float] | None = None) -> Column:
    s = sizing or REGIME_SIZING
    return F.when(label == "positive", s["positive"]).when(label == "negative", s["negative"]).otherwise(s["neutral"])


def ic_gate(ic: Column, green=0.03, amber=0.01) -> Column:
    """F15."""
    return F.when(ic >= green, "GREEN").when(ic >= amber, "AMBER").when(ic.isNotNull(), "RED")


def decay_colour(ic: Column, breach: Column, weak=0.02) -> Column:
    """colour of the decay monitor."""
    return (F.when(ic.isNull(), "GREY").when((ic < 0) | breach, "RED").when(ic < weak, "AMBER").otherwise("GREEN"))


def position_size(df: DataFrame, capital: float, price="close", atr="atr_14", multiplier="regime_multiplier",
                  risk=0.02, cap=0.25) -> DataFrame:
    """F16: risk-targeted position; whole shares; nothing without a price or range."""
    p, a = _c(price), _c(atr)
    ok = (a > 0) & (p > 0)
    want = F.least(capital * risk * ratio(p, a) * _c(multiplier), F.lit(capital * cap))
    n = F.when(ok, F.floor(want / F.nullif(p, F.lit(0.0)))).otherwise(0)
    d = df.withColumn("n_shares", F.coalesce(n, F.lit(0)).cast("bigint"))
    usd = F.col("n_shares") * p
    return d.withColumns({
        "position_dollars": F.round(F.when(ok, usd).otherwise(0.0), 2),
        "pct_of_portfolio": F.round(F.when(ok, usd / capital).otherwise(0.0), 4),
        "risk_dollars": F.round(F.when(ok, F.col("n_shares") * a).otherwise(0.0), 2),
    })


# fixed values: risk-budget sizing
RISK_BUDGET = {
    "base_risk": 0.005, "max_risk": 0.0075, "stop_mult": 2.5, "stop_min": -0.12, "stop_max": -0.04,
    "stop_default": -0.08, "cap_high": 0.20, "cap_mid": 0.15, "cap_low": 0.10,
}


def risk_budget_position(df: DataFrame, equity: float, price="close", atr="atr_14", confidence="confidence",
                         regime="regime", rank="signal_rank", below="below_ma20", spec: dict | None = None) -> DataFrame:
    """F16, risk-budget form: dollar risk by regime, rank, confidence and trend; stop from the
    range, clamped; the loss at the stop never exceeds the ceiling."""
    s = {**RISK_BUDGET, **(spec or {})}
    p, a, r = _c(price), _c(atr), F.lower(_c(regime))
    ok = (a > 0) & (p > 0)
    up, down = r.isin("bull", "positive"), r.isin("bear", "negative")
    mult = F.when(up, 1.0).when(down, 0.5).otherwise(0.3)
    cap = F.when(up, s["cap_high"]).when(down, s["cap_low"]).otherwise(s["cap_mid"])
    decay = F.greatest(F.lit(0.4), 1.0 - (_c(rank) - 1) * 0.2)
    conf = 0.5 + 0.5 * clamp(_c(confidence), 0.0, 1.0)
    risk = F.least(s["base_risk"] * mult * decay * conf * F.when(_c(below), 0.5).otherwise(1.0), F.lit(s["max_risk"]))
    rng = ratio(a, p)
    stop = F.greatest(F.lit(s["stop_min"]), F.least(F.lit(s["stop_max"]), -s["stop_mult"] * rng))
    d = df.withColumns({"_rng": rng, "_stop": stop, "_risk": risk, "_cap": cap})
    dist = p * F.abs("_stop")
    wish = F.floor(F.least(equity * ratio("_risk", "_rng"), equity * F.col("_cap")) / F.nullif(p, F.lit(0.0)))
    ceiling = F.floor(equity * s["max_risk"] / F.nullif(dist, F.lit(0.0)))
    n = F.when(wish * dist > equity * s["max_risk"], ceiling).otherwise(wish)
    d = d.withColumn("n_shares", F.coalesce(F.when(ok, n), F.lit(0)).cast("bigint"))
    return d.withColumns({
        "size_dollars": F.round(F.when(ok, F.col("n_shares") * p).otherwise(0.0), 2),
        "stop_pct": F.round(F.when(ok, F.col("_stop")).otherwise(s["stop_default"]), 6),
        "stop_price": F.when(ok, F.round(p * (1 + F.col("_stop")), 4)).otherwise(0.0),
        "risk_dollars": F.round(F.when(ok, F.col("n_shares") * dist).otherwise(0.0), 2),
    }).drop("_rng", "_stop", "_risk", "_cap")


def slippage(growth, base=0.001, per_unit=0.0005, cap=3.0) -> Column:
    """F17."""
    return F.round(base + per_unit * F.least(_c(growth), F.lit(cap)), 6)


def volatility_target_size(capital, score, vol, target=0.01, default_vol=0.02) -> Column:
    """dollars for a volatility target, between 5 % and 25 % of the capital."""
    v = clamp(F.coalesce(_c(vol), F.lit(default_vol)), 0.005, 0.05)
    conf = 0.5 + 0.5 * F.least(F.abs(_c(score)) / 0.05, F.lit(1.0))
    cap = _c(capital)
    return F.greatest(F.least(cap * 0.15 * (target / v) * conf, cap * 0.25), cap * 0.05)


def regime_allocation(above_200, pct, default=0.30) -> Column:
    """share of capital by market regime."""
    a, v = _c(above_200), _c(pct)
    return (F.when(a.isNull() | v.isNull(), default).when((a >= 1.0) & (v < 0.5), 0.35)
            .when((a < 1.0) | (v > 0.75), 0.20).otherwise(default))


def exit_rule(price, entry, stop, due: Column, take_profit=0.15) -> Column:
    """stop loss, then take profit, then expiry; null while nothing applies or unpriced."""
    ret = ratio(_c(price) - _c(entry), _c(entry))
    return (F.when(_c(price).isNull(), None).when(ret <= _c(stop), "stop_loss").when(ret >= take_profit, "take_profit_cap")
            .when(due, "hold_period_expired"))


def check_exits(positions: DataFrame, prices: DataFrame, today, key="ticker", price="price", default_stop=-0.08,
                take_profit=0.15) -> DataFrame:
    """F18 on a table: positions that must close today, with result and reason."""
    j = positions.join(prices.select(key, price), key)
    stop = F.coalesce(F.col("stop_pct"), F.lit(default_stop)) if "stop_pct" in positions.columns else F.lit(default_stop)
    due = F.lit(today).cast("date") >= F.col("stop_date")
    return j.withColumn("exit_reason", exit_rule(price, "entry_price", stop, due, take_profit)).where(
        "exit_reason IS NOT NULL").withColumn(
        "pnl_pct", F.round(ratio(F.col(price) - F.col("entry_price"), F.col("entry_price")), 4))


def features_to_map(columns: list[str]) -> Column:
    """columns to a feature map."""
    return F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c).cast("double") for c in columns]))


def map_to_features(df: DataFrame, vector: str, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.try_element_at(F.col(vector), F.lit(c)), F.lit(0.0)) for c in columns})


def density_boost(count, second, per=20, cap=5) -> Column:
    """first-feed count plus a capped share of the second feed's count."""
    return _c(count) + F.least(F.floor(_c(second) / per), F.lit(cap))

