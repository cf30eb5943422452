"""Technical features of daily bars, one row per (key, date).

All windows share ``partitionBy(key).orderBy(date)``: Spark sorts a key once and
evaluates them together. A key's rows are bounded by calendar days, however large
the raw feed is, because bars are aggregated per (key, date) before they get here.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import flag, ratio


def by_key(key: str | list[str] = "ticker", time: str = "date") -> Window:
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(time)


def trailing(n: int, key="ticker", time="date", include_current: bool = True):
    w = by_key(key, time)
    return w.rowsBetween(-(n - 1), 0) if include_current else w.rowsBetween(-n, -1)


def mean_over(c: Column | str, w, min_rows: int) -> Column:
    """Window mean, null until ``min_rows`` non-null values are in the frame."""
    return F.when(F.count(c).over(w) >= min_rows, F.avg(c).over(w))


def pct_change(df: DataFrame, horizons=(1, 5, 20, 60), value="close", key="ticker", time="date",
               prefix="returns_") -> DataFrame:
    """Change against the value ``n`` rows earlier."""
    w = by_key(key, time)
    return df.withColumns(
        {f"{prefix}{n}d": ratio(F.col(value), F.lag(value, n).over(w)) - 1 for n in horizons}
    )


def forward_returns(df: DataFrame, horizons=(1, 3, 5, 10), value="close", key="ticker", time="date",
                    prefix="target_return_") -> DataFrame:
    """Change to the value ``n`` rows later; the last rows stay null."""
    w = by_key(key, time)
    return df.withColumns(
        {f"{prefix}{n}d": ratio(F.lead(value, n).over(w), F.col(value)) - 1 for n in horizons}
    )


def rsi_simple(df: DataFrame, n=14, value="close", key="ticker", time="date", out="rsi_14",
               no_loss: float | None = 50.0) -> DataFrame:
    """RSI with plain means; no loss in the window (or too few rows) gives ``no_loss``."""
    w, wn = by_key(key, time), trailing(n, key, time)
    d = df.withColumn("_d", F.col(value) - F.lag(value, 1).over(w))
    gain = mean_over(F.greatest(F.col("_d"), F.lit(0.0)) + F.col("_d") * 0, wn, n)
    loss = mean_over(F.greatest(-F.col("_d"), F.lit(0.0)) + F.col("_d") * 0, wn, n)
    d = d.withColumns({"_g": gain, "_l": loss})
    rsi = 100.0 - 100.0 / (1.0 + ratio("_g", "_l"))
    if no_loss is not None:
        rsi = F.coalesce(rsi, F.lit(float(no_loss)))
    return d.withColumn(out, rsi).drop("_d", "_g", "_l")


def true_range(df: DataFrame, key="ticker", time="date", out="tr") -> DataFrame:
    prev = F.lag("close", 1).over(by_key(key, time))
    return df.withColumn(
        out,
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)),
    )


def atr_simple(df: DataFrame, n=14, key="ticker", time="date", out="atr_14") -> DataFrame:
    """W8, plain-mean form."""
    d = true_range(df, key, time, "_tr")
    return d.withColumn(out, mean_over("_tr", trailing(n, key, time), n)).drop("_tr")


def wilder_average(df: DataFrame, inputs: dict[str, str], n=14, key="ticker", time="date",
                   normalised: bool = False) -> DataFrame:
    """Recursive average with weight 1/n for each ``{out: source}``: seeded by the first
    value, or (``normalised``) with weights that always add up to one.

    The recursion is order dependent, so each key's daily rows are folded in one
    Python task; keys spread over the cluster.
    """
    alpha = 1.0 / n
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    schema += "".join(f", `{o}` double" for o in inputs)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="mergesort")
        for o, src in inputs.items():
            pdf[o] = pdf[src].astype("float64").ewm(alpha=alpha, adjust=normalised, ignore_na=True).mean()
        return pdf

    return df.groupBy(key).applyInPandas(fold, schema)


def atr_wilder(df: DataFrame, n=14, key="ticker", time="date", out="atr_14") -> DataFrame:
    """W8, recursive form; ``<out>_norm`` is the same divided by close."""
    d = wilder_average(true_range(df, key, time, "_tr"), {out: "_tr"}, n, key, time)
    return d.withColumn(f"{out}_norm", ratio(out, "close")).drop("_tr")


def rsi_wilder(df: DataFrame, n=14, value="close", key="ticker", time="date", out="rsi_14") -> DataFrame:
    """RSI on recursively averaged gains and losses."""
    d = df.withColumn("_d", F.col(value) - F.lag(value, 1).over(by_key(key, time)))
    d = d.withColumns({
        "_up": F.when(F.col("_d").isNotNull(), F.greatest(F.col("_d"), F.lit(0.0))),
        "_dn": F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0))),
        "_i": F.count("_d").over(by_key(key, time)),
    })
    d = wilder_average(d, {"_g": "_up", "_l": "_dn"}, n, key, time)
    rsi = 100.0 * ratio(F.col("_g"), F.col("_g") + F.col("_l"))
    return d.withColumn(out, F.when(F.col("_i") >= n, rsi)).drop("_d", "_up", "_dn", "_i", "_g", "_l")


def relative_volume(df: DataFrame, n=20, min_rows=20, default: float | None = None, key="ticker",
                    time="date", out="relative_volume") -> DataFrame:
    """Volume over its trailing mean."""
    w = trailing(n, key, time)
    return df.withColumn(out, ratio(F.col("volume"), mean_over("volume", w, min_rows), default))


def ma_distance(df: DataFrame, n=20, min_rows: int | None = None, default: float | None = None,
                value="close", key="ticker", time="date", out: str | None = None) -> DataFrame:
    """Relative distance from the trailing mean."""
    m = mean_over(value, trailing(n, key, time), min_rows or n)
    return df.withColumn(out or f"dist_from_{n}ma", ratio(F.col(value) - m, m, default))


def above_average(df: DataFrame, n=200, min_rows: int | None = None, value="close", key="ticker",
                  time="date", out: str | None = None) -> DataFrame:
    """1.0 where the value lies above its trailing mean, else 0.0."""
    m = mean_over(value, trailing(n, key, time), min_rows or n)
    return df.withColumn(out or f"above_{n}ma", flag(F.col(value) > m))


def rolling_percentile(df: DataFrame, value="close", n=252, min_rows=20, default=0.5, key="ticker",
                       time="date", out="percentile") -> DataFrame:
    """Share of the last ``n`` rows strictly below the current one."""
    w = trailing(n, key, time)
    d = df.withColumn("_win", F.collect_list(value).over(w))
    share = F.size(F.filter("_win", lambda v: v < F.col(value))) / F.size("_win")
    return d.withColumn(
        out, F.when(F.size("_win") >= min_rows, share.cast("double")).otherwise(F.lit(default))
    ).drop("_win")


def jump_decay(df: DataFrame, threshold=0.05, n=20, cap=0.1, value="close", key="ticker", time="date",
               out="pead_proxy") -> DataFrame:
    """Moves above the threshold, fading linearly over the next ``n`` rows, clipped."""
    w = by_key(key, time)
    d = df.withColumn("_r", ratio(F.col(value), F.lag(value, 1).over(w)) - 1)
    d = d.withColumn("_jump", F.when(F.abs("_r") > threshold, F.col("_r")).otherwise(0.0))
    total = F.lit(0.0)
    for i in range(1, n):
        total = total + F.coalesce(F.lag("_jump", i).over(w), F.lit(0.0)) * (1.0 - i / n)
    return d.withColumn(out, F.greatest(F.lit(-cap), F.least(F.lit(cap), total))).drop("_r", "_jump")


def abnormal_attention(df: DataFrame, count="post_count_1d", n=20, min_rows=5, cap=10.0, key="ticker",
                       time="date", out="abnormal_attention_1d") -> DataFrame:
    """Count over (trailing mean + 1), capped; a mean from too few rows counts as 1."""
    m = F.coalesce(mean_over(count, trailing(n, key, time), min_rows), F.lit(1.0))
    return df.withColumn(out, F.when(F.col(count).isNotNull(), F.least(F.lit(float(cap)), F.col(count) / (m + 1.0))))


def realised_volatility(df: DataFrame, n=20, min_rows=10, value="close", key="ticker", time="date",
                        out="vol_20d") -> DataFrame:
    """Sample deviation of one-row returns."""
    w = by_key(key, time)
    d = df.withColumn("_r", ratio(F.col(value), F.lag(value, 1).over(w)) - 1)
    wn = trailing(n, key, time)
    return d.withColumn(
        out, F.when(F.count("_r").over(wn) >= min_rows, F.stddev_samp("_r").over(wn))
    ).drop("_r")


def benchmark_regime_features(df: DataFrame, key="ticker", time="date") -> DataFrame:
    """Returns, volatility and trend flags of a benchmark series."""
    d = pct_change(df, (20, 60), key=key, time=time, prefix="ret_")
    d = realised_volatility(d, 20, 20, key=key, time=time, out="vol_20d")
    d = above_average(d, 200, key=key, time=time, out="above_200")
    d = above_average(d, 50, key=key, time=time, out="above_50")
    return d.withColumn("momentum_diff", F.col("ret_20d") - F.col("ret_60d"))


def below_trend(df: DataFrame, n=20, min_rows=20, strict_past=False, value="close", key="ticker",
                time="date", out="below_ma20") -> DataFrame:
    """Value below its trailing mean; with ``strict_past`` only earlier rows are used."""
    w = trailing(n, key, time, include_current=not strict_past)
    current = F.lag(value, 1).over(by_key(key, time)) if strict_past else F.col(value)
    cond = (F.count(value).over(w) >= min_rows) & (
        (current <= F.avg(value).over(w)) if strict_past else (current < F.avg(value).over(w))
    )
    return df.withColumn(out, F.coalesce(cond, F.lit(False)))
