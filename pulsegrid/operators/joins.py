"""Joins of panels, feeds, events and prices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.exprs import ratio
from pulsegrid.functions.matching import occurring_keys
from pulsegrid.operators.technical import by_key


def panel_join(left: DataFrame, right: DataFrame, keys=("ticker", "date"), how="inner") -> DataFrame:
    """J1."""
    return left.join(right, list(keys), how)


def left_chain(grid: DataFrame, sides: Sequence[tuple[DataFrame, dict[str, float]]], keys=("ticker", "date")) -> DataFrame:
    """Left joins one after another, each with its defaults; all share one key, so the
    grid is shuffled once."""
    out = grid
    for side, defaults in sides:
        out = out.join(side, list(keys), "left")
        if defaults:
            out = out.fillna(defaults)
    return out


def key_calendar(keys: DataFrame, days: DataFrame, starts: DataFrame | None, default_start: str,
                 key="ticker", time="date", start_col="start_date") -> DataFrame:
    """Every key on every trading day from its first day on.

    Days are folded into one sorted array (bounded by the calendar) and expanded per key.
    """
    arr = days.select(time).distinct().agg(F.array_sort(F.collect_list(time)).alias("_days"))
    k = keys.select(key).distinct()
    if starts is not None:
        k = k.join(starts.select(key, start_col), key, "left")
    else:
        k = k.withColumn(start_col, F.lit(None).cast("date"))
    lo = F.greatest(F.coalesce(F.col(start_col), F.lit(default_start).cast("date")), F.lit(default_start).cast("date"))
    return k.crossJoin(F.broadcast(arr)).select(key, F.explode(F.filter("_days", lambda d: d >= lo)).alias(time))


def asof_series(rows: DataFrame, series: DataFrame, value: str, default: float | None = None, time="date",
                strict: bool = False) -> DataFrame:
    """Value of a daily series at or (``strict``) before each row's date.

    The fill runs over distinct dates only; rows get it by an equi join on date.
    """
    both = series.select(time, F.col(value).alias("_v")).unionByName(
        rows.select(time).distinct().withColumn("_v", F.lit(None).cast("double"))
    ).groupBy(time).agg(F.max("_v").alias("_v"))
    w = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    filled = both.select(time, F.last("_v", ignorenulls=True).over(w).alias(value))
    out = rows.join(filled, time, "left")
    return out.fillna({value: default}) if default is not None else out


def last_value_before(rows: DataFrame, bars: DataFrame, value="close", key="ticker", time="date", strict=True,
                      out="last_value") -> DataFrame:
    """Last known value of the same key strictly before (or at) each date."""
    probe = rows.select(key, time).distinct().withColumn("_v", F.lit(None).cast("double"))
    both = bars.select(key, time, F.col(value).cast("double").alias("_v")).unionByName(probe).groupBy(key, time).agg(
        F.max("_v").alias("_v"))
    w = by_key(key, time).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    filled = both.select(key, time, F.last("_v", ignorenulls=True).over(w).alias(out))
    return rows.join(filled, [key, time], "left")


def comments_to_keys(comments: DataFrame, posts: DataFrame, all_keys: bool = False, key="ticker") -> DataFrame:
    """Comments get the key of their post; of several keys the smallest, unless ``all_keys``."""
    if all_keys:
        link = posts.select(F.col("id").cast("string").alias("post_id"), key).distinct()
    else:
        link = posts.groupBy(F.col("id").cast("string").alias("post_id")).agg(F.min(key).alias(key))
    return comments.withColumn("post_id", F.regexp_replace("link_id", "^t3_", "")).join(link, "post_id")


def texts_to_keys(texts: DataFrame, bridge: DataFrame, text_id="id", bridge_id="post_id") -> DataFrame:
    """Many-to-many bridge between texts and keys."""
    return texts.join(bridge, F.col(text_id) == F.col(bridge_id)).drop(bridge_id)


def next_event(rows: DataFrame, events: DataFrame, horizon_days=90, key="ticker", time="entry_date",
               event_time="event_date", out="next_event") -> DataFrame:
    """First event at or after each date within the horizon.

    Both sides shrink to distinct (key, day) before one ordered pass per key.
    """
    probe = rows.select(key, F.col(time).alias("_d")).distinct().withColumn("_e", F.lit(None).cast("date"))
    ev = events.select(key, F.col(event_time).alias("_d"), F.col(event_time).alias("_e")).distinct()
    both = probe.unionByName(ev).groupBy(key, "_d").agg(F.max("_e").alias("_e"))
    w = Window.partitionBy(key).orderBy("_d").rowsBetween(0, Window.unboundedFollowing)
    nxt = both.select(key, F.col("_d").alias(time), F.min("_e").over(w).alias(out))
    nxt = nxt.withColumn(out, F.when(F.col(out) <= F.date_add(time, horizon_days), F.col(out)))
    return rows.join(nxt, [key, time], "left")


def clear_of_events(rows: DataFrame, events: DataFrame, hold=5, buffer=3, key="ticker", time="entry_date",
                    event_time="event_date", exempt: Sequence[str] = ()) -> DataFrame:
    """Rows without an event in [entry, entry + hold + buffer]; unknown is allowed."""
    d = next_event(rows, events, key=key, time=time, event_time=event_time)
    blocked = (F.col("next_event") <= F.date_add(time, hold + buffer)) & ~F.col(key).isin(list(exempt))
    return d.where(~F.coalesce(blocked, F.lit(False)))


def alias_matches(df: DataFrame, text: str, aliases: dict[str, str], out="ticker") -> DataFrame:
    """One row per text and key whose alias occurs in the lower-cased text.

    The alias list is configuration; one automaton over all aliases reads each text once, however many there are.
    Of aliases that are equal in lower case the last one counts.
    """
    hits = occurring_keys(df, F.lower(F.col(text)), {a.lower(): k for a, k in aliases.items()}, "_keys")
    return hits.withColumn(out, F.explode("_keys")).drop("_keys")


def alias_coverage(texts: DataFrame, aliases: dict[str, str], text="text", text_id="id", time="date", key="ticker") -> DataFrame:
    """Posts that mention a key by any alias, first and last day; keys without hits stay."""
    spark = texts.sparkSession
    hits = alias_matches(texts, text, aliases, key).groupBy(key).agg(
        F.count_distinct(text_id).alias("n_posts"), F.min(time).alias("first_date"), F.max(time).alias("last_date"))
    reg = spark.createDataFrame([(k,) for k in sorted(set(aliases.values()))], f"{key} string")
    return reg.join(hits, key, "left").fillna(0, subset=["n_posts"])


def merge_live_feeds(feeds: Sequence[tuple[DataFrame, dict[str, float]]], key="ticker") -> DataFrame:
    """Full outer merge with neutral defaults per column."""
    out = None
    for df, _ in feeds:
        out = df if out is None else out.join(df, key, "full_outer")
    defaults = {c: d for _, spec in feeds for c, d in spec.items()}
    return out.fillna(defaults)


def forward_rows(bars: DataFrame, horizons=(1, 3, 5), value="close", key="ticker", time="date") -> DataFrame:
    """Return realised N rows after each bar, for an equi join with signals."""
    w = by_key(key, time)
    return bars.select(key, time, *[
        (ratio(F.lead(value, n).over(w), F.col(value)) - 1).alias(f"realised_{n}d") for n in horizons])


def with_forward_rows(signals: DataFrame, bars: DataFrame, horizons=(1, 3, 5), value="close", key="ticker", time="date") -> DataFrame:
    return signals.join(forward_rows(bars, horizons, value, key, time), [key, time], "left")


def trades_with_side(trades: DataFrame, signals: DataFrame, default="BULLISH", key="ticker", time="entry_date") -> DataFrame:
    """Side of the signal that opened the trade."""
    s = signals.groupBy(key, F.col("date").alias(time)).agg(F.max("signal").alias("signal"))
    return trades.join(s, [key, time], "left").fillna({"signal": default})


def with_sector(df: DataFrame, sectors: DataFrame, key="ticker", default="Unknown") -> DataFrame:
    """J15."""
    return df.join(sectors.select(key, "sector"), key, "left").fillna({"sector": default})


def pairwise_correlation(bars: DataFrame, pairs: DataFrame, lookback=60, min_overlap=20, as_of: str | None = None,
                         value="close", key="ticker", time="date") -> DataFrame:
    """Correlation of one-row returns for the requested ``(key_a, key_b)`` pairs.

    Each key keeps its last ``lookback`` returns as one short map, so pairs meet on
    keys and nothing but the asked-for pairs is formed.
    """
    src = bars.where(F.col(time) <= F.lit(as_of).cast("date")) if as_of else bars
    w = by_key(key, time)
    r = src.select(
        key, time, (ratio(F.col(value), F.lag(value, 1).over(w)) - 1).alias("_r"),
        F.row_number().over(Window.partitionBy(key).orderBy(F.col(time).desc())).alias("_i"),
    ).where((F.col("_i") <= lookback) & F.col("_r").isNotNull())
    vec = r.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(time, "_r"))).alias("_v"))
    j = pairs.join(vec.select(F.col(key).alias("key_a"), F.col("_v").alias("_a")), "key_a").join(
        vec.select(F.col(key).alias("key_b"), F.col("_v").alias("_b")), "key_b")
    rows = j.select("key_a", "key_b", "_b", F.explode("_a").alias("_d", "_ra")).withColumn(
        "_rb", F.try_element_at("_b", F.col("_d"))).where("_rb IS NOT NULL")
    return rows.groupBy("key_a", "key_b").agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("corr")).where(
        F.col("n") >= min_overlap)


def correlated_pairs(bars: DataFrame, limit=0.7, lookback=60, min_overlap=20, as_of: str | None = None, value="close",
                     key="ticker", time="date", tiles: int | None = None) -> DataFrame:
    """All pairs of keys ``(key_a < key_b, n, corr)`` whose returns correlate by at least ``limit`` in size.

    Keys are dealt by hash into tiles. A tile is sent once to each pair of tiles it belongs to, where six matrix
    products of values and day masks give counts and sums over the days both keys have, so only pairs at or above
    the limit become rows. ``tiles`` defaults to one per 256 keys. A correlation that is undefined (a constant side)
    is not reported.
    """
    src = bars.where(F.col(time) <= F.lit(as_of).cast("date")) if as_of else bars
    w = by_key(key, time)
    r = src.select(
        F.col(key).alias("key"), F.col(time).alias("day"), (ratio(F.col(value), F.lag(value, 1).over(w)) - 1).alias("r"),
        F.row_number().over(Window.partitionBy(key).orderBy(F.col(time).desc())).alias("_i"),
    ).where((F.col("_i") <= lookback) & F.col("r").isNotNull())
    if tiles is None:
        tiles = max(1, -(-src.agg(F.approx_count_distinct(key)).first()[0] // 256))
    dealt = r.withColumn("tile", F.pmod(F.xxhash64("key"), F.lit(tiles)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other")
    sent = dealt.select("key", "day", "r", "tile", other).withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="key", columns="day", values="r")
        tile = pdf.groupby("key")["tile"].first().reindex(wide.index).to_numpy()
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        mask = wide.notna().to_numpy(float)
        x = wide.sub(wide.mean(axis=1), axis=0).fillna(0.0).to_numpy()  # centred, so sums of squares lose no digits
        a, b = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
        n = mask[a] @ mask[b].T
        sx, sy = x[a] @ mask[b].T, mask[a] @ x[b].T
        sxx, syy = x[a] ** 2 @ mask[b].T, mask[a] @ (x[b] ** 2).T
        with np.errstate(divide="ignore", invalid="ignore"):
            vx, vy = sxx - sx * sx / n, syy - sy * sy / n
            corr = (x[a] @ x[b].T - sx * sy / n) / np.sqrt(vx * vy)
        # what rounding leaves of a constant side is no variance
        given = (n >= min_overlap) & (vx > 1e-12 * sxx) & (vy > 1e-12 * syy) & (np.abs(corr) >= limit)
        if lo == hi:
            given &= a[:, None] < b[None, :]
        i, j = np.nonzero(given)
        left, right = wide.index.to_numpy()[a[i]], wide.index.to_numpy()[b[j]]
        swap = left > right
        return pd.DataFrame({"key_a": np.where(swap, right, left), "key_b": np.where(swap, left, right), "n": n[i, j].astype("int64"), "corr": corr[i, j]})

    kind = bars.schema[key].dataType.simpleString()
    return sent.select("key", "day", "r", "tile", "lo", "hi").groupBy("lo", "hi").applyInPandas(run, f"key_a {kind}, key_b {kind}, n bigint, corr double")


def correlation_allows(candidates: DataFrame, held: DataFrame, corr: DataFrame, max_corr=0.7,
                       cluster: Sequence[str] = (), max_cluster=2, key="ticker") -> DataFrame:
    """Candidates that neither overfill a named cluster nor correlate with a held key."""
    both = corr.select(F.col("key_a").alias(key), F.col("key_b").alias("other"), "corr").unionByName(
        corr.select(F.col("key_b").alias(key), F.col("key_a").alias("other"), "corr"))
    h = held.select(F.col(key).alias("other")).distinct()
    blocked = both.where(F.abs("corr") >= max_corr).join(h, "other", "left_semi").select(key).distinct()
    n_cluster = h.agg(F.count_if(F.col("other").isin(list(cluster))).alias("_nc"))
    ok = candidates.crossJoin(F.broadcast(n_cluster)).where(
        ~(F.col(key).isin(list(cluster)) & (F.col("_nc") >= max_cluster))).drop("_nc")
    return ok.join(blocked, key, "left_anti")


def in_folds(panel: DataFrame, folds: DataFrame, start="test_start", end="test_end", time="date", inclusive=True) -> DataFrame:
    """Panel rows of each fold's period.

    Fold periods become (fold, day) rows, bounded by the calendar, so the range join
    is an equi join on date.
    """
    last = F.col(end) if inclusive else F.date_sub(end, 1)
    days = folds.where(F.col(start) <= last).withColumn(time, F.explode(F.sequence(F.col(start), last)))
    return panel.join(days, time)


def prefer_right(left: DataFrame, right: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join where the right value of a shared column wins if present."""
    r = right.select(*on, *[F.col(c).alias(f"_r_{c}") for c in columns])
    return left.join(r, list(on), "left").withColumns(
        {c: F.coalesce(F.col(f"_r_{c}"), F.col(c)) for c in columns}).drop(*[f"_r_{c}" for c in columns])


def repair_predictions(log: DataFrame, scored: DataFrame, columns: Sequence[str], keys=("ticker", "date")) -> DataFrame:
    """Missing predictions of logged records from a re-scored panel; present ones stay."""
    s = scored.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in columns])
    j = log.join(s, list(keys), "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"_s_{c}")) for c in columns}).drop(*[f"_s_{c}" for c in columns])


def not_repairable(log: DataFrame, scored: DataFrame, keys=("ticker", "date")) -> DataFrame:
    return log.join(scored.select(*keys).distinct(), list(keys), "left_anti")
