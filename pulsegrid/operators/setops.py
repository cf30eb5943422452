"""De-duplication, unions with priorities, upserts and set differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key tuple, the one with the greatest ``order`` tuple.

    Done as an aggregate, so copies are folded before the shuffle and a key with
    millions of copies costs one row per task. Rows that tie on ``order`` are settled by their other
    columns, so the choice does not depend on how rows arrive.
    """
    rest = [c for c in df.columns if c not in keys]
    closing = [F.col(f"`{c}`") for c, kind in df.dtypes if c in rest and not any(x in kind for x in ("map<", "variant"))]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *closing)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.`{c}`").alias(c) for c in rest]).select(*df.columns)


def union_ranked(sources: Sequence[DataFrame], out="_prio") -> DataFrame:
    """Union by name with the position of the source (0 first)."""
    res = None
    for i, s in enumerate(sources):
        t = s.withColumn(out, F.lit(i))
        res = t if res is None else res.unionByName(t, allowMissingColumns=True)
    return res


def keep_last(batches: Sequence[DataFrame], keys=("ticker", "date")) -> DataFrame:
    """Later batches replace earlier rows with the same key."""
    u = union_ranked(batches)
    return keep_best(u, list(keys), [F.col("_prio")]).drop("_prio")


def insert_new(old: DataFrame, new: DataFrame, keys=("ticker", "date")) -> DataFrame:
    """S10, ignore on conflict: only keys not stored yet are added."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def newest_snapshots(df: DataFrame, n: int, order="id") -> DataFrame:
    """The newest ``n`` rows (a distributed top-n)."""
    return df.orderBy(F.col(order).desc()).limit(n)


def merge_feeds_by_period(a: DataFrame, b: DataFrame, c: DataFrame, cut1: str, cut2: str,
                          keys=("ticker", "date"), time="date") -> DataFrame:
    """``a`` up to cut1; between the cuts ``b`` and, where it lacks a key, ``a``; ``c`` from cut2."""
    lo, hi = F.lit(cut1).cast("date"), F.lit(cut2).cast("date")
    t = F.col(time)
    mid = union_ranked([b.where((t > lo) & (t < hi)), a.where((t > lo) & (t < hi))])
    # the middle period holds at most one row per source and key
    mid = keep_best(mid, list(keys), [-F.col("_prio")]).drop("_prio")
    return a.where(t <= lo).unionByName(mid).unionByName(c.where(t >= hi))


def keep_highest(sources: Sequence[DataFrame], keys=("ticker", "date"), by="news_count_1d") -> DataFrame:
    """The row with the highest count; ties go to the earlier source."""
    u = union_ranked(sources)
    return keep_best(u, list(keys), [F.col(by), -F.col("_prio")]).drop("_prio")


def append_completed(base: DataFrame, live: DataFrame, target="target_return_5d", keys=("ticker", "date")) -> DataFrame:
    """U4: live rows whose target is known replace or extend the base."""
    return keep_last([base, live.where(F.col(target).isNotNull())], keys)


def missing_weekdays(dates: DataFrame, time="date") -> DataFrame:
    """Weekdays between the first and last record without a record."""
    d = dates.select(time).distinct()
    span = d.agg(F.min(time).alias("_lo"), F.max(time).alias("_hi")).select(
        F.explode(F.sequence("_lo", "_hi")).alias(time)).where(F.weekday(time) < 5)
    return span.join(d, time, "left_anti")


def shared_keys(a: DataFrame, b: DataFrame, keys=("ticker", "date")) -> DataFrame:
    """Keys present in both."""
    return a.select(*keys).intersect(b.select(*keys))


def unseen(df: DataFrame, seen: DataFrame, keys=("ticker", "date")) -> DataFrame:
    """Rows whose key was not processed before."""
    return df.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def top_per_group(df: DataFrame, group: Sequence[str], k: int, order: Sequence[Column]) -> DataFrame:
    """First ``k`` rows per group; Spark keeps only ``k`` per task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
