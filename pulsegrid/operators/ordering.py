"""Global order without a single-task window.

Ranks, running sums, running extremes and exact quantiles over *all* rows of a
table (or of a group that may hold a third of all rows) are computed in two
levels: rows go to range buckets, each bucket is scanned on its own, and only
one summary row per bucket is combined in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import shuffle_width

BUCKET = "_bucket"


def _width(df: DataFrame, n_buckets: int | None) -> int:
    return n_buckets or shuffle_width(df.sparkSession)


def _per_group(df: DataFrame, group: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)


def attach(df: DataFrame, small: DataFrame, group: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a per-group summary; without a group the summary is one row by construction."""
    if group:
        return df.join(small, list(group), how)
    return df.crossJoin(F.broadcast(small))


def range_bucket(
    df: DataFrame, by: Column, group: Sequence[str] = (), n_buckets: int | None = None, also: str | None = None
) -> DataFrame:
    """Add ``_bucket``, non-decreasing in ``by`` within a group, of roughly equal sizes.

    Edges come from a mergeable quantile sketch, so they are one short array per
    group; which edges are picked affects balance only, never a result.
    """
    n = _width(df, n_buckets)
    probs = F.array(*[F.lit(i / n) for i in range(1, n)])
    keyed = df.withColumn("_by", by.cast("double"))
    # ``also`` keeps a column of ``df`` alive in this branch, so both branches read one exchange
    seen = F.when(F.col(also).isNotNull(), F.col("_by")) if also else F.col("_by")
    edges = _per_group(keyed, group, F.percentile_approx(seen, probs, F.lit(max(1000, 20 * n))).alias("_edges"))
    edges = edges.withColumn("_edges", F.array_distinct("_edges"))
    out = attach(keyed, edges, group, "left")
    return out.withColumn(
        BUCKET, F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col("_by"))), F.lit(0))
    ).drop("_edges", "_by")


def _offsets(b: DataFrame, group: Sequence[str], aggs: dict[str, Column], scan) -> DataFrame:
    """One row per (group, bucket) with values carried in from earlier buckets."""
    w = Window.partitionBy(*group).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    totals = b.groupBy(*group, BUCKET).agg(*[c.alias(n) for n, c in aggs.items()])
    return totals.select(*group, BUCKET, *[scan[n](F.col(n)).over(w).alias(n) for n in aggs])


def average_rank(
    df: DataFrame,
    value: str,
    group: Sequence[str] = (),
    *,
    weight: str | None = None,
    n_buckets: int | None = None,
) -> DataFrame:
    """``(group, value, n_ties, rank_first, rank_avg)`` for each distinct value.

    Equal values are counted before the shuffle, so a value shared by a third of
    the rows is a single row here.
    """
    group = list(group)
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.groupBy(*group, value).agg(n.alias("n_ties"))
    b = range_bucket(counts, F.col(value), group, n_buckets, also="n_ties")
    off = _offsets(b, group, {"_off": F.sum("n_ties")}, {"_off": F.sum})
    w = Window.partitionBy(*group, BUCKET).orderBy(value)
    return (
        b.withColumn("_cum", F.sum("n_ties").over(w))
        .join(off, [*group, BUCKET])
        .withColumn("_last", F.coalesce(F.col("_off"), F.lit(0)) + F.col("_cum"))
        .select(
            *group,
            value,
            "n_ties",
            (F.col("_last") - F.col("n_ties") + 1).alias("rank_first"),
            (F.col("_last") - (F.col("n_ties") - 1) / 2.0).alias("rank_avg"),
        )
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    group: Sequence[str] = (),
    *,
    names: Sequence[str] | None = None,
    n_buckets: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per group, exact, from distributed ranks."""
    group = list(group)
    names = list(names or [f"p{p:g}" for p in probs])
    src = df.where(F.col(value).isNotNull())
    ranks = average_rank(src, value, group, n_buckets=n_buckets)
    total = _per_group(ranks, group, F.sum("n_ties").alias("_n"))
    spec = F.array(
        *[F.struct(F.lit(nm).alias("name"), F.lit(float(p)).alias("p")) for nm, p in zip(names, probs)]
    )
    wanted = total.withColumn("_q", F.explode(spec)).withColumn(
        "_h", F.col("_q.p") * (F.col("_n") - 1)
    )
    last = F.col("rank_first") + F.col("n_ties") - 1

    def covers(w: Column) -> Column:
        """Does this value hold one of the two order statistics around the position?"""
        lo = F.floor(w["_h"]) + 1
        return (F.col("rank_first") <= F.least(lo + 1, w["_n"])) & (last >= lo)

    hit = attach(
        ranks,
        _per_group(wanted, group, F.collect_list(F.struct("_q", "_h", "_n")).alias("_want")),
        group,
    )
    # only the few rows next to a wanted position are ever copied
    pts = hit.withColumn("_w", F.explode(F.filter("_want", covers))).select(*group, value, "_w._q", "_w._h")
    picked = pts.groupBy(*group, F.col("_q.name").alias("_name"), "_h").agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi")
    )
    est = picked.select(
        *group,
        "_name",
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_h") - F.floor("_h"))).alias("_v"),
    )
    aggs = [F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in names]
    return _per_group(est, group, *aggs)


def row_index(
    df: DataFrame,
    order: Sequence[Column | str],
    by: Column,
    group: Sequence[str] = (),
    *,
    out: str = "row_index",
    n_buckets: int | None = None,
) -> DataFrame:
    """1-based position of every row in the order given; ``by`` is the numeric form of
    the order (ties in ``by`` must be broken by later ``order`` columns only)."""
    group = list(group)
    b = range_bucket(df, by, group, n_buckets)
    off = _offsets(b, group, {"_off": F.count(F.lit(1))}, {"_off": F.sum})
    w = Window.partitionBy(*group, BUCKET).orderBy(*order)
    return (
        b.withColumn("_rn", F.row_number().over(w))
        .join(off, [*group, BUCKET])
        .withColumn(out, F.col("_rn") + F.coalesce(F.col("_off"), F.lit(0)))
        .drop("_rn", "_off", BUCKET)
    )


def running(
    df: DataFrame,
    order: Sequence[Column | str],
    by: Column,
    sums: dict[str, str] | None = None,
    maxima: dict[str, str] | None = None,
    minima: dict[str, str] | None = None,
    group: Sequence[str] = (),
    *,
    n_buckets: int | None = None,
) -> DataFrame:
    """Inclusive running sum / max / min columns ``{out: source}`` over the whole order."""
    group = list(group)
    spec = [(F.sum, sums or {}), (F.max, maxima or {}), (F.min, minima or {})]
    aggs, scans = {}, {}
    for fn, cols in spec:
        for out, src in cols.items():
            aggs[f"_o_{out}"], scans[f"_o_{out}"] = fn(src), fn
    b = range_bucket(df, by, group, n_buckets)
    off = _offsets(b, group, aggs, scans)
    w = Window.partitionBy(*group, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    res = b
    for fn, cols in spec:
        for out, src in cols.items():
            res = res.withColumn(f"_r_{out}", fn(src).over(w))
    res = res.join(off, [*group, BUCKET])
    for out in (sums or {}):
        res = res.withColumn(out, F.col(f"_r_{out}") + F.coalesce(F.col(f"_o_{out}"), F.lit(0.0)))
    for out in (maxima or {}):
        res = res.withColumn(out, F.greatest(f"_r_{out}", f"_o_{out}"))
    for out in (minima or {}):
        res = res.withColumn(out, F.least(f"_r_{out}", f"_o_{out}"))
    drop = [c for c in res.columns if c.startswith(("_r_", "_o_"))]
    return res.drop(BUCKET, *drop)
