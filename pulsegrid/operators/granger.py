"""Lag-1 Granger F tests per group from covariance sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.special import f_p_value
from pulsegrid.operators.equity import rolling_rows
from pulsegrid.operators.ordering import row_index
from pulsegrid.operators.rollups import unpivot_doubles


def lag_sums(df: DataFrame, features: Sequence[str], target: str, group: str, order: Sequence[str], by: Column,
             n_buckets: int | None = None) -> DataFrame:
    """Covariances of (y, y lagged, x lagged) per feature and group, over the ordered rows."""
    long = unpivot_doubles(df.withColumn("_by", by), features, [group, *order, "_by", target]).where(
        F.col(target).isNotNull() & F.col("value").isNotNull())
    idx = row_index(long, order, F.col("_by"), ["feature", group], n_buckets=n_buckets)
    prev = rolling_rows(idx, "row_index", 2, {"_y1": F.first(target), "_x1": F.first("value")}, group=["feature", group])
    y, y1, x1 = F.col(target), F.col("_y1"), F.col("_x1")
    lagged = prev.withColumns({c: F.when(F.col("row_index") > 1, F.col(c)) for c in ("_y1", "_x1")}).where("_y1 IS NOT NULL")
    return lagged.groupBy("feature", group).agg(
        F.count(F.lit(1)).alias("n_obs"), F.var_samp(y).alias("vy"), F.var_samp(y1).alias("v1"), F.var_samp(x1).alias("v2"),
        F.covar_samp(y, y1).alias("c1"), F.covar_samp(y, x1).alias("c2"), F.covar_samp(y1, x1).alias("c12"))


def granger_lag1(df: DataFrame, features: Sequence[str], target: str, group: str, order: Sequence[str], by: Column,
                 min_n=30, n_buckets: int | None = None, with_p: bool = True) -> DataFrame:
    """Does the lagged feature add to the lagged target? F test with (1, n - 3) degrees."""
    s = lag_sums(df, features, target, group, order, by, n_buckets)
    det = F.col("v1") * F.col("v2") - F.col("c12") * F.col("c12")
    b1 = (F.col("c1") * F.col("v2") - F.col("c2") * F.col("c12")) / F.nullif(det, F.lit(0.0))
    b2 = (F.col("c2") * F.col("v1") - F.col("c1") * F.col("c12")) / F.nullif(det, F.lit(0.0))
    full = F.col("vy") - b1 * F.col("c1") - b2 * F.col("c2")
    short = F.col("vy") - F.col("c1") * F.col("c1") / F.nullif(F.col("v1"), F.lit(0.0))
    dof = F.col("n_obs") - 3
    f = (short - full) / F.nullif(full / dof, F.lit(0.0))
    out = s.select("feature", group, (F.col("n_obs") + 1).alias("n"), dof.alias("dof"),
                   F.when(F.col("n_obs") + 1 >= min_n, f).alias("f_stat"))
    if not with_p:
        return out
    out = out.withColumn("p_value", f_p_value("f_stat", F.lit(1.0), F.col("dof").cast("double")))
    return out.withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def significant_groups(tests: DataFrame, families: dict[str, Sequence[str]], group: str) -> DataFrame:
    """Number of groups (years) where any feature of a family is significant."""
    m = F.create_map(*[F.lit(x) for fam, fs in families.items() for f in fs for x in (f, fam)])
    t = tests.withColumn("family", F.try_element_at(m, F.col("feature"))).where("family IS NOT NULL")
    return t.groupBy("family").agg(
        F.count_distinct(group).alias("n_groups"),
        F.count_distinct(F.when(F.col("significant"), F.col(group))).alias("n_significant"))
