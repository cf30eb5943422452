"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str, default: float | None = None) -> Column:
    """``num / den``; ``default`` where the denominator is zero or either side is null."""
    n, d = col(num), col(den)
    r = F.when(d != 0, n.cast("double") / d)
    return r if default is None else F.coalesce(r, F.lit(float(default)))


def quotient(num: Column | str, den: Column | str) -> Column:
    """``num / den`` as SQL divides doubles: an infinity or NaN where the denominator is zero, null where either side is null."""
    n, d = col(num).cast("double"), col(den).cast("double")
    by_zero = F.when(F.isnan(n) | (n == 0), F.lit(float("nan"))).when(n.isNotNull(), F.signum(n) * float("inf"))
    return F.when(d == 0, by_zero).otherwise(n / F.nullif(d, F.lit(0.0)))


def clamp(c: Column | str, lo, hi) -> Column:
    """``c`` kept within [lo, hi]; null stays null (least and greatest alone would skip it)."""
    low = lo if isinstance(lo, Column) else F.lit(lo)
    high = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(col(c).isNotNull(), F.greatest(low, F.least(high, col(c))))


def flag(cond: Column) -> Column:
    """Boolean as 0.0 / 1.0, null counted as false."""
    return F.when(cond, 1.0).otherwise(0.0)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, for reports and for comparing engines."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities to null in every floating column."""
    def fix(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(f.name)
        return c

    return df.select(*[fix(f) for f in df.schema.fields])
