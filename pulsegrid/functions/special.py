"""Distribution tails for report rows (a handful of values), as Arrow scalar functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _betacf(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def binomial_upper(k: int, n: int, p: float = 0.5) -> float:
    """P(X >= k)."""
    return 1.0 if k <= 0 else incomplete_beta(k, n - k + 1, p)


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided test against one half (the distribution is symmetric)."""
    return min(1.0, 2.0 * binomial_upper(max(k, n - k), n)) if 2 * k != n else 1.0


def _skip_null(fn):
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([
            None if any(v is None or v != v for v in row) else fn(*row) for row in zip(*series)
        ], dtype="float64")
    return run


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return _skip_null(lambda v: 0.5 * math.erfc(-v / math.sqrt(2.0)))(z)


@F.pandas_udf(T.DoubleType())
def spearman_p_value(ic: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a rank correlation from the t approximation."""
    def one(r, m):
        if m < 3:
            return float("nan")
        return 0.0 if abs(r) >= 1.0 else t_two_sided(r * math.sqrt((m - 2) / (1.0 - r * r)), m - 2)
    return _skip_null(one)(ic, n)


@F.pandas_udf(T.DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _skip_null(lambda a, b, c: f_upper(max(a, 0.0), b, c))(f, d1, d2)


@F.pandas_udf(T.DoubleType())
def binomial_p_two_sided(k: pd.Series, n: pd.Series) -> pd.Series:
    return _skip_null(lambda a, b: binomial_two_sided(int(a), int(b)))(k, n)


@F.pandas_udf(T.DoubleType())
def binomial_p_greater(k: pd.Series, n: pd.Series) -> pd.Series:
    return _skip_null(lambda a, b: binomial_upper(int(a), int(b)))(k, n)
