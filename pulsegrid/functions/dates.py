"""F8: date and time helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.windows import market_time_utc


def unix_to_utc(c: Column) -> Column:
    return F.timestamp_seconds(c)


def market_open_utc(day: Column) -> Column:
    return market_time_utc(day, "09:30")


def market_close_utc(day: Column) -> Column:
    return market_time_utc(day, "16:00")


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def compact_date(c: Column) -> Column:
    """``YYYYMMDD`` text to a date, null if unreadable."""
    return F.try_to_date(c, "yyyyMMdd")


def hour_of_day(epoch: Column) -> Column:
    return F.floor(F.pmod(epoch, F.lit(86400)) / 3600).cast("int")


def date_windows(bounds: DataFrame, days: int, start="start", end="end") -> DataFrame:
    """Consecutive windows of ``days`` days from start to end; the last one is cut at the end."""
    begins = F.explode(F.sequence(F.col(start), F.date_sub(end, 1), F.expr(f"INTERVAL {days} DAYS")))
    return bounds.where(F.col(start) < F.col(end)).select(end, begins.alias("window_start")).select(
        F.col("window_start").cast("date").alias("window_start"),
        F.least(F.date_add(F.col("window_start").cast("date"), days), F.col(end)).alias("window_end"))


# fixed values: market regime periods as (first day after the period, label)
REGIME_PERIODS = [
    ("2020-02-01", "bull_2019"), ("2020-06-01", "covid_crash"), ("2021-01-01", "covid_recovery"),
    ("2022-01-01", "meme_bull_2021"), ("2023-01-01", "bear_2022"), ("2024-01-01", "recovery_2023"),
]
LATEST_REGIME = "ai_bull_2024"


def regime_period(day: Column, periods=tuple(REGIME_PERIODS), latest: str = LATEST_REGIME) -> Column:
    """label of the period a date falls into."""
    e = None
    for until, label in periods:
        cond = day < F.lit(until).cast("date")
        e = F.when(cond, label) if e is None else e.when(cond, label)
    return e.otherwise(latest)
