"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.functions.exprs import round_doubles
from pulsegrid.plans.tables import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def r(expr: str, alias: str | None = None, digits: int = 6) -> str:
    """SQL for a value rounded the way ``round_doubles`` does (no negative zero)."""
    e = f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0E0"
    return f"{e} AS {alias}" if alias else e


def rs(*columns: str, digits: int = 6) -> str:
    return ", ".join(r(c, c, digits) for c in columns)


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None, digits: int = 6):
    """Register ``fn(tables) -> DataFrame``; doubles are rounded (six places by default)."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(Tables(spark, sf_dir)), digits)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn

    return register
