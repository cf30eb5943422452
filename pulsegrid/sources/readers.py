"""File sources with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.exprs import nan_to_null
from pulsegrid.schema import ARTICLE_FEED_SCHEMA, FOLD_DOCUMENT_SCHEMA, REGISTRY_ENTRY


def parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Explicit columns, so the scan reads nothing else; NaN becomes null."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return nan_to_null(df.select(*columns) if columns else df)


def json_lines(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """One JSON object per line; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def fold_documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """S3: whole-document JSON with a ``folds`` array, one row per fold."""
    doc = spark.read.schema(FOLD_DOCUMENT_SCHEMA).option("multiLine", True).json(path)
    f = doc.select("purge_days", "embargo_days", F.explode("folds").alias("f"))
    return f.select("purge_days", "embargo_days", "f.fold", "f.train_start", "f.train_end", "f.test_start", "f.test_end",
                    "f.regime", "f.is_sharpe", "f.oos.total_return_pct", "f.oos.sharpe", "f.oos.win_rate", "f.oos.n_trades")


def article_feed(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = ARTICLE_FEED_SCHEMA) -> DataFrame:
    """Headerless tab-separated text without quoting, latin-1; short or long rows are dropped."""
    return (
        spark.read.schema(schema).option("sep", "\t").option("quote", "").option("encoding", "ISO-8859-1")
        .option("mode", "DROPMALFORMED").csv(path)
    )


def symbol_list(spark: SparkSession, path: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Symbols of a text file; blanks, comments and repeats are left out.

    ``position`` follows partitions, which is file order only while a file is one partition; ``lines.ordered_symbols``
    gives file and byte offset.
    """
    raw = spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("_pos"))
    return symbols_from_lines(raw, exclude=exclude)


def symbols_from_lines(lines: DataFrame, value="value", position="_pos", exclude: Sequence[str] = ()) -> DataFrame:
    s = F.upper(F.trim(F.col(value)))
    d = lines.where((F.trim(value) != "") & ~F.trim(F.col(value)).startswith("#")).select(s.alias("ticker"), position)
    g = d.groupBy("ticker").agg(F.min(position).alias("position"))
    return g.where(~F.col("ticker").isin(list(exclude))) if exclude else g


def registry(spark: SparkSession, path: str, wrapped: str | None = "tickers") -> DataFrame:
    """Map-of-structs document to one row per key."""
    text = spark.read.option("wholetext", True).text(path)
    return registry_rows(text.select(F.get_json_object("value", f"$.{wrapped}").alias("value")) if wrapped else text)


def registry_rows(text: DataFrame, value="value") -> DataFrame:
    m = text.select(F.from_json(value, REGISTRY_ENTRY).alias("_m"))
    return m.select(F.explode("_m").alias("ticker", "_e")).select("ticker", "_e.*")


def active_keys(reg: DataFrame, tier: str | None = None) -> DataFrame:
    d = reg.where(F.coalesce(F.col("active"), F.lit(True)))
    return d.where(F.col("tier") == tier) if tier else d


def sector_map(reg: DataFrame) -> DataFrame:
    return reg.select("ticker", F.coalesce("sector", F.lit("Unknown")).alias("sector"))


def mention_history(spark: SparkSession, path: str) -> DataFrame:
    """Map of key to map of date to count, as rows (ticker, date, count)."""
    schema = T.MapType(T.StringType(), T.MapType(T.StringType(), T.IntegerType()))
    text = spark.read.option("wholetext", True).text(path).select(F.from_json("value", schema).alias("_m"))
    rows = text.select(F.explode("_m").alias("ticker", "_d")).select("ticker", F.explode("_d").alias("date", "count"))
    return rows.withColumn("date", F.to_date("date"))


def wide_to_long_bars(wide: DataFrame, time="date", fields=("Open", "High", "Low", "Close", "Volume")) -> DataFrame:
    """Columns ``Close_KEY`` … to rows (ticker, date, open, high, low, close, volume)."""
    cols = [c for c in wide.columns if "_" in c and c.split("_", 1)[0] in fields]
    present = [f for f in fields if any(c.startswith(f"{f}_") for c in cols)]
    long = wide.select(time, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([time], cols, "_c", "_v")
    part = F.split("_c", "_", 2)
    long = long.select(time, part[0].alias("_f"), part[1].alias("ticker"), "_v").where("_v IS NOT NULL")
    return long.groupBy("ticker", time).agg(
        *[F.max(F.when(F.col("_f") == f, F.col("_v"))).alias(f.lower()) for f in present])


def feed_or_fallback(primary: DataFrame, secondary: DataFrame, usable: Column) -> DataFrame:
    """The primary feed if any row is usable, else the secondary one."""
    ok = primary.agg(F.coalesce(F.max(usable), F.lit(False)).alias("_ok"))  # one row
    a = primary.withColumn("feed", F.lit("primary")).crossJoin(F.broadcast(ok)).where("_ok")
    b = secondary.withColumn("feed", F.lit("secondary")).crossJoin(F.broadcast(ok)).where("NOT _ok")
    return a.unionByName(b, allowMissingColumns=True).drop("_ok")
