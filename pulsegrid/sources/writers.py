"""Panel, log and upsert sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pulsegrid.operators.setops import insert_new, keep_last
from pulsegrid.session import scratch_path


def write_panel(df: DataFrame, path: str, time="date", partition="year") -> None:
    """Overwrite the panel, partitioned by year so later date filters prune files.

    The rebalance hint lets Spark split large years and merge small ones into files of
    its advisory size.
    """
    out = df if partition in df.columns else df.withColumn(partition, F.year(time))
    out.hint("rebalance", F.col(partition)).write.partitionBy(partition).mode("overwrite").parquet(path)


def _stored(new: DataFrame, path: str) -> DataFrame | None:
    """The stored panel, or None where there is no such path; any other fault in reading it is raised."""
    try:
        return new.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def upsert_panel(new: DataFrame, path: str, keys: Sequence[str] = ("ticker", "date"), time="date", partition="year") -> None:
    """Keep the last row per key; only the year partitions touched by ``new`` are rewritten.

    The merged rows are staged first: Spark cannot overwrite files it is reading.
    """
    spark = new.sparkSession
    new = new if partition in new.columns else new.withColumn(partition, F.year(time))
    stored = _stored(new, path)
    if stored is None:
        write_panel(keep_last([new], keys), path, time, partition)
        return
    touched = new.select(partition).distinct()
    merged = keep_last([stored.join(F.broadcast(touched), partition, "left_semi"), new.select(*stored.columns)], keys)
    stage = scratch_path(spark, "upsert")
    merged.write.parquet(stage)
    (spark.read.parquet(stage).hint("rebalance", F.col(partition)).write.partitionBy(partition).mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def insert_panel(new: DataFrame, path: str, keys: Sequence[str] = ("ticker", "date"), time="date", partition="year") -> None:
    """Add rows whose key is not stored, one per key; stored rows never change, so this is a pure append."""
    new = new if partition in new.columns else new.withColumn(partition, F.year(time))
    new = keep_last([new], keys)
    stored = _stored(new, path)
    if stored is None:
        write_panel(new, path, time, partition)
        return
    fresh = new.join(stored.select(*keys).distinct(), list(keys), "left_anti")
    fresh.select(*stored.columns).write.partitionBy(partition).mode("append").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


__all__ = ["append_log", "insert_new", "insert_panel", "upsert_panel", "write_panel"]
