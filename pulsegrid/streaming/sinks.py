"""Idempotent upserts per micro-batch, and a helper that drains a stream to a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.session import scratch_path
from pulsegrid.sources.writers import upsert_panel


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("ticker", "date"), mode="update") -> StreamingQuery:
    """Every micro-batch replaces the rows of its keys; a replayed batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        upsert_panel(batch, path, keys)

    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(write).start())


def drain(stream: DataFrame, mode="append") -> DataFrame:
    """Run a stream over everything available now and return what it wrote."""
    spark = stream.sparkSession
    out, cp = scratch_path(spark, "stream"), scratch_path(spark, "stream-checkpoint")
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", cp)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
