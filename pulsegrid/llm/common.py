"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import sys
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.session import scratch_path

#: A side of a join is broadcast only if it was counted and has at most this many rows or listed entries.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the given tables, cut to ``columns``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


#: Rows of one file of a stage table whose number of rows is known to be bounded.
ROWS_A_FILE = 100_000


def stage(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later steps do not repeat its work.

    With ``rows``, a known upper bound, small tables become few files, however many partitions they came from.
    """
    path = scratch_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_uri(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder with its scheme: one without belongs to the session's default file system, as for Spark's own tables."""
    path = scratch_path(spark, name)
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        path = (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///").rstrip("/") + path
    return re.sub("^file:/+", "file:///", path)


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(column: pa.Array) -> list[str]:
    """The strings of a column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str, bound: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``bound`` labelled documents, for fitting a model.

    The ids with the smallest hashes are taken, so the choice is the same in every run. Only ids and labels
    are ordered, and the join moves at most ``bound`` texts. Null labels and ids are left out, a document
    with several labels takes the largest.
    """
    named = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
    ids = named.groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most `bound` ids


def fit_in_one_task(rows: DataFrame, fit: Callable[[pd.DataFrame], bytes]) -> bytes:
    """Run ``fit`` over a bounded sample inside one task and bring back the model's bytes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = pd.DataFrame({"model": [fit(pdf)]})
        release()
        return made

    model = rows.groupBy(F.lit(0).alias("all")).applyInPandas(run, "model binary").collect()
    return bytes(model[0]["model"]) if model else fit(pd.DataFrame({c: [] for c in rows.columns}))


def release() -> None:
    """Give freed memory back to the system: workers wait for further tasks, and what they keep is missing elsewhere."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a task holds few decoded texts at once. At the end freed memory is given back."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    release()


def small(df: DataFrame, listed: str | None = None) -> DataFrame:
    """``df`` marked for broadcast if it was counted and is small, else as it is. Entries of the array ``listed`` count as rows."""
    size = df.agg(F.sum(F.size(listed)) if listed else F.count("*")).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_ROWS else df
