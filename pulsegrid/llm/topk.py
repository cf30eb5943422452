"""Exact top-k search by inner product: tiles of queries and shards, merged as a tree.

Rows are dealt into shards by a hash of their id, queries into blocks. Each (block, shard) tile is one
matrix product in one task, cut into strips so that the product never holds more than ``STRIP`` rows of
the shard; every strip keeps the k best of each query (all ties of the k-th score are settled by id).
The lists of the tiles are merged in groups of ``FAN`` tiles, level by level, so no group ever holds
more than ``FAN * k`` entries per query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_ROWS = 32_768
BLOCK_ROWS = 4_096
STRIP = 2_048
FAN = 16
TILE_SCHEMA = "query_id long, tile long, vec_id long, score long"


def usable(embedding: Column) -> Column:
    """Vectors without null, NaN or infinite components."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False))


def fixed_point(rows: pd.Series, scale: float) -> np.ndarray:
    """floor(scale * x) as int64, one row per vector."""
    return np.floor(scale * np.stack(rows.to_list()).astype(np.float64)).astype(np.int64)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products; doubles carry them while every partial sum stays below 2^53."""
    top = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    if top < 2.0**53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


def tile_lists(k: int, scale: float):
    """Function for one tile: partial top lists of its queries over its shard."""

    def run(key, shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        tile = key[1]
        if shard.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "tile": [], "vec_id": [], "score": []}).astype("int64")
        left, right = fixed_point(queries["embedding"], scale), fixed_point(shard["embedding"], scale)
        query_ids, shard_ids = queries["query_id"].to_numpy(), shard["vec_id"].to_numpy()
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(left)
        for lo in range(0, len(right), STRIP):
            ids = shard_ids[lo : lo + STRIP]
            scores = products(left, right[lo : lo + STRIP])
            for i, row in enumerate(scores):  # a query does not meet its own row
                keep = ids != query_ids[i]
                row, own = row[keep], ids[keep]
                if len(row) > k:
                    at = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                    row, own = row[at], own[at]
                row, own = np.concatenate([found[i][0], row]), np.concatenate([found[i][1], own])
                order = np.lexsort((own, -row))[:k]
                found[i] = row[order], own[order]
        return pd.DataFrame({
            "query_id": np.repeat(query_ids, [len(s) for s, _ in found]),
            "tile": tile,
            "vec_id": np.concatenate([o for _, o in found]),
            "score": np.concatenate([s for s, _ in found]),
        })

    return run


def merge(lists: DataFrame, tiles: int, k: int) -> DataFrame:
    """Merge per-tile lists, ``FAN`` tiles at a time, to one list per query."""
    while True:
        entry = F.struct((-F.col("score")).alias("down"), "vec_id", "score")
        tiles = math.ceil(tiles / FAN)
        lists = (
            lists.groupBy("query_id", F.floor(F.col("tile") / FAN).cast("long").alias("tile"))
            .agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("best"))
            .select("query_id", "tile", F.posexplode("best").alias("at", "e"))
            .select("query_id", "tile", "at", "e.vec_id", "e.score")
        )
        if tiles <= 1:
            return lists.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "vec_id", "score")


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """The k rows of ``vectors`` with the highest integer inner product, for each row of ``queries``.

    Both frames have ``vec_id`` and ``embedding``; components count as floor(scale * x). Returns
    ``query_id, rank, vec_id, score``: rank from 1, ties to the smaller vec_id, fewer than k rows if there are fewer.

    Defined cases: vectors or ids that are null, and vectors with null, NaN or infinite components, take no
    part. Only vectors of equal length are compared (two empty ones score 0). A query never meets rows of its
    own vec_id. A vec_id with several rows is one query (its smallest vector), but each row is a candidate.
    Scores must fit 64 bits. Empty tables give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    clean = [d.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))) for d in (vectors, queries)]
    rows, asked = clean[0], clean[1].groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    shards = max(1, math.ceil(rows.count() / SHARD_ROWS))
    blocks = max(1, math.ceil(asked.count() / BLOCK_ROWS))
    shards = max(shards, min(spark.sparkContext.defaultParallelism, 8))
    tiles = (
        rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards).cast("long")))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select("block", "shard", F.size("embedding").alias("dim"), "vec_id", "embedding")
    )
    blocked = (
        asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        .select("block", "shard", F.size("embedding").alias("dim"), F.col("vec_id").alias("query_id"), "embedding")
    )
    key = ["block", "shard", "dim"]
    lists = tiles.groupBy(*key).cogroup(blocked.groupBy(*key)).applyInPandas(tile_lists(k, scale), TILE_SCHEMA)
    return merge(lists, shards, k)
