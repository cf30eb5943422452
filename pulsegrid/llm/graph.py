"""Connected components of a link table, and joins that stand hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import stage

#: A key counts as hot above this many rows, and above this share of all rows; so there are at most ``1 / HOT_SHARE`` hot keys.
HOT_ROWS, HOT_SHARE = 256, 1e-4


def hot_join(rows: DataFrame, looked_up: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``looked_up`` (staged; unique in ``key``, with ``n``, how many rows hold the key; ``n`` is dropped).

    Rows of hot keys stay where they are and get their value by broadcast: of keys with more than ``total * HOT_SHARE``
    rows there are at most ``1 / HOT_SHARE``. All other keys are joined by a shuffle.
    """
    limit = max(HOT_ROWS, int(total * HOT_SHARE))
    if looked_up.where(F.col("n") > limit).isEmpty():
        return rows.join(looked_up.drop("n"), key)
    hot = F.broadcast(looked_up.where(F.col("n") > limit).drop("n"))
    keys = F.broadcast(looked_up.where(F.col("n") > limit).select(key))
    cold = rows.join(keys, key, "left_anti").join(looked_up.where(F.col("n") <= limit).drop("n"), key)
    return rows.join(hot, key).unionByName(cold)


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """``node, component`` of every node in ``links`` (``a, b``; at most ``most`` if given); a component is named by its smallest node.

    Each round points every node and its neighbours to the smallest node among them: first larger neighbours,
    then smaller ones, until the links are stars. Rounds are few (logarithmic in the length of paths). Smallest
    neighbours are pre-aggregated before they are shuffled, and the links of a node with very many neighbours
    never meet in one task (``hot_join``).
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", most)
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = mark(edges)
    while now[0]:
        before, bound = now, 2 * now[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "low", bound)
        large = hot_join(both.where("v > u"), low, "u", bound).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "large", bound)
        least = stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least", bound)
        pointed = hot_join(large, least, "u", bound).select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(pointed.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links", bound)
        now = mark(edges)
        if now == before:
            break
    tops = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
