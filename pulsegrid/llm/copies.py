"""One document of each group of near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import ngram_join
from pulsegrid.llm.common import stage, unused


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of each near-duplicate component the row with the smallest doc_id; of rows with equal id and text the first as JSON.

    Rows without any word are in no group and all stay, also those that share their doc_id with others. Rows with
    different texts under one doc_id are documents of their own. Rows without a doc_id all stay, any number of exact copies
    of them too. All columns stay, whatever their names; an empty table stays empty.
    """
    key, mixed_id, drop_key, again_id, row = (unused(docs, n) for n in ("key", "mixed_id", "drop_key", "again_id", "row"))
    worded = F.coalesce(F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")), F.lit(0)) > 0
    named = worded & F.col("doc_id").isNotNull()
    per = docs.where(named).select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.count("*").alias("n"), (F.min("h") < F.max("h")).alias("mixed"))
    again = stage(per.where("n > 1").select("doc_id", "mixed"), "repeated")
    mixed = again.where("mixed").select(F.col("doc_id").alias(mixed_id))
    several = not mixed.isEmpty()
    keyed = docs.withColumn(key, F.col("doc_id"))
    if several:  # a key for each text of such an id
        own = F.when(named & F.col(mixed_id).isNotNull(), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
        keyed = docs.join(mixed, F.col("doc_id") == F.col(mixed_id), "left").withColumn(key, own).drop(mixed_id)
    found = ngram_join.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text")).where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    if several:
        ids = keyed.where(named).select(F.col(key).alias("member"), F.col("doc_id").alias("id")).distinct()
        members = stage(found.select(F.col("doc_id").alias("member"), "component_id").distinct().join(ids, "member"), "members")
        first = members.groupBy("component_id").agg(F.min(F.struct("id", "member"))["member"].alias("first"))
        rest = members.join(first, "component_id").where("member <> first").select(F.col("member").alias(drop_key))
    else:
        rest = found.where("doc_id <> component_id").select(F.col("doc_id").alias(drop_key)).distinct()
    kept = keyed.join(rest, named & (F.col(key) == F.col(drop_key)), "left_anti")
    if again.isEmpty():
        return kept.drop(key)
    marked = again.select(F.col("doc_id").alias(again_id))
    one = named & (F.col("doc_id") == F.col(again_id))
    single = kept.join(marked, one, "left_anti")
    double = kept.join(marked, one, "left_semi").groupBy(key).agg(F.min_by(F.struct("*"), F.to_json(F.struct("*"))).alias(row)).select(f"{row}.*")
    return single.unionByName(double).drop(key)
