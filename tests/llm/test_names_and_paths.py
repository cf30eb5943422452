"""Columns that clash with helper names, and shared folders without a scheme."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import common, copies, decontaminate

TEXTS = [(1, "one two three four five six"), (2, "one two three four five six"), (3, "other words are in this one"), (3, "and an unlike text under the same id"), (4, None), (None, "one two three four five six"), (4, "bench mark words stand here so")]


NAMES = ["key", "mixed_id", "drop_key", "again_id", "row", "__key", "__mixed", "__drop", "__again", "__row", "n", "comp", "component_id", "h", "severity"]


def test_helper_names_are_free(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({name: F.lit("kept") for name in NAMES}).withColumn("_key", F.lit(None).cast("int"))
    kept = copies.one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, TEXTS[0][1]), (3, TEXTS[2][1]), (3, TEXTS[3][1]), (4, ""), (4, TEXTS[6][1]), (0, TEXTS[5][1])])
    bench = spark.createDataFrame([(0, TEXTS[6][1])], "item_id long, text string")
    clean = decontaminate.without_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(TEXTS) - 1 and {r[name] for r in clean.collect() for name in NAMES} == {"kept"}
    assert corpus_pipeline.redact_personal_data(spark, docs, "").columns == docs.columns


@pytest.mark.parametrize("default, folder, want", [
    ("file:///", "/shared/x", "file:///shared/x"), ("hdfs://names:8020", "/shared/x", "hdfs://names:8020/shared/x"), ("hdfs://names:8020/", "s3a://bucket/x", "s3a://bucket/x"),
    ("hdfs://names:8020", "file:/shared/x", "file:///shared/x"), ("hdfs://names:8020", "file:///shared/x", "file:///shared/x"),
])
def test_shared_files_lie_where_tables_lie(spark, monkeypatch, default, folder, want):
    monkeypatch.setattr(common, "scratch_path", lambda s, name: f"{folder}/{name}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", default)
    try:
        assert common.shared_uri(spark, "warc") == want + "/warc"
    finally:
        conf.set("fs.defaultFS", before)
