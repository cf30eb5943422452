"""From raw documents to token ids: toxicity, near duplicates, benchmark decontamination, personal data, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and gets the rows its predecessor kept, read back from Parquet. All
but the last return the columns of ``documents``. Stages only look at ``doc_id`` and ``text`` and pass every
other column through, whatever its name or its nulls. An empty table stays empty, null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import copies, decontaminate, pieces, pii, toxicity
from pulsegrid.llm.common import stage, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays below the limit. Repeated rows share their fate."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")  # the labelled rows to learn from
    model = toxicity.train(source, labels)
    name = unused(docs, "severity")
    return toxicity.score(docs, model, severity=name).where(F.col(name) < toxicity.REJECT_AT).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the row with the smallest doc_id. Cases as in ``copies.one_of_each_group``."""
    return copies.one_of_each_group(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data in the text replaced by its kind."""
    return pii.redact(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a check that they decode to its text."""
    return pieces.encode_and_check(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", drop_benchmark),
    ("personal_data", redact_personal_data),
    ("sentencepiece", to_tokens),
]

#: The toxicity model and the boosted redaction have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read back as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
