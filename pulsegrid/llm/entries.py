"""Queries of the subpackage over the given tables, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from pulsegrid.llm import align, decontaminate, licences, ngram_join, pieces, pii, quality, repeats, simhash, spelling, topk, toxicity, warc
from pulsegrid.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query(
    "op1_exact_top_k",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
    ) WHERE rank <= 10
    """,
)
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best rows by integer inner product for every row whose vec_id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.exact_top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10, scale=1024.0)


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality.quality(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


@query("op3_personal_data")
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base counts and digest, and all spans."""
    found = pii.personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and whether they decode to its text."""
    return pieces.encode_and_check(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op10_licences", licences.check_sql())
def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named by every document."""
    return licences.licence_scan(table(spark, sf_dir, "documents", "doc_id", "text"))


@query(
    "op8_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest FROM p),
    k AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS kept FROM d)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
        CASE WHEN n >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= 1000 AND page_id <> kept THEN kept END AS refers_to
    FROM k
    """,
)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back through the capture index."""
    read = warc.archive_and_read_back(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_ngram_join")
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 80 % shingle similarity."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), percent=80)


@query("op5_decontamination", decontaminate.CHECK_SQL)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in every document."""
    return decontaminate.contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus pipeline over the documents table."""
    return corpus_pipeline.run(spark, sf_dir)


@query("op7_repeats")
def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeated strings of 400 bytes cover, and the text that is left."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


@query("op11_simhash")
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and its component under links of at most 4 differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), threshold=4)


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the two public tokenizers in every document, with corpus-wide counts of linked id pairs."""
    return align.alignment(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op12_spelling")
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus with its more frequent form one edit away, and where such forms end."""
    return spelling.variants(table(spark, sf_dir, "documents", "doc_id", "text"))
