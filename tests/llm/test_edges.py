"""Nulls, empty and long texts, repeats, extra columns and empty tables for every operator and stage."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import decontaminate, licences, ngram_join, pieces, pii, quality, repeats, topk, toxicity, warc

SCHEMA = "doc_id long, text string, severity double, row string, key long, n int"
PASSAGE = " ".join(f"passage{i}" for i in range(40))


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


ROWS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "Hello"), (None, "no id at all"), (5, words(6000, 1)), (6, words(80, 2)), (7, words(80, 2)), (7, words(80, 2)),
    (None, words(80, 2)), (8, "mail a.b@example.org now +1 (017) 555-7713 or 10.0.0.1"), (9, PASSAGE + " tail"), (10, "Released under the MIT License."), (11, "é😀ß " * 30),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0.5, "r", None, 3) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 0, 1), (None, 1, 1), (8, None, None), (6, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(0, PASSAGE), (1, None), (2, ""), (0, PASSAGE), (3, "Hello")], "item_id long, text string")


OPERATORS = {
    "quality": lambda d, x, b: quality.quality(d, x),
    "toxicity": lambda d, x, b: toxicity.toxicity(d, x),
    "pii": lambda d, x, b: pii.personal_data(d),
    "join": lambda d, x, b: ngram_join.near_duplicates(d),
    "decontamination": lambda d, x, b: decontaminate.contamination(d, b),
    "tokens": lambda d, x, b: pieces.encode_and_check(d),
    "repeats": lambda d, x, b: repeats.remove_repeats(d),
    "licences": lambda d, x, b: licences.licence_scan(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(docs, none, labels, bench, name):
    out = OPERATORS[name](docs, labels, bench).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in ROWS)
    assert OPERATORS[name](none, labels.limit(0), bench.limit(0)).count() == 0


def test_defined_results(docs, labels, bench):
    q = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert all(0 <= r.score <= 1 for r in q.values()) and q[1].score == q[2].score == q[3].score
    j = {}
    for r in ngram_join.near_duplicates(docs).collect():
        j.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert j[1] == {(0, 1)} and j[2] == {(0, 2)} and j[4] == {(1, 4)} and j[6] == j[7] == {(76, 6)} and (76, 6) in j[None]
    c = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert (c[9].contaminated, c[9].item_ids, c[4].item_ids) == (True, "0", "3") and not c[5].contaminated and not c[1].contaminated
    t = {r.doc_id: r for r in pieces.encode_and_check(docs).collect()}
    assert all(r.round_trip for r in t.values()) and t[1].n_tokens == t[2].n_tokens == 0
    s = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert s[1].n_bytes == 0 and s[6].n_removed == s[6].n_bytes and s[5].n_removed == 0
    assert {r.doc_id: r.licences for r in licences.licence_scan(docs).collect()}[10] == "MIT"


def test_stages_keep_columns(spark, docs, none, labels, bench, tmp_path):
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    counts = []
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, folder)
        counts.append(out.count())
        if name != "sentencepiece":
            assert out.columns == docs.columns
        assert step(spark, none, folder).count() == 0
        if name == "sentencepiece":
            assert counts[-1] == len(ROWS)
    assert counts[1] == len(ROWS) - 2  # of the copies 6, 7 and 7 one stays; the row without an id stays
    assert counts[2] == len(ROWS) - 2  # the passage and the one-word item


def test_pipeline_of_nothing(spark, none, labels, bench, tmp_path):
    folder = str(tmp_path)
    for name, df in (("documents", none), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (5, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [3.0]), (None, [1.0, 1.0]), (8, [-1.0, -2.0]), (8, [-1.0, -2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    out = [tuple(r) for r in topk.exact_top_k(df, df.where("vec_id in (0, 7)"), k=3).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 5, 5 * 1024**2), (0, 2, 6, 5 * 1024**2), (0, 3, 8, -5 * 1024**2)]
    assert topk.exact_top_k(df.limit(0), df.limit(0)).count() == 0


def test_pages(spark):
    page = "<p>" + "x" * 1200
    rows = [(1, "http://b.example.com/x", page), (2, None, page), (3, "http://B.example.com:80/x y\r\n", page), (4, "no host", None), (None, "http://a.org", page), (5, "http://a.org", "<p>"), (6, "http://a.org", "<p>"), (6, "http://a.org", "<p>")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")
    out = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_and_read_back(df).collect()), key=str)
    assert out == sorted([(1, 1203, "revisit", 3), (2, 1203, "revisit", 3), (3, 1203, "response", None), (4, 0, "response", None), (0, 1203, "revisit", 3), *[(i, 3, "response", None) for i in (5, 6, 6)]], key=str)
    assert warc.archive_and_read_back(df.limit(0)).count() == 0


def test_lookup_by_url(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h{i % 7}.example.com/p", f"<p>{i}") for i in range(3000)], "page_id long, url string, html string")
    ranges = warc.build_index(warc.write_archives(df, f"{tmp_path}/a"), f"{tmp_path}/i")
    asked = spark.createDataFrame([("http://h3.example.com/p", None), ("http://h9.example.com/p", None)], "url string, page_id long")
    got = warc.lookup(asked, ranges, whole_url=True)
    assert sorted(r.page_id for r in got.collect()) == list(range(3, 3000, 7))
    assert got.select(F.decode("payload", "utf-8").alias("p"), "page_id").where("p <> concat('<p>', page_id)").count() == 0


def test_redaction_text():
    text = "write to x@y.de or +49 30 1234567 today"
    spans = pii.base_spans(text)
    assert pii.redact_text(text, spans) == "write to [email] or [phone] today"
    assert pii.base_spans("a@b.c@d.e 1.2.3.4.5.6.7.8 999.1.1.1, 4111-1111 1111 1111") == [(0, 0, 5), (10, 1, 17), (18, 1, 25), (37, 2, 56)]
