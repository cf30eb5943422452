"""The near-duplicate stage on rows that share a doc_id."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, n int"


def words(seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60))


def kept(spark, rows):
    return sorted(map(tuple, corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, SCHEMA), "").collect()), key=str)


def test_texts_and_wordless_rows_of_one_id(spark):
    a, b, c, d = (words(i) for i in range(4))
    rows = [
        (1, a, 0), (2, a, 1), (2, b, 2), (2, None, 3), (2, " ", 4),  # one text of 2 is a copy
        (3, c, 5), (3, d, 6), (3, d, 7), (3, "", 8),  # different texts, one twice
        (9, c + " tail", 9), (4, None, 10), (4, None, 10),
    ]
    want = [(1, a, 0), (2, b, 2), (2, None, 3), (2, " ", 4), (3, c, 5), (3, d, 6), (3, "", 8), (4, None, 10), (4, None, 10)]
    assert kept(spark, rows) == sorted(want, key=str) == kept(spark, rows[::-1])


def test_smallest_id_stays_whatever_the_keys(spark):
    t = [words(i) for i in range(20, 40)]
    rows = [(i, x, 0) for i, x in enumerate(t)] + [(100, x + " more", 1) for x in t]
    assert kept(spark, rows) == sorted(((i, x, 0) for i, x in enumerate(t)), key=str)


def test_repeated_rows_and_no_mixed_ids(spark):
    a, b = words(50), words(51)
    assert kept(spark, [(1, a, 2), (1, a, 1), (1, None, 3), (5, a, 4), (5, None, 6), (7, b, 5)]) == sorted([(1, a, 1), (1, None, 3), (5, None, 6), (7, b, 5)], key=str)
