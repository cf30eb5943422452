"""Ordered lines, names in texts, table functions, contracts and gates."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import matching
from pulsegrid.operators import filters, folds, joins, resample
from pulsegrid.operators.extend import table_function
from pulsegrid.schema import BAR_CONTRACT, FEATURE_CONTRACT, POST_CONTRACT
from pulsegrid.sources import lines


@pytest.mark.parametrize("split", [1, 2, 7, 64, 1 << 20])
def test_lines_keep_file_and_offset(spark, tmp_path, split):
    texts = {"b.txt": "one\ntwo\r\n\nthree é\nfour", "a.txt": "\n\nfive\n", "c.txt": "", "_skip": "no"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = sorted((r.file.rsplit("/", 1)[-1], r.position, r.value) for r in lines.ordered_lines(spark, str(tmp_path), split).collect())
    assert got == [("a.txt", 0, ""), ("a.txt", 1, ""), ("a.txt", 2, "five"), ("b.txt", 0, "one"), ("b.txt", 4, "two"), ("b.txt", 9, ""), ("b.txt", 10, "three é"), ("b.txt", 19, "four")]


def test_symbols_in_file_order(spark, tmp_path):
    rng = random.Random(2)
    names = [f"S{rng.randrange(60)}" for _ in range(400)]
    for k in range(4):
        (tmp_path / f"{k}.txt").write_text("\n".join([f" {s.lower()} " for s in names[k * 100 : (k + 1) * 100]] + ["# note", ""]))
    got = lines.ordered_symbols(spark, str(tmp_path), exclude=["S7"], split_bytes=50).orderBy("position").collect()
    assert [r.ticker for r in got] == [s for s in dict.fromkeys(names) if s != "S7"]


def test_aliases_of_any_number(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg ") for _ in range(rng.randint(6, 12)))
    aliases = {word(): f"K{i % 500}" for i in range(50_000)} | {"he": "K1", "she": "K2", "hers": "K3", "É": "K4"}
    texts = [" ".join(word() for _ in range(30)) for _ in range(300)] + [None, "", "USHERS", "é"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    low = {a.lower(): k for a, k in aliases.items()}
    want = {(i, k) for i, t in enumerate(texts) for a, k in low.items() if a in (t or "").lower()}
    assert {(r.id, r.ticker) for r in joins.alias_matches(d, "text", aliases).select("id", "ticker").collect()} == want
    took = []
    for n in (500, 50_000):
        automaton = matching.Automaton(dict(list(low.items())[:n]))
        begun = time.perf_counter()
        for t in texts * 5:
            automaton.keys(t or "")
        took.append(time.perf_counter() - begun)
    assert took[1] < 20 * took[0]  # a hundred times the names


def test_empty_alias_and_no_alias(spark):
    d = spark.createDataFrame([(1, "x"), (2, None)], "id long, text string")
    assert joins.alias_matches(d, "text", {"": "ALL", "x": "X"}).count() == 3
    assert joins.alias_matches(d, "text", {}).count() == 0


def test_table_function_with_a_table_argument(spark):
    spark.udtf.register("letters_of", table_function(lambda v: [(c,) for c in v or ""], "letter string"))
    spark.createDataFrame([(1, "ab", 0.5), (2, None, 1.0), (3, "c", 2.0)], "id int, word string, w double").createOrReplaceTempView("worded")
    got = spark.sql("SELECT * FROM letters_of(TABLE(worded) PARTITION BY (id), 'word')")
    assert got.columns == ["id", "word", "w", "letter"] and sorted((r.id, r.letter) for r in got.collect()) == [(1, "a"), (1, "b"), (3, "c")]
    with pytest.raises(Exception, match="name of one of its columns"):
        spark.sql("SELECT * FROM letters_of(TABLE(worded), 'missing')").collect()


@pytest.mark.parametrize("n", [1, 2, 5, 100, 1001])
def test_shuffles_are_bijections(n):
    orders = [resample.shuffled_to(np.arange(n), b, n).tolist() for b in range(1, 8)]
    assert all(sorted(o) == list(range(n)) for o in orders) and (n < 100 or len({tuple(o) for o in orders}) == 7)


def test_contracts_report_what_they_drop(spark):
    posts = spark.createDataFrame([("a", "t", 1, 2, 1.0), (None, "t", -1, 2, 1.0), ("c", None, None, -2, None)], "post_id string, title string, upvotes long, comment_count long, created_utc double")
    bars = spark.createDataFrame([(1.0, 2.0, 0.5, 1.0, 0.0), (0.0, None, 1.0, 1.0, -1.0)], "open double, high double, low double, close double, volume double")
    feats = spark.createDataFrame([("A", 1.0, None, None), (None, -1.0, 101.0, 0.0)], "ticker string, post_count_1d double, rsi_14 double, relative_volume double")
    of = lambda d, c: tuple(filters.contract_summary(filters.contract_violations(d, c)).first())
    assert of(posts, POST_CONTRACT) == (3, 1, 2, 6) and of(bars, BAR_CONTRACT) == (2, 1, 1, 3) and of(feats, FEATURE_CONTRACT) == (2, 1, 1, 3)
    assert of(posts.limit(0), POST_CONTRACT) == (0, 0, 0, 0)


def test_fifth_gate_has_both_values(spark):
    f = spark.createDataFrame([(1, "bull", 5.0, 1.5, 1.0, 0.6, 10), (2, "bear_2022", 4.0, 1.2, 1.0, 0.5, 10)], "fold int, regime string, total_return_pct double, sharpe double, is_sharpe double, win_rate double, n_trades long")
    days = spark.createDataFrame([(0.01 + 0.001 * (i % 5),) for i in range(300)], "daily_return double")
    noise = spark.createDataFrame([(0.01 * (-1) ** i,) for i in range(300)], "daily_return double")
    good, bad = (folds.walk_forward_summary(f, d, dsr=resample.deflated_confidence(d, "daily_return", 2)).first() for d in (days, noise))
    assert (good.g5, good.overall) == (True, True) and (bad.g5, bad.overall) == (False, False)
