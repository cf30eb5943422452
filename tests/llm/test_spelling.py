"""Spelling variants against direct computations."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pulsegrid.llm import spelling

SF = "/root/testdata/sf0.001"


def plain_vocabulary(rows):
    count = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def near(x, y):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    k = next((k for k in range(len(x)) if x[k] != y[k]), len(x))
    return x[k + (len(x) == len(y)) :] == y[k + 1 :]


def plain(words):
    out, form = [], {}
    around = {w: [v for v in words if abs(len(v) - len(w)) < 2 and near(w, v)] for w in words}
    for w, n in words.items():
        top = min(around[w], key=lambda v: (-words[v], v), default=None)
        if top and words[top] >= 5 * n:
            form[w] = top
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(around[w]), words.get(form.get(w))))
    return sorted(out)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    words = plain_vocabulary(rows)
    assert len(words) > 500
    assert sorted(map(tuple, entry.queries()["op12_spelling"](spark, SF).collect())) == plain(words)


@pytest.mark.parametrize("asked", [3, 4096])
@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aàÿz"])
def test_pairs_of_random_words(spark, monkeypatch, letters, asked):
    monkeypatch.setattr(spelling, "ASKED", asked)
    rng = random.Random(len(letters))
    words = sorted({"".join(rng.choices(letters, k=rng.choice([2, 3, 6, 6, 7, 7, 8, 9, 12]))) for _ in range(500)})
    for w in words[::3]:
        k = rng.randrange(len(w))
        words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]]))
    words = sorted({w for w in words if len(w) > 1})
    got = spelling.near_pairs(spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")).collect()
    assert sorted((r.word, r.near) for r in got) == [(x, y) for x in words for y in words if near(x, y)]
    assert all(r.near_n == len(r.near) for r in got)


def test_defined_cases(spark):
    chain = [("colour", 700), ("colours", 130), ("coloúrs", 26), ("colóúrs", 5), ("color", 900), ("cólour", 130), ("flavor", 4), ("ÉCOLES", 6), ("écoles", 30), ("Écoles", 9)]
    rows = [(None, " ".join([w] * n)) for w, n in chain] + [(1, None), (2, ""), (2, "12 34"), (None, "flavor"), (7, "naïveté×÷x " * 40), (7, "naïveté×÷x " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "run", "h")})
    got = spelling.variants(docs)
    found = {r.word: tuple(r) for r in got.collect()}
    assert sorted(found.values()) == plain(plain_vocabulary(rows))
    assert found["colóúrs"][1:3] == ("coloúrs", "colour") and "color" not in found and found["flavor"][3] == 5
    assert found["Écoles"][3] == 15 and found["Écoles"][1] is None and found["écoles"][4] == 1
    empty = spelling.variants(docs.limit(0))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0
