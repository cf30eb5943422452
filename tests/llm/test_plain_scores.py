"""Scores of the learned operators against plain loops over documents, given the fitted parameters; recall of the fingerprint radius."""

import collections
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pulsegrid.llm import decontaminate, quality, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))


def squash(x):
    return 1 / (1 + math.exp(-x))


def plain_measures(words, lo, seen, n_words=quality.PASSAGE_WORDS):
    """The measures of the passage that begins at word ``lo``."""
    part = words[lo : lo + n_words]
    raw = "\n".join(part).encode()
    marks = ".,;:?'\"()"
    kinds = [
        lambda c: 97 <= c <= 122, lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57, lambda c: chr(c) in marks, lambda c: c == 33,
        lambda c: 32 < c < 127 and not chr(c).isalnum() and chr(c) not in marks + "!|", lambda c: c == 124, lambda c: c == 10, lambda c: c >= 192,
    ]
    pairs = {(words[i], words[i + 1]) for i in range(lo, min(lo + n_words, len(words) - 1))}
    fresh = len(pairs - seen)
    seen |= pairs
    n = len(part)
    return [sum(map(k, raw)) / len(raw) for k in kinds] + [math.log1p(n), sum(map(len, part)) / n, max(map(len, part)), len(set(part)) / n, len(pairs) / n, fresh / n, sum(w[-1] in ".!?" for w in part) / n]


def plain_quality(net, text):
    words, seen = text.split(), set()
    bag = [plain_measures(words, lo, seen) for lo in range(0, len(words), quality.PASSAGE_WORDS)] or [[0.0] * quality.SIZE]
    dot = lambda x, m: [sum(x[i] * m[i][j] for i in range(len(x))) for j in range(len(m[0]))]
    encoded, weight = [], []
    for row in bag:
        x = [(v - m) / s for v, m, s in zip(row, net["mean"], net["scale"], strict=True)]
        h = [math.tanh(v + b) for v, b in zip(dot(x, net["W"]), net["b"], strict=True)]
        gate = [math.tanh(t) * squash(u) for t, u in zip(dot(h, net["V"]), dot(h, net["U"]), strict=True)]
        encoded.append(h)
        weight.append(math.exp(sum(g * w for g, w in zip(gate, net["w"], strict=True))))
    z = [sum(a * h[j] for a, h in zip(weight, encoded, strict=True)) / sum(weight) for j in range(len(encoded[0]))]
    return squash(sum(v * u for v, u in zip(z, net["u"], strict=True)) + float(net["c"][0]))


def test_quality_is_attention_over_passages(spark, tables):
    documents, labels = tables
    net = quality.unpacked(quality.train(documents, labels.where(~quality.held_out(F.col("doc_id")))))
    got = {r.doc_id: r for r in entry.queries()["op2_quality"](spark, SF).collect()}
    for r in documents.collect():
        want = plain_quality(net, r.text or "")
        assert got[r.doc_id].score == pytest.approx(want, abs=1e-4) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)


def test_severity_is_the_sum_of_shares_above_each_threshold(spark, tables):
    documents, labels = tables
    model = json.loads(toxicity.train(documents, labels))
    got = {r.doc_id: r for r in entry.queries()["op9_toxicity"](spark, SF).collect()}
    for r in documents.collect():
        score = 0.0
        for word in set(re.findall(r"\w+", (r.text or "").lower())):
            score += model["weights"].get(word, 0.0) + sum(model["weights"].get("^" + word[:n], 0.0) for n in (4, 5) if len(word) > n)
        severity = sum(1 - squash(t - score) for t in model["thresholds"])
        assert got[r.doc_id].severity == pytest.approx(severity, abs=1e-9) and got[r.doc_id].toxic == (got[r.doc_id].severity >= toxicity.REJECT_AT)


def test_pairs_lost_by_the_fingerprint_radius(spark):
    """Items of 5 to 60 words, each copied into a document with as many changes as the similarity allows."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    items, docs, near = [], [], []
    shingles = lambda w: collections.Counter(tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4)))
    for k in range(1200):
        w = [word() for _ in range(rng.randint(5, 60))]
        copy = list(w)
        for at in rng.sample(range(len(w)), min(len(w), 2)):  # the ends cost fewest shingles
            trial = list(copy)
            trial[0 if at % 2 else -1] = word()
            a, b = shingles(w), shingles(trial)
            common = sum((a & b).values())
            if common * 100 >= (sum(a.values()) + sum(b.values()) - common) * 80:
                copy = trial
        items.append((k, " ".join(w)))
        docs.append((k, " ".join([word() for _ in range(20)] + copy + [word() for _ in range(20)])))
        near.append(copy != w)
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    lost = [r.doc_id for r in found.collect() if str(r.doc_id) not in r.item_ids.split(",")]
    assert sum(near) > 300 and all(near[k] for k in lost) and len(lost) <= 0.01 * sum(near), (len(lost), sum(near))
