"""SimHash near-duplicates against direct computations."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pulsegrid.llm import simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, threshold=4):
    """Smallest position reachable from each position."""
    top = list(range(len(fps)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return [find(i) for i in range(len(fps))]


def test_query_equals_brute_force(spark):
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    fps = [plain_fingerprint(t) for _, t in texts]
    tops = plain_components(fps)
    want = {(i, f"{fp:016x}", texts[t][0]) for (i, _), fp, t in zip(texts, fps, tops, strict=True)}
    assert {tuple(r) for r in entry.queries()["op11_simhash"](spark, SF).collect()} == want


@pytest.mark.parametrize("hashed", [3, 65_536])
@pytest.mark.parametrize("text", ["", " \t", "a", "A b", "a b c", "a b c D", "a b c d e", "x y " * 40, "É é  x\x0bB c d e f g"])
def test_fingerprint(monkeypatch, text, hashed):
    monkeypatch.setattr(simhash, "HASHED", hashed)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("bits", [8, 11])
def test_any_two_near_fingerprints_meet_at_a_home(bits):
    rng = np.random.default_rng(bits)
    code = simhash.anchors(bits)
    x = rng.integers(0, 2**64, 300, np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, 300, np.uint64)
    who, where, home = simhash.near_anchors(np.concatenate([x, y]), code, 4)
    visits, own = {}, {}
    for i, a, h in zip(who.tolist(), where.tolist(), home.tolist(), strict=True):
        visits.setdefault(i, set()).add(a)
        if h:
            own[i] = a
    assert all(own[i] in visits[i + 300] or own[i + 300] in visits[i] for i in range(300))


@pytest.mark.parametrize("homes", [1 << 20, 40])
def test_dense_clusters_chains_and_split_anchors(spark, monkeypatch, homes):
    rng = random.Random(3)
    center = rng.getrandbits(64)
    fps = {center, 0, 2**64 - 1}
    for _ in range(300):  # a cluster of near copies
        fps.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    at = rng.getrandbits(64)
    for k in range(0, 60, 4):  # a chain whose neighbours differ by four bits
        at ^= 0b1111 << k
        fps.add(at)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    monkeypatch.setattr(simhash, "HOMES", homes)
    links = simhash.similar_links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(5), 8, 4, homes=homes).collect()
    place = {s: i for i, s in enumerate(signed)}
    top = list(range(len(fps)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        u, v = sorted((find(place[a]), find(place[b])))
        top[v] = u
    assert [find(i) for i in range(len(fps))] == plain_components(fps)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (5, "one two three four five"), (5, "unlike words stand here now"), (None, "one two three four five"), (9, "ONE two  three four five"), (None, "alone without any id at all"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("fp", "root", "n", "first")})
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    same, alone = f"{plain_fingerprint(rows[2][1]):016x}", f"{plain_fingerprint(rows[6][1]):016x}"
    other = f"{plain_fingerprint(rows[3][1]):016x}"
    zero = "0" * 16
    assert got == sorted([(1, zero, 1), (2, zero, 1), (2, zero, 1), (5, same, 5), (5, other, 5), (None, same, 5), (9, same, 5), (None, alone, None)], key=str)
    empty = simhash.near_duplicates(docs.limit(0))
    assert empty.columns == ["doc_id", "fingerprint", "component_id"] and empty.count() == 0
