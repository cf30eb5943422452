"""The n-gram join on groups of copies, shared passages and short texts, against brute force."""

import random

import numpy as np
import pytest

from pulsegrid.llm import ngram_join
from pulsegrid.llm.shingling import shingle_sets


def plain(docs):
    """Smallest id reachable by links, from an inverted index over whole sets."""
    ids = sorted(docs)
    sets = [set(s.tolist()) for s in shingle_sets([docs[i] for i in ids])]
    top, held = list(range(len(ids))), {}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, s in enumerate(sets):
        count = {}
        for t in s:
            for j in held.get(t, ()):
                count[j] = count.get(j, 0) + 1
            held.setdefault(t, []).append(i)
        for j, same in count.items():
            if 100 * same >= 80 * (len(s) + len(sets[j]) - same):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("klmnopqrst") + str(rng.randrange(300)) for _ in range(n)]


def mixture(seed):
    rng = random.Random(seed)
    passage, parts = words(rng, 60), [words(rng, 30) for _ in range(6)]
    base, short = words(rng, 120), [words(rng, 7) for _ in range(5)]
    docs = []
    for _ in range(150):  # one passage in unlike documents
        docs.append(words(rng, rng.choice([3, 8, 12, 20, 60])) + passage + words(rng, rng.choice([0, 3, 8])))
    for _ in range(150):  # passages mixed
        docs.append(sum([rng.choice(parts) for _ in range(rng.choice([2, 3, 4]))], words(rng, rng.choice([0, 0, 1, 2]))))
    for _ in range(150):  # near copies that drift apart
        x = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 5, 6])):
            x[rng.randrange(120)] = f"m{rng.randrange(10**6)}"
        docs.append(x)
    for _ in range(80):
        docs.append(words(rng, rng.randrange(1, 9)))
    for _ in range(80):
        x = list(rng.choice(short))
        x.insert(rng.randrange(8), rng.choice(["u", "v", *words(rng, 1)]))
        docs.append(x)
    return {i: " ".join(d) for i, d in enumerate(docs)}


@pytest.mark.parametrize("costly", [24, 3])
def test_mixture_equals_brute_force(spark, monkeypatch, costly):
    monkeypatch.setattr(ngram_join, "COSTLY", costly)
    docs = mixture(costly)
    got = ngram_join.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == plain(docs)


def around_a_passage(n):
    """Short, unlike documents that are mostly one passage."""
    rng = random.Random(1)
    passage = words(rng, 40)
    return [(i, " ".join(words(rng, 3) + passage + words(rng, 5))) for i in range(n)]


def test_pairs_around_one_passage_grow_in_proportion(spark, monkeypatch):
    made = []
    whole = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, total, *rest: (made.append(total), whole(pairs, total, *rest))[1])
    sizes = {}
    for n in (1000, 5000):
        made.clear()
        got = ngram_join.near_duplicates(spark.createDataFrame(around_a_passage(n), "doc_id long, text string")).collect()
        assert len({r.component_id for r in got}) == n
        sizes[n] = sum(made)
    assert sizes[5000] <= 6 * max(sizes[1000], 5000)


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_similar_documents_share_a_part(percent):
    rng = np.random.default_rng(percent)
    starts = ngram_join.bands(percent)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        k = int(rng.integers(0, max(1, (100 - percent) * 2 * n // (100 + percent)) + 1))
        out = int(rng.integers(0, min(k, n - 1) + 1)) if n > 1 else 0
        y = np.concatenate([x[out:], rng.integers(0, 2**63, k - out).astype(np.uint64)])
        same, every = n - out, n + k - out
        if 100 * same < percent * every:
            continue
        a, b = (set(ngram_join.part_keys(np.sort(z), len(z), percent, starts).tolist()) for z in (x, y))
        assert a & b


@pytest.mark.parametrize("percent", [50, 80, 99, 100])
def test_bands_of_similar_sizes_are_neighbours(percent):
    starts = np.array(ngram_join.bands(percent))
    n = np.arange(1, 5000)
    low, high = (np.searchsorted(starts, x, side="right") for x in (n, n * 100 // percent))
    assert (high - low).max() <= 1
