"""Dense documents of the n-gram join: their shingles are counted, not joined with counts."""

import random

from pulsegrid.llm import ngram_join


def near_copies(n, words=120):
    rng = random.Random(5)
    base, docs = [f"w{i}" for i in range(words)], {}
    for i in range(n):
        x = list(base)
        for _ in range(i % 3):
            x[rng.randrange(words)] = f"m{i}x{rng.randrange(10**6)}"
        docs[i] = " ".join(x)
    return docs


def test_counts_of_dense_shingles_need_no_join(spark, monkeypatch):
    kept, whole = {}, ngram_join.stage

    def seen(df, name, rows=None):
        out = whole(df, name, rows)
        kept[name] = (df._jdf.queryExecution().analyzed().toString(), out)
        return out

    monkeypatch.setattr(ngram_join, "stage", seen)
    docs = near_copies(120)
    got = ngram_join.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}
    plan, among = kept["among"]
    assert "Join" not in plan
    held = {r.token: r.n for r in kept["held"][1].collect()}
    dense = {}
    for r in kept["dense"][1].collect():
        dense[r.token] = dense.get(r.token, 0) + 1
    assert dense and {r.token: (r.n, r.df, r.passed) for r in among.collect()} == {t: (n, n, held.get(t, 0) > ngram_join.COSTLY) for t, n in dense.items()}
    assert any(held.get(t, 0) > ngram_join.COSTLY for t in dense)
