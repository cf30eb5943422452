"""Operators against direct computations on the smallest tables."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from pulsegrid.llm import entries, ngram_join, pieces, pii, quality, repeats, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    got, want = ([tuple(map(str, r)) for r in rows] for rows in (df.select(*cols).collect(), cur.fetchall()))
    assert sorted(got) == sorted(want)


def shingle_set(text):
    low = text.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(sets):
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            same = len(sets[i] & sets[j])
            if same and 100 * same >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: find(i) for i in sets}


def test_join(spark, texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    want = brute_components(sets)
    got = entries.QUERIES["op4_ngram_join"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), want[i]) for i, s in sets.items()}


def test_join_in_dense_groups(spark):
    """One large group of near copies, chains at the limit, and a common passage, with costly shingles in every prefix."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base, common = [word() for _ in range(60)], [word() for _ in range(30)]
    docs = {}
    for i in range(90):
        own = list(base)
        for _ in range(r.randint(0, 2)):
            own[r.randrange(60)] = word()
        docs[i] = " ".join(own)
    for i in range(90, 150):
        docs[i] = " ".join(common + [word() for _ in range(r.randint(0, 14))])
    for i in range(150, 180):
        docs[i] = " ".join(base[i - 150 :] + common[: i - 150])
    got = ngram_join.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    want = brute_components({i: shingle_set(t) for i, t in docs.items()})
    assert {x.doc_id: x.component_id for x in got} == want


def brute_removal(docs, n):
    seen = collections.Counter(d[i : i + n] for d in docs for i in range(len(d) - n + 1))
    out = []
    for d in docs:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append((len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_repeats(spark, texts):
    want = dict(zip(texts, brute_removal([t.encode() for t in texts.values()], 400), strict=True))
    got = entries.QUERIES["op7_repeats"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


@pytest.mark.parametrize("group", [2, 2048])
def test_repeats_in_hot_groups(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    r = random.Random(4)
    noise = lambda n: "".join(r.choice("abc d") for _ in range(n))
    shared, run = noise(700), noise(900)
    docs = [noise(r.randint(0, 300)) + shared[: r.randint(390, 700)] + noise(r.randint(0, 300)) for _ in range(40)]
    docs += [run[r.randint(0, 200) :] + "é" + run[: r.randint(300, 900)] for _ in range(10)] + ["z" * 1500, "ab" * 900, docs[0], docs[0]]
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    want = brute_removal([d.encode() for d in docs], 400)
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == dict(enumerate(want))


def test_tokens_match_the_library(spark, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    got = {r.doc_id: r.token_ids for r in entries.QUERIES["op6_sentencepiece"](spark, SF).collect()}
    assert got == {i: lib.encode(t) for i, t in texts.items()}
    encoded = pieces.encode(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: r.text for r in pieces.decode(encoded).collect()} == texts
    odd = ["  two  blanks ", "\ttab\n\nline", "日本 ​😀", "x" * 300]
    assert [x.tolist() for x in pieces.loaded(pieces.read_model(pieces.MODEL_PATH)).encode(odd)] == [lib.encode(t) for t in odd]


def test_unigram_paths_are_best():
    table = pieces.Pieces(pieces.read_model(pieces.MODEL_PATH), pieces.UNIGRAM)

    def best(word):
        top = [0.0]
        for end in range(1, len(word) + 1):
            top.append(max([top[end - 1] + table.unknown_score] + [top[at] + table.scores[word[at:end]] for at in range(end) if word[at:end] in table.scores]))
        return top[-1]

    words = ["▁thing", "▁enanen", "▁the", "▁überall", "▁theses", "▁there"]
    for word, ids in table.encode_words(words).items():
        assert sum(table.values[i] for i in np.frombuffer(ids, np.int32).tolist()) == pytest.approx(best(word))


def test_base_spans_are_those_of_the_patterns(texts):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    def spans(t):
        out = [(m.start(), 0, m.end()) for m in email.finditer(t)]
        out += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        out += [(m.start(), 2, m.end()) for m in card.finditer(t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
        return sorted(out + [(m.start(), 3, m.end()) for m in phone.finditer(t) if 9 <= len(digits(m)) <= 15])

    odd = ["a@b.c@d.e..f x.@y.z @q.r", "1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 001.02.3.4", "+1 2 3+4 (55) 5555-555. +12", "4111 1111-1111 1111 4111 1111 1111 1111 7", "%%a+b@c-d.e-f.g,h@i"]
    for t in [*texts.values(), *odd]:
        assert pii.base_spans(t) == spans(t)


def test_added_spans_are_disguised_ones():
    rows = [(x, y, n % 3) for n in range(300) for x, y in pii.examples(f"call +1 (0{n % 90 + 10}) 555-{1000 + n} or a{n}@mail.org, 10.{n % 200}.3.4 and 4111 1111 1111 1111; order {n}{n}7{n} v2.{n}.0")]
    import pandas as pd

    found = pii.Detector(pii.fit_model(pd.DataFrame(rows, columns=["x", "label", "fold"])))
    text = "mail joe (at) foo (dot) com or call (030) 555-1234, nothing else 2024-01-02"
    assert [text[s:e] for s, _, e in found.added(text, [])] == ["joe (at) foo (dot) com", "(030) 555-1234"]
    assert found.added("plain words, 12 of 30, section 4.2", []) == []


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_attention_gradients():
    rng = np.random.default_rng(0)
    p = {"W": rng.normal(size=(quality.SIZE, 3)), "b": rng.normal(size=3), "V": rng.normal(size=(3, 2)), "U": rng.normal(size=(3, 2)), "w": rng.normal(size=2), "u": rng.normal(size=3), "c": np.zeros(1)}
    x, start, y = rng.normal(size=(7, quality.SIZE)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    loss = lambda q: -np.mean(y * np.log(quality.forward(q, x, start)["p"]) + (1 - y) * np.log(1 - quality.forward(q, x, start)["p"]))
    grads = quality.gradients(p, x, start, y)
    for k in p:
        at = tuple(0 for _ in p[k].shape)
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][at] += 1e-6
        down[k][at] -= 1e-6
        assert (loss(up) - loss(down)) / 2e-6 == pytest.approx(grads[k][at], abs=1e-6)


def test_toxicity_on_other_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("doc_id % 4 <> 0"))
    rows = toxicity.score(docs.where("doc_id % 4 = 0"), model).join(labels, "doc_id").collect()
    hit = [r.severity >= toxicity.REJECT_AT for r in rows]
    clean = [h for h, r in zip(hit, rows, strict=True) if not r.toxic]
    bad = [h for h, r in zip(hit, rows, strict=True) if r.toxic]
    assert sum(clean) / len(clean) < 0.01 and sum(bad) / len(bad) > 0.8


def test_ordinal_thresholds_are_ordered():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 4, 400)
    weights, cuts = toxicity.fit_ordinal(np.arange(400), np.zeros(400, int), grades + rng.normal(0, 0.3, 400), grades, 1)
    assert weights[0] > 0 and (np.diff(cuts) > 0).all()


def test_licence_texts(spark):
    from pulsegrid.llm import licences

    s = licences.SENTENCES
    mit = "Copyright (c) 2020 Someone\n\n" + "\n".join(s[k] for k in ("mit-grant", "mit-notice", "mit-warranty", "mit-liability"))
    wrapped = "# " + (s["apache-licensed"] + " " + s["apache-compliance"]).replace(" file ", "\n# file ")
    swapped = "\n".join(s[k] for k in ("mit-warranty", "mit-notice", "mit-grant"))
    df = spark.createDataFrame([(0, mit), (1, wrapped), (2, swapped), (3, s["all-rights"] * 3)], "doc_id long, text string")
    assert [r.licences for r in licences.licence_scan(df).orderBy("doc_id").collect()] == ["MIT", "Apache-2.0", "", ""]


def test_repeats_leave_the_rest_as_text(spark, texts):
    for r in entries.QUERIES["op7_repeats"](spark, SF).collect():
        if r.n_removed == 0:
            assert r.text == texts[r.doc_id]
        else:
            assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 or len(r.text.encode()) < r.n_bytes - r.n_removed


@pytest.mark.parametrize("pattern", ["z", "ab", "-=+ ", "0123456789abcdefghijklmnopqrstuvwxyz"])
def test_periodic_text_is_folded(pattern):
    data = (pattern * 100_000)[:100_000].encode()
    found = repeats.folded(*repeats.anchors([b"x" * 50 + data + b"end"], 400)[0], 400)
    placed = [p for span in zip(*(f.tolist() for f in found), strict=True) for p in repeats.placed(dict(zip(repeats.FIELDS, span, strict=True)), b"x" * 50 + data + b"end", 400)]
    assert len(placed) <= max(1200, len(data) // len(pattern) + 400 if len(pattern) > 32 else 0)
    assert sum((hi - lo + 1) * max(1, times) for _, lo, hi, _, times in placed) == len(data) + 53 - 399


def test_periodic_text_stays_small(spark):
    docs = spark.createDataFrame([(1, "z" * 1_000_000), (2, "ab" * 3000 + "c"), (3, "x" + "z" * 700)], "doc_id long, text string")
    made = repeats.stage(repeats.segments(repeats.with_rows(docs).join(repeats.scanned(repeats.with_rows(docs), 400).withColumnRenamed("anchors", "spans"), "row").select("row", "text", "spans"), 400), "segments")
    assert made.count() < 5000  # about 160 bytes a row, against a text of a megabyte
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs).collect()}
    assert got == {1: (1_000_000, 1), 2: (6000, 1), 3: (700, 1)}
