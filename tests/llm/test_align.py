"""Alignment of two tokenizers against direct computations with their libraries."""

import collections
import hashlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from pulsegrid.llm import align

SF = "/root/testdata/sf0.001"
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {chr(c): c for c in SHOWN} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in SHOWN)}


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(align.A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=align.B_PATH)


@pytest.fixture(scope="module")
def aligner():
    return align.Aligner(open(align.A_PATH, "rb").read(), open(align.B_PATH, "rb").read())


def plain_groups(encoders, text):
    a, b = encoders
    if not text:
        return []
    raw = (" " + text).encode()
    x = a.encode(" " + text, add_special_tokens=False).ids
    y = b.encode(text)
    ax = [bytes(BYTES[c] for c in a.id_to_token(i)) for i in x]
    by = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    if b"".join(ax) != raw or b"".join(by) != raw:
        return []
    ea, eb = np.cumsum([len(t) for t in ax]).tolist(), np.cumsum([len(t) for t in by]).tolist()
    out, i, j = [], 0, 0
    for end in sorted(set(ea) & set(eb)):
        u, v = ea.index(end) + 1, eb.index(end) + 1
        out.append((x[i:u], y[j:v]))
        i, j = u, v
    return out


def plain(encoders, rows):
    groups = [plain_groups(encoders, t) for _, t in rows]
    count = collections.Counter(p for g in groups for p in {(a, b) for x, y in g for a in x for b in y})
    top = collections.defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for (i, _), g in zip(rows, groups, strict=True):
        links = [(a, b) for x, y in g for a in x for b in y]
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        digest = hashlib.sha256(spelled.encode()).hexdigest() if g else ""
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), digest))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, encoders, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = sorted(rows, key=lambda r: r[0])
    assert sorted(map(tuple, entry.queries()["op13_alignment"](spark, SF).collect()), key=str) == plain(encoders, rows)


CASES = ["", " ", "a", "z" * 3000, "<s> </s><unk> <|endoftext|>", "a ▁ b", "naïve café — 東京 ☃ 𝒳", "  two  spaces\n\ttabs ", "\x00\x01", "the cat " * 50, "Ω͸Ꟛ"]


def test_defined_cases(spark, encoders):
    rows = [(k, t) for k, t in enumerate(CASES)] + [(None, "the cat"), (3, None), (3, "the cat"), (3, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("block", "pair", "n", "best")})
    got = align.alignment(docs)
    assert sorted(map(tuple, got.collect()), key=str) == plain(encoders, rows)
    empty = align.alignment(docs.limit(0))
    assert empty.columns == got.columns and empty.count() == 0
    written = {r.doc_id: r.groups for r in align.align(docs.where("doc_id < 3 OR doc_id > 3")).collect()}
    assert written[2] == "257|263" or written[2].count("|") == 1


@pytest.mark.parametrize("text", CASES)
def test_ids_are_the_files(aligner, encoders, text):
    assert aligner.a.encode(" " + text) == encoders[0].encode(" " + text, add_special_tokens=False).ids


@pytest.mark.parametrize("work", [1, 2, 3, 7, 64, 65_536])
def test_pieces_of_any_size_give_all_overlaps(work):
    rng = np.random.default_rng(work)
    for _ in range(60):
        n = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n + 1)), n)) for _ in range(2))
        got = [(int(i), int(j)) for x, y in align.pieces(a, b, work) for i, j in zip(x, y, strict=True)]
        starts = lambda e: np.append(0, e[:-1])
        sa, sb = starts(a), starts(b)
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(sa[i], sb[j]) < min(a[i], b[j])]
        assert sorted(got) == want and len(set(got)) == len(got)
        last_a, last_b = align.cuts(a, b, work)
        both = sorted(set(a.tolist()) & set(b.tolist()))
        assert a[last_a].tolist() == both and b[last_b].tolist() == both


@pytest.mark.parametrize("text", [*CASES, "one two  three", "foo\n bar \nbaz\t \n qux", "end ", " start", "it's we'll x\u00a0y", "a\x00b 12,5% (ok)", "12345 " * 9 + "z"])
def test_ids_word_by_word_are_those_of_the_text(aligner, encoders, text):
    for _ in range(2):  # unknown and known words
        a, b, n_a, n_b = aligner.encode([text, "x", text])
        groups = plain_groups(encoders, text)
        want = [i for g, _ in groups for i in g], [i for _, g in groups for i in g]
        assert (a[: n_a[0]].tolist(), b[: n_b[0]].tolist()) == want == (a[n_a[:2].sum() :].tolist(), b[n_b[:2].sum() :].tolist())


def test_words_not_spelled_fall_back_to_the_whole_text(aligner, monkeypatch):
    want = [x.tolist() for x in aligner.encode(["the cat", "a dog"])]
    aligner.known["cat"] = b""
    assert [x.tolist() for x in aligner.encode(["the cat", "a dog"])] == want
    aligner.known.clear()


def test_long_stretches_without_a_common_end(aligner, encoders, monkeypatch):
    text = "the 東京 cat sat " * 30
    want = align.Aligned(aligner, [text, "x", text])
    monkeypatch.setattr(align, "LARGE", 0)
    got = align.Aligned(aligner, [text, "x", text], work=5)
    for c in ("pairs", "weights", "held", "n_links", "n_groups"):
        assert getattr(got, c).tolist() == getattr(want, c).tolist()
    assert got.groups == want.groups


def test_blocks_of_few_pairs(spark, encoders, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    monkeypatch.setattr(align, "BLOCK_PAIRS", 500)
    monkeypatch.setattr(align, "TEXT_BYTES", 4000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, align.alignment(docs).collect()), key=str) == plain(encoders, rows)
