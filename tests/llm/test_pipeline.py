"""run() of the pipeline against plain Python versions of its decisions."""

import collections
import unicodedata

import pytest
import sentencepiece
from test_brute import brute_components, shingle_set

import corpus_pipeline
from pulsegrid.llm import pieces, pii, toxicity


def words(text):
    """Runs of letters, marks and digits."""
    return "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in text.lower()).split()


def shingles(w, k):
    return [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def contaminated(text, items):
    w = words(text)
    for item in items:
        k = min(5, len(item))
        want, every = collections.Counter(shingles(item, k)), shingles(w, k)
        if want.keys().isdisjoint(every):
            continue
        size, m = len(item) - k + 1, len(item) - k + 1
        for p in range(max(1, len(every) - size + 1)):
            own = collections.Counter(every[p : p + size])
            common, total = (own & want).total(), own.total()
            if common * 100 >= (total + m - common) * 80:
                return True
    return False


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_run_matches_brute_force(spark, size):
    folder = f"/root/testdata/{size}"
    source = spark.read.parquet(f"{folder}/documents.parquet")
    docs = [(r.doc_id, r.text or "") for r in source.select("doc_id", "text").collect()]
    assert len({i for i, _ in docs}) == len(docs)
    scorer = toxicity.Scorer(toxicity.train(source, spark.read.parquet(f"{folder}/labels.parquet")))
    fine = {i: t for i, t in docs if scorer.severity([t])[0] < toxicity.REJECT_AT}
    top = brute_components({i: shingle_set(t) for i, t in fine.items()})
    single = {i: t for i, t in fine.items() if not shingle_set(t) or top[i] == i}
    items = [w for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if (w := words(r.text or ""))]
    clean = {i: t for i, t in single.items() if not contaminated(t, items)}
    assert len(docs) >= len(fine) > len(single) > len(clean) > 0
    assert size == "sf0.001" or len(docs) > len(fine)  # the smallest table has no text above the limit
    detector = pii.Detector(pii.train(spark.createDataFrame(list(clean.items()), "doc_id long, text string")))
    redacted = {}
    for i, t in clean.items():
        base = pii.base_spans(t)
        redacted[i] = pii.redact_text(t, base + detector.added(t, base))
    assert redacted != clean
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    rows = corpus_pipeline.run(spark, folder).collect()
    assert len(rows) == len(redacted)
    assert {r.doc_id: r.token_ids for r in rows} == {i: lib.encode(t) for i, t in redacted.items()}
    tokens = spark.createDataFrame([(r.doc_id, r.token_ids) for r in rows], "doc_id long, token_ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(tokens).collect()} == redacted
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in rows)
