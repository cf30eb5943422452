"""Toxicity by cumulative-link ordinal regression over sparse text features.

Features of a document are the distinct words and their first four and five letters, each counted over
distinct words. Labels say toxic or not; the grades above 0 come from the labels too: toxic training
documents are ranked by how many words with a high log-odds they hold and cut into equal thirds. One
weight vector is shared by the ordered thresholds, P(grade <= k) = sigmoid(threshold_k - w.x), and the
output is the expected grade.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import fit_in_one_task, labelled_sample, slices, texts_of

#: Labelled rows that the fit uses at most; scoring covers every row.
FIT_ROWS = 12_000
GRADES = 3
MIN_SUPPORT = 5
MIN_LOG_ODDS = 1.0
#: About one false feature in a million, so that chance words of a small sample do not get in.
MIN_G = 24.0
MAX_FEATURES = 20_000
REJECT_AT = 0.4
WORD = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    """The word itself and its stems of four and five letters."""
    return [word, *("^" + word[:n] for n in (4, 5) if len(word) > n)]


def distinct_words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def association(counts: np.ndarray, toxic: np.ndarray, totals: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log-odds ratio of each feature between toxic and other documents, and the G statistic of its 2 x 2 table."""
    table = np.stack([toxic, counts - toxic, totals[1] - toxic, totals[0] - (counts - toxic)]).astype(np.float64)
    a, b, c, d = table + 0.5
    n = sum(totals)
    expected = np.stack([counts * totals[1], counts * totals[0], (n - counts) * totals[1], (n - counts) * totals[0]]) / n
    terms = table * np.log(np.maximum(table, 1e-300) / np.maximum(expected, 1e-300))
    return np.log(a * d / (b * c)), 2 * np.where(table > 0, terms, 0).sum(axis=0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def cumulative(scores: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade <= k) for k = 0 .. K, one row per document."""
    inner = sigmoid(thresholds[None, :] - scores[:, None])
    return np.hstack([inner, np.ones((len(scores), 1))])


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int,
                steps: int = 500, rate: float = 0.1, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that maximise the penalised likelihood (Adam on the full sample).

    Thresholds are kept in order by writing them as a first value and positive gaps.
    """
    n, k = len(grades), GRADES
    mass = 1 / n
    shares = np.array([(grades <= i).mean() for i in range(k)]).clip(0.02, 0.98)
    first = np.log(shares / (1 - shares))
    theta = np.concatenate([np.zeros(n_features), first[:1], np.log(np.maximum(np.diff(first), 0.05))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def cuts(t: np.ndarray) -> np.ndarray:
        return t[n_features] + np.concatenate([[0], np.cumsum(np.exp(t[n_features + 1 :]))])

    at = np.arange(n)
    for step in range(1, steps + 1):
        w, th = theta[:n_features], cuts(theta)
        score = np.bincount(rows, values * w[cols], minlength=n)
        up = np.hstack([sigmoid(th[None, :] - score[:, None]), np.ones((n, 1)), np.zeros((n, 1))])
        hi, lo = up[at, grades], up[at, grades - 1]  # column -1 is the zero below the first threshold
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = mass * hi * (1 - hi) / p, mass * lo * (1 - lo) / p
        d_score = d_hi - d_lo  # of the negative log likelihood
        d_th = np.zeros(k)
        np.add.at(d_th, grades[grades < k], -d_hi[grades < k])
        np.add.at(d_th, grades[grades > 0] - 1, d_lo[grades > 0])
        gaps = np.exp(theta[n_features + 1 :])
        tail = np.cumsum(d_th[::-1])[::-1]
        grad = np.concatenate([np.bincount(cols, values * d_score[rows], minlength=n_features) + ridge * w, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:n_features], cuts(theta)


def fit_model(sample: pd.DataFrame) -> bytes:
    """Model of the labelled rows ``words (array), label`` as JSON; without both labels it scores everything 0."""
    labels = sample["label"].to_numpy(dtype=np.int64) if len(sample) else np.empty(0, np.int64)
    nothing = json.dumps({"weights": {}, "thresholds": [4.0, 5.0, 6.0]}).encode()
    if len(np.unique(labels)) < 2:
        return nothing
    order = np.argsort(sample["doc_id"].to_numpy(), kind="stable")
    labels = labels[order]
    index: dict[str, int] = {}
    rows, cols, values = [], [], []
    for i, words in enumerate(sample["words"].to_numpy()[order]):
        own: dict[int, int] = {}
        for word in words:
            for f in word_features(word):
                c = index.setdefault(f, len(index))
                own[c] = own.get(c, 0) + 1
        rows.append(np.full(len(own), i, np.int64))
        cols.append(np.fromiter(own.keys(), np.int64, len(own)))
        values.append(np.fromiter(own.values(), np.float64, len(own)))
    row, col, value = map(np.concatenate, (rows, cols, values))
    counts = np.bincount(col, minlength=len(index))
    toxic = np.bincount(col, labels[row], minlength=len(index))
    ratio, g = association(counts, toxic, (int((labels == 0).sum()), int(labels.sum())))
    strong = np.flatnonzero((counts >= MIN_SUPPORT) & (np.abs(ratio) >= MIN_LOG_ODDS) & (g >= MIN_G))
    if not len(strong):
        return nothing
    strong = strong[np.argsort(-g[strong], kind="stable")][:MAX_FEATURES]
    place = np.full(len(index), -1)
    place[strong] = np.arange(len(strong))
    kept = place[col] >= 0
    row, col, value = row[kept], place[col[kept]], value[kept]
    markers = np.bincount(row, value * (ratio[strong][col] >= 2), minlength=len(labels))
    third = np.quantile(markers[labels == 1], [1 / 3, 2 / 3])
    grades = np.where(labels == 1, 1 + np.searchsorted(third, markers, side="left"), 0)
    weights, thresholds = fit_ordinal(row, col, value, grades, len(strong))
    names = list(index)
    return json.dumps({"weights": {names[j]: round(float(w), 6) for j, w in zip(strong, weights, strict=True)}, "thresholds": [round(float(t), 6) for t in thresholds]}).encode()


def train(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> bytes:
    """Fit on at most ``fit_rows`` labelled documents."""

    def words_of(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["label"], pa.array([sorted(distinct_words(t)) for t in texts_of(b["text"])], pa.list_(pa.string()))], ["doc_id", "label", "words"])

    sample = labelled_sample(documents, labels, "toxic", fit_rows)
    return fit_in_one_task(sample.mapInArrow(words_of, "doc_id long, label int, words array<string>"), fit_model)


class Scorer:
    """Expected severity of texts; the words seen so far keep their weight, up to a fixed number of words."""

    def __init__(self, model: bytes, cached_words: int = 300_000):
        read = json.loads(model)
        self.weights, self.thresholds = read["weights"], np.array(read["thresholds"])
        self.known: dict[str, float] = {}
        self.room = cached_words

    def word(self, word: str) -> float:
        if len(self.known) >= self.room:
            self.known.clear()
        self.known[word] = w = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return w

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            get, total = self.known.get, []
            for w in distinct_words(text):
                x = get(w)
                total.append(self.word(w) if x is None else x)
            out[i] = math.fsum(total)
        return out

    def severity(self, texts: list[str]) -> np.ndarray:
        """Sum over k of P(grade > k)."""
        return (1 - cumulative(self.scores(texts), self.thresholds)[:, :-1]).sum(axis=1)


def score(documents: DataFrame, model: bytes, text: str = "text", severity: str = "severity") -> DataFrame:
    """``documents`` with the expected severity (0 to ``GRADES``) of each text in the column ``severity``.

    Defined cases: a null or empty text has no features and gets the severity of score 0. Repeated rows get
    equal scores. All other columns, null or not, pass through; a column that has the name of the new one is replaced.
    """
    kept = [c for c in documents.columns if c != severity]

    def run(batches):
        scorer = Scorer(model)
        for b in slices(batches):
            values = pa.array(scorer.severity(texts_of(b[text])), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), values], [*kept, severity])

    source = documents.select(*kept)
    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField(severity, T.DoubleType())]))


def toxicity(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, reject_at: float = REJECT_AT) -> DataFrame:
    """Per row of ``documents``: ``doc_id, severity, grade, toxic``.

    ``grade`` is the rounded severity, ``toxic`` whether the severity reaches ``reject_at``. Null texts count
    as empty, without labels of both kinds nothing is toxic, empty tables give no rows.
    """
    scored = score(documents.select("doc_id", "text"), train(documents, labels, fit_rows))
    return scored.select("doc_id", "severity", F.round("severity").cast("int").alias("grade"), (F.col("severity") >= reject_at).alias("toxic"))
