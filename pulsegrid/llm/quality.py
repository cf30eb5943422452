"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Each passage becomes a vector of surface
measures and is encoded by a tanh layer. Gated attention, learned from the labels of whole documents,
weighs the passages: a_i ~ exp(w . (tanh(V h_i) * sigmoid(U h_i))). The weighted mean of the encoded
passages gives the document's probability.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import fit_in_one_task, labelled_sample, slices, texts_of

#: Labelled rows that the fit uses at most; scoring covers every row.
FIT_ROWS = 8_000
PASSAGE_WORDS = 128
HIDDEN, GATE = 16, 8
EPOCHS, BATCH, RATE, RIDGE = 12, 128, 0.01, 1e-4
PREDICT_AT = 0.7


def byte_classes() -> np.ndarray:
    """256 x classes: which class each UTF-8 byte belongs to."""
    c = np.zeros((256, 9))
    for b in range(256):
        ch = chr(b)
        c[b, 0] = b < 128 and ch.islower()
        c[b, 1] = b < 128 and ch.isupper()
        c[b, 2] = b < 128 and ch.isdigit()
        c[b, 3] = ch in ".,;:?'\"()"
        c[b, 4] = ch in "!"
        c[b, 5] = 32 < b < 127 and not ch.isalnum() and ch not in ".,;:?'\"()!|"
        c[b, 6] = ch == "|"
        c[b, 7] = ch == "\n"
        c[b, 8] = b >= 192
    return c


CLASSES = byte_classes()
SIZE = 16


def passage_matrix(text: str) -> np.ndarray:
    """One row of measures per passage; an empty text has one passage of zeros."""
    words = text.split()
    if not words:
        return np.zeros((1, SIZE), np.float32)
    seen: set[tuple[str, str]] = set()
    out = []
    for lo in range(0, len(words), PASSAGE_WORDS):
        part = words[lo : lo + PASSAGE_WORDS]
        raw = "\n".join(part).encode("utf-8", "surrogatepass")
        shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ CLASSES / len(raw)
        pairs = set(zip(part, words[lo + 1 : lo + 1 + PASSAGE_WORDS]))
        fresh = len(pairs - seen)
        seen |= pairs
        n, kinds = len(part), set(part)
        sizes = [len(w) for w in part]
        mean = sum(sizes) / n
        out.append([*shares, np.log1p(n), mean, max(sizes), len(kinds) / n, len(pairs) / n, fresh / n, sum(w[-1] in ".!?" for w in part) / n])
    return np.asarray(out, np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(p: dict[str, np.ndarray], x: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
    """Encoded passages, attention within each bag (bags begin at ``start``), and bag probabilities."""
    bag = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(x))))
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    a = np.exp(e - np.maximum.reduceat(e, start)[bag])
    a /= np.add.reduceat(a, start)[bag]
    z = np.add.reduceat(a[:, None] * h, start, axis=0)
    return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "p": sigmoid(z @ p["u"] + p["c"])}


def gradients(p: dict[str, np.ndarray], x: np.ndarray, start: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss of the bags."""
    f = forward(p, x, start)
    bag, h, t, g, a = (f[k] for k in ("bag", "h", "t", "g", "a"))
    d = (f["p"] - y) / len(y)
    dz = d[:, None] * p["u"]
    da = (dz[bag] * h).sum(1)
    de = a * (da - np.add.reduceat(a * da, start)[bag])
    dt, dg = de[:, None] * g * p["w"] * (1 - t**2), de[:, None] * t * p["w"] * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "u": f["z"].T @ d, "c": d.sum(keepdims=True)}


def fit_bags(bags: list[np.ndarray], y: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam over batches of bags, weighted so that both labels count alike."""
    rng = np.random.default_rng(seed)
    p = {
        "W": rng.normal(0, 0.3, (SIZE, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)),
        "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE), "u": rng.normal(0, 0.3, HIDDEN), "c": np.zeros(1),
    }
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            sizes = [len(bags[i]) for i in part]
            grads = gradients(p, np.concatenate([bags[i] for i in part]), np.cumsum([0, *sizes[:-1]]), y[part])
            step += 1
            for k in p:
                d = grads[k] + RIDGE * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d**2
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(model: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(model), allow_pickle=False) as f:
        return {k: f[k] for k in f.files}


def fit_model(sample: pd.DataFrame) -> bytes:
    """Model of the rows ``doc_id, bag (float32 bytes), label``; with one label only, a constant."""
    y = sample["label"].to_numpy(dtype=np.float64) if len(sample) else np.empty(0)
    if len(np.unique(y)) < 2:
        return packed({"constant": np.array([y[0] if len(y) else 0.5])})
    order = np.argsort(sample["doc_id"].to_numpy(), kind="stable")
    bags = [np.frombuffer(b, np.float32).reshape(-1, SIZE).astype(np.float64) for b in sample["bag"].to_numpy()[order]]
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    return packed({"mean": mean, "scale": scale} | fit_bags([(b - mean) / scale for b in bags], y[order]))


def train(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> bytes:
    """Fit on at most ``fit_rows`` rows of ``labels``."""

    def bags(batches):
        for b in slices(batches):
            bag = pa.array([passage_matrix(t).tobytes() for t in texts_of(b["text"])], pa.binary())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["label"], bag], ["doc_id", "label", "bag"])

    sample = labelled_sample(documents, labels, "quality", fit_rows)
    return fit_in_one_task(sample.mapInArrow(bags, "doc_id long, label int, bag binary"), fit_model)


def probabilities(model: dict[str, np.ndarray], texts: list[str]) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), float(model["constant"][0]))
    if not texts:
        return np.empty(0)
    bags = [passage_matrix(t) for t in texts]
    start = np.cumsum([0, *[len(b) for b in bags[:-1]]])
    x = (np.concatenate(bags).astype(np.float64) - model["mean"]) / model["scale"]
    return forward(model, x, start)["p"]


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2. A null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def quality(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, at: float = PREDICT_AT) -> DataFrame:
    """Per row of ``documents``: ``doc_id, held_out, score, predicted``, learned from labels outside the held-out fold.

    Defined cases: a null or empty text is one passage of zero measures and gets that passage's score. Null
    labels and ids are not learned from; with fewer than two different labels the score is that label (0.5
    without any). Repeated rows score alike. Empty tables give no rows; other columns are ignored.
    """
    model = train(documents, labels.where(~held_out(F.col("doc_id"))), fit_rows)

    def run(batches):
        net = unpacked(model)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(probabilities(net, texts_of(part["text"])), pa.float64())], ["doc_id", "score"])

    scored = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))
