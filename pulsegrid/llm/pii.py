"""Personal data by candidate gradient boosting.

The base spans are those of four fixed patterns with validation. High-recall generators propose further,
overlapping candidates of the same kinds: addresses with spelt-out signs, numbers with other separators or
without a leading plus, masked dots. Boosted trees score each candidate by its format and context. They learn
from validated spans, from the same spans rewritten the way people disguise them, and, as negatives, from the
remaining candidates and from dates and counts put in a span's place, of all documents. The threshold of each kind is the
lowest score that keeps a wanted precision on candidates left out of the fit. Accepted candidates that touch no better span join the base spans.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import slices, stage, texts_of

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
TREES, DEPTH, SHRINK, BINS = 40, 3, 0.3, 16
#: Steps of gradients in the fit, and of scores where thresholds are picked.
UNIT, CODES = 1 << 20, 1 << 16

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SPELT = re.compile(
    r"(?:\([Aa][Tt]\)|\[[Aa][Tt]\]|\{[Aa][Tt]\}|\b[Aa][Tt]\b|@) ?[A-Za-z0-9-]{1,63}"
    r"(?: ?(?:\([Dd][Oo][Tt]\)|\[[Dd][Oo][Tt]\]|\{[Dd][Oo][Tt]\}|\b[Dd][Oo][Tt]\b|\[\.\]|\.) ?[A-Za-z0-9-]{1,63})+")
SIGN = re.compile(r"[(\[{@]|\b[Dd][Oo][Tt]\b")
NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[ ()./\[\]-]{0,3}[0-9])+")
DIGITS = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind, end


def digits_of(text: str) -> str:
    return DIGITS.sub("", text)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def valid_ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, leftmost and non-overlapping per kind, without those that fail validation."""
    out: list[Span] = []
    if "@" in text:
        free = 0
        for m in DOMAIN.finditer(text):
            at = m.start()
            start = free + len(text[free:at].rstrip(LOCAL))
            if start < at:
                out.append((start, 0, m.end()))
                free = m.end()
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if valid_ip(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = digits_of(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data; one number may be proposed as several kinds."""
    out: list[Span] = []
    for m in SPELT.finditer(text):
        if SIGN.search(m[0]):
            end = m.start() - (text[m.start() - 1 : m.start()] == " ")
            start = len(text[max(0, end - 64) : end].rstrip(LOCAL)) + max(0, end - 64)
            if start < end:
                out.append((start, 0, m.end()))
    for m in NUMBER.finditer(text):
        n = len(digits_of(m[0]))
        if n < 4 or text[m.start() - 1 : m.start()].isalnum() or text[m.end() : m.end() + 1].isalnum():
            continue  # part of a word or token
        if n >= 7:
            out.append((m.start(), 3, m.end()))
        if 12 <= n <= 19:
            out.append((m.start(), 2, m.end()))
        if len(re.findall("[0-9]+", m[0])) == 4:
            out.append((m.start(), 1, m.end()))
    return out


CUES = ("mail", "tel", "phone", "call", "fax", "card", "visa", "account", "ip", "host", "address", "contact", "id", "order", "token", "version", "isbn", "no")
FEATURES = 26


def features(text: str, span: Span) -> list[float]:
    """Format of the span and what stands around it."""
    start, kind, end = span
    s = text[start:end]
    d = digits_of(s)
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    before, after = text[max(0, start - 24) : start], text[end : end + 12]
    values = [int(g) for g in re.findall("[0-9]+", s)[:4] if len(g) < 7]
    cue = before.lower()
    named = {
        "email": any(c in cue for c in CUES[:1]), "phone": any(c in cue for c in CUES[1:5]), "card": any(c in cue for c in CUES[5:8]),
        "net": any(c in cue for c in CUES[8:10]), "other": any(c in cue for c in CUES[12:]),
    }
    edge = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3 if c in ".,;:!?)" else 4
    return [
        kind, len(s), len(d), len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        s.startswith("+"), "(" in s, s.count("-"), s.count(" "), s.count("."), s.count("/"), "[" in s or "{" in s,
        luhn(d) if d else 0, max(values, default=-1), "@" in s, bool(re.search(r"\bdot\b", s, re.IGNORECASE)), sum(c.isalpha() for c in s),
        edge(before[-1:]), edge(after[:1]), *(named[k] for k in ("email", "phone", "card", "net")),
    ]


def disguised(text: str, span: Span) -> tuple[str, Span] | None:
    """The same span rewritten as people disguise it, in its own context."""
    start, kind, end = span
    s = text[start:end]
    new = {0: s.replace("@", " (at) ").replace(".", " (dot) "), 1: s.replace(".", "[.]"), 2: ".".join(re.findall("[0-9]{1,4}", s)), 3: re.sub(r"^\+[0-9]{1,3} ", "", s)}[kind]
    if kind == 3 and len(digits_of(new)) < 9:
        return None
    return text[:start] + new + text[end:], (start, kind, start + len(new))


def decoys(text: str, span: Span) -> list[tuple[str, Span]]:
    """Numbers that are no personal data (a date, a plain count, a range of years) in place of the span."""
    start, _, end = span
    d = int(digits_of(text[start:end])[-6:] or 0)
    year, month, day = 1950 + d % 90, 1 + d % 12, 1 + d % 28
    numbers = (f"{year}-{month:02d}-{day:02d}", f"{day:02d}.{month:02d}.{year}", f"{1_000_000 + d}", f"{year} - {year + d % 9}")
    return [(text[:start] + n + text[end:], (start, k, start + len(n))) for n in numbers for k in (1, 2, 3)]


class Trees:
    """Boosted regression trees of fixed depth for the logistic loss. A node's row goes on to the right if its column is at least the node's value."""

    def __init__(self, column: np.ndarray, value: np.ndarray, leaf: np.ndarray, first: float):
        self.column, self.value, self.leaf, self.first = column, value, leaf, first

    def nodes(self, x: np.ndarray, tree: int, depth: int = DEPTH) -> np.ndarray:
        node, at = np.zeros(len(x), int), np.arange(len(x))
        for d in range(depth):
            node = 2 * node + (x[at, self.column[tree, d, node]] >= self.value[tree, d, node])
        return node

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.first)
        for tree in range(len(self.leaf)):
            margin += self.leaf[tree, self.nodes(x, tree)]
        return 1 / (1 + np.exp(-margin))


def examples(text: str) -> list[tuple[list[float], int]]:
    """Labelled candidates of one text: validated and disguised spans against all other candidates."""
    base, out = base_spans(text), []
    held = {(s, e): k for s, k, e in base}
    for span in base:
        out.append((features(text, span), 1))
        out += [(features(*decoy), 0) for decoy in decoys(text, span)]
        if (other := disguised(text, span)) is not None:
            out.append((features(*other), 1))
            new, (start, kind, end) = other
            out += [(features(new, c), 0) for c in candidates(new) if c[1] != kind and c[0] < end and start < c[2]]
    for start, kind, end in candidates(text):
        owner = next((k for (s, e), k in held.items() if s < end and start < e), None)
        if owner != kind:  # a piece of a validated span of the same kind says nothing
            out.append((features(text, (start, kind, end)), 0))
    return out


def rounded(x: np.ndarray) -> np.ndarray:
    """Whole numbers with all but their nine leading bits cleared, so that a column has a few thousand values at most."""
    spare = np.maximum(np.frexp(np.maximum(x, 0).astype(float))[1] - 9, 0)
    return (x >> spare) << spare


def cuts_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Distinct quantiles of a column from its ascending values and how many rows have them."""
    ranks = np.arange(1, BINS) * counts.sum() / BINS
    return np.unique(values[np.searchsorted(np.cumsum(counts), ranks)])


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """How many cuts of its column each value reaches."""
    return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)


def split_sums(bins: np.ndarray, label: np.ndarray, n: np.ndarray, trees: Trees, depth: int) -> np.ndarray:
    """Sums of gradient and curvature by node of the last, unfinished tree, column and bin. Whole multiples of 1 / UNIT: the order of rows does not matter."""
    done = Trees(trees.column[:-1], trees.value[:-1], trees.leaf, trees.first)
    p, node = done.probability(bins), trees.nodes(bins, -1, depth)
    both = np.rint(np.stack([label - p, p * (1 - p) + 1e-6]) * UNIT) * n
    cell = (node[:, None] * FEATURES + np.arange(FEATURES)) * (BINS + 1) + bins
    size = 2**depth * FEATURES * (BINS + 1)
    return np.stack([np.bincount(cell.ravel(), np.repeat(w, FEATURES), minlength=size) for w in both]).reshape(2, 2**depth, FEATURES, BINS + 1)


def boosted(cuts: list[np.ndarray], share: float, sums: Callable[[Trees, int], np.ndarray]) -> Trees:
    """Trees over bins, split level by level on what ``sums(trees, depth)`` says of all rows."""
    trees = Trees(np.zeros((0, DEPTH, 2**DEPTH), int), np.zeros((0, DEPTH, 2**DEPTH)), np.zeros((0, 2**DEPTH)), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    usable = np.arange(BINS + 1) < np.array([len(c) for c in cuts])[:, None]
    for _ in range(TREES):
        trees.column = np.concatenate([trees.column, np.zeros((1, DEPTH, 2**DEPTH), int)])
        trees.value = np.concatenate([trees.value, np.full((1, DEPTH, 2**DEPTH), np.inf)])
        for depth in range(DEPTH):
            g, h = sums(trees, depth) / UNIT
            left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = np.where(usable, left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1), 0)
            leaf = np.zeros(2 ** (depth + 1))
            for k in range(2**depth):
                j, at = np.unravel_index(gain[k].argmax(), gain[k].shape)
                if gain[k, j, at] > 1e-9:
                    trees.column[-1, depth, k], trees.value[-1, depth, k] = j, at + 1
                    low_g, low_h = left_g[k, j, at], left_h[k, j, at]
                else:
                    low_g, low_h = all_g[k, 0, 0], all_h[k, 0, 0]
                leaf[2 * k] = SHRINK * low_g / (low_h + 1)
                leaf[2 * k + 1] = SHRINK * (all_g[k, 0, 0] - low_g) / (all_h[k, 0, 0] - low_h + 1)
        trees.leaf = np.concatenate([trees.leaf, leaf[None]])
    return trees


def limit_of(code: np.ndarray, good: np.ndarray, n: np.ndarray) -> float:
    """Lowest score, in steps of 1 / CODES, down to which the wanted precision holds; codes are distinct, with ``good`` of ``n`` rows."""
    order = np.argsort(-code)
    limit, taken, right = 1.1, 0, 0  # 1.1: nothing of this kind was seen outside the fit
    for c, x, y in zip(code[order], good[order], n[order], strict=True):
        taken, right = taken + y, right + x
        if x and right < PRECISION * taken:
            break
        limit = max(0.5, c / CODES) if x else limit
    return limit


def coded(bins: np.ndarray, trees: Trees) -> np.ndarray:
    return np.floor(trees.probability(bins) * CODES).astype(np.int64)


def packed(trees: Trees, cuts: list[np.ndarray], limits: list[float]) -> bytes:
    """The model for values instead of bins."""
    value = np.full(trees.value.shape, np.inf)
    for at in zip(*np.nonzero(np.isfinite(trees.value)), strict=True):
        value[at] = cuts[trees.column[at]][int(trees.value[at]) - 1]
    out = io.BytesIO()
    np.savez(out, column=trees.column, value=value, leaf=trees.leaf, first=trees.first, limits=np.array(limits))
    return out.getvalue()


def fit_model(rows: pd.DataFrame) -> bytes:
    """``train`` for rows in memory: ``x (array), label, fold``."""
    if not len(rows) or rows["label"].nunique() < 2:
        return b""
    x, y, fold = rounded(np.array(rows["x"].tolist()).astype(np.int64)), rows["label"].to_numpy(), rows["fold"].to_numpy()
    learn = fold != 0 if len(np.unique(y[fold != 0])) == 2 else np.ones(len(y), bool)
    cuts = [cuts_of(*np.unique(x[learn, j], return_counts=True)) for j in range(FEATURES)]
    bins, n = binned(x, cuts), np.ones(len(y))
    trees = boosted(cuts, y[learn].mean(), lambda t, depth: split_sums(bins[learn], y[learn], n[learn], t, depth))
    codes, limits = coded(bins, trees), []
    for kind in range(len(KINDS)):
        own = (x[:, 0] == kind) & ~learn
        code, at = np.unique(codes[own], return_inverse=True)
        limits.append(limit_of(code, np.bincount(at, y[own], minlength=len(code)), np.bincount(at, minlength=len(code))))
    return packed(trees, cuts, limits)


def vectors(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def train(documents: DataFrame) -> bytes:
    """Fit on all documents.

    Examples are folded to distinct feature vectors with their number, these to distinct vectors of bins. Each level of each
    tree is one pass over these: tasks return sums of fixed size, and the driver picks the splits. Thresholds are picked
    from counts by kind and score (at most ``CODES + 1`` scores). No task or driver holds examples beyond a batch.
    """

    def seen(batches):
        for b in slices(batches):
            x, label, held = [], [], []
            for doc_id, text in zip(b["doc_id"].to_pylist(), texts_of(b["text"]), strict=True):
                found = examples(text)
                x += [row for row, _ in found]
                label += [y for _, y in found]
                held += [(zlib.crc32(text.encode("utf-8", "surrogatepass")) if doc_id is None else doc_id) % 3 == 0] * len(found)
            if x:
                whole = rounded(np.array(x).astype(np.int64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in whole], pa.binary()), pa.array(label, pa.int32()), pa.array(held, pa.bool_())], ["x", "label", "held"])

    rows = documents.select("doc_id", "text").mapInArrow(seen, "x binary, label int, held boolean")
    rows = stage(rows.groupBy("x", "label", "held").agg(F.count("*").alias("n")), "examples")
    totals = {(r["held"], r["label"]): (r["n"], r["k"]) for r in rows.groupBy("held", "label").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()}
    if len({label for _, label in totals}) < 2:
        return b""
    apart = (False, 0) in totals and (False, 1) in totals  # else everything is learned from
    learned = rows.where("NOT held") if apart else rows
    bad, good = (sum(totals.get((held, label), (0, 0))[0] for held in ((False,) if apart else (False, True))) for label in (0, 1))

    def values(batches):
        for b in batches:
            x, n = vectors(b["x"], np.int32, FEATURES), b["n"].to_numpy()
            for j in range(FEATURES):
                value, at = np.unique(x[:, j], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), j, np.int32)), pa.array(value), pa.array(np.bincount(at, n, minlength=len(value)).astype(np.int64))], ["j", "value", "n"])

    per = learned.mapInArrow(values, "j int, value int, n long").groupBy("j", "value").agg(F.sum("n").alias("n")).toPandas().sort_values(["j", "value"])
    cuts = [cuts_of(own["value"].to_numpy(), own["n"].to_numpy()) for _, own in per.groupby("j")]

    def to_bins(batches):
        for b in batches:
            x = vectors(b["x"], np.int32, FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in binned(x, cuts)], pa.binary()), pa.array(x[:, 0]), b["label"], b["held"], b["n"]], ["bins", "kind", "label", "held", "n"])

    cells = rows.mapInArrow(to_bins, "bins binary, kind int, label int, held boolean, n long").groupBy("bins", "kind", "label", "held").agg(F.sum("n").alias("n"))
    cells = stage(cells, "cells", sum(k for _, k in totals.values()))
    learned = cells.where("NOT held") if apart else cells

    def sums(trees: Trees, depth: int) -> np.ndarray:
        def run(batches):
            total = 0
            for b in batches:
                total = total + split_sums(vectors(b["bins"], np.uint8, FEATURES), b["label"].to_numpy(), b["n"].to_numpy(), trees, depth)
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        parts = learned.select("bins", "label", "n").mapInArrow(run, "sums binary").collect()  # one row of fixed size for each task
        return sum(np.frombuffer(r["sums"]) for r in parts).reshape(2, 2**depth, FEATURES, BINS + 1)

    trees = boosted(cuts, good / (good + bad), sums)

    def scores(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["kind"], pa.array(coded(vectors(b["bins"], np.uint8, FEATURES), trees)), b["label"], b["n"]], ["kind", "code", "label", "n"])

    kept = cells.where("held" if apart else "false").select("bins", "kind", "label", "n").mapInArrow(scores, "kind int, code long, label int, n long")
    seen_at = kept.groupBy("kind", "code").agg(F.sum(F.col("n") * F.col("label")).alias("good"), F.sum("n").alias("n")).toPandas()
    limits = [limit_of(*(seen_at.loc[seen_at["kind"] == kind, c].to_numpy() for c in ("code", "good", "n"))) for kind in range(len(KINDS))]
    return packed(trees, cuts, limits)


class Detector:
    def __init__(self, model: bytes):
        self.trees = None
        if model:
            with np.load(io.BytesIO(model), allow_pickle=False) as f:
                self.trees = Trees(f["column"], f["value"], f["leaf"], float(f["first"]))
                self.limits = f["limits"]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Accepted candidates, best score first, that overlap neither a base span nor each other."""
        if self.trees is None or not (found := candidates(text)):
            return []
        starts = np.array([s for s, _, _ in base])
        ends = np.maximum.accumulate(np.array([e for _, _, e in base])) if base else starts
        free = []
        for span in found:
            at = np.searchsorted(starts, span[2]) if len(starts) else 0  # base spans that start before this one ends
            if not at or ends[at - 1] <= span[0]:
                free.append(span)
        if not free:
            return []
        p = self.trees.probability(np.array([features(text, s) for s in free], float))
        ranked = sorted((-q, s) for q, s in zip(p, free, strict=True) if q >= self.limits[s[1]])
        taken: list[Span] = []
        used = np.zeros(len(text) + 1, bool) if ranked else None
        for _, s in ranked:
            if not used[s[0] : s[2]].any():
                used[s[0] : s[2]] = True
                taken.append(s)
        return taken


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def personal_data(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: ``doc_id``, base counts ``n_email, n_ip, n_card, n_phone``, ``base`` and ``spans``.

    ``base`` and ``spans`` list ``kind:start:end`` in code points, by start and then kind; ``spans`` holds the
    base spans and those the model adds. Defined cases: a null or empty text has no spans; without examples of
    both labels nothing is added; repeated rows repeat; an empty table gives no rows; other columns are ignored.
    """
    model = train(documents)

    def run(batches):
        detector = Detector(model)
        for b in slices(batches):
            base = [base_spans(t) for t in texts_of(b["text"])]
            every = [s + detector.added(t, s) for t, s in zip(texts_of(b["text"]), base, strict=True)]
            counts = [pa.array([sum(k == kind for _, k, _ in s) for s in base], pa.int64()) for kind in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *counts, pa.array(list(map(joined, base))), pa.array(list(map(joined, every)))], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redact_text(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with personal data in ``text`` replaced; all other columns pass through, null texts stay null."""
    model = train(documents)
    names = documents.columns

    def run(batches):
        detector = Detector(model)
        for b in slices(batches):
            texts = b["text"].to_pylist()
            clean = []
            for t in texts:
                base = base_spans(t) if t else []
                spans = base + detector.added(t, base) if t else []
                clean.append(redact_text(t, spans) if spans else t)
            yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if c == "text" else b[c] for c in names], names)

    return documents.mapInArrow(run, documents.schema)

