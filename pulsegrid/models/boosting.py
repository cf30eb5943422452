"""Histogram boosting of many fits at once, from one table of binned counts.

A split only asks in which bin a feature lies, so rows with equal bins are interchangeable: Spark bins the rows and
adds them up per group of rows and cell (one combination of bins), with the target in narrow strips. A cell's number
of rows, sums of the target and sums of its ranks are all that gradients, leaf values and rank correlations need, and
there are at most ``CELLS`` cells whatever the number of rows. Fits (feature sets, windows, replicates of a shuffle,
shares of the days) are rows of a small table; each takes the cells of its groups to one task of its own, so a study
of a hundred fits is one Spark plan and not a hundred.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.ordering import average_rank
from pulsegrid.session import settle

#: Most cells of a study; the bins per feature follow from it. Strips of the (inverse hyperbolic sine of the) target.
CELLS, MOST_BINS, STRIPS = 1 << 16, 32, 16

#: Parameters of the boosters that the studies ask for.
STUMPS = {"loss": "pseudo_huber", "depth": 1, "step": 0.02, "subsample": 0.7, "colsample": 0.8, "alpha": 0.1, "lambda": 5.0, "min_child": 20.0}
TREES = {"loss": "squared", "depth": 4, "step": 0.05, "subsample": 0.8, "colsample": 0.8, "alpha": 0.1, "lambda": 1.0, "min_child": 10.0}
SOURCE_STUMPS = STUMPS | {"step": 0.05, "alpha": 0.0}
HORIZONS = {"1d": {"lambda": 3.0, "min_child": 15.0}, "3d": {"lambda": 1.0, "min_child": 10.0}, "5d": {"lambda": 5.0, "min_child": 20.0}}


def bins_for(n_features: int) -> int:
    """Bins per feature so that all combinations stay within ``CELLS``."""
    return max(2, min(MOST_BINS, int(CELLS ** (1.0 / n_features) + 1e-9)))


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Inner edges per feature: approximate quantiles of the values, nulls as zero. A few numbers per feature."""
    probs = [i / bins for i in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), probs, 10_000).alias(c) for c in features)).first()
    return [sorted(set(found[c] or [])) for c in features]


def bin_of(feature: str, edges: Sequence[float]) -> Column:
    """How many edges lie below the value."""
    x = F.coalesce(F.col(feature).cast("double"), F.lit(0.0))
    above = [F.when(x > e, 1).otherwise(0) for e in edges]
    return sum(above[1:], above[0]) if above else F.lit(0)


def code(features: Sequence[str], edges: Sequence[Sequence[float]], bins: int, only: Sequence[str] | None = None) -> Column:
    """The cell of a row; of features not in ``only`` nothing is added."""
    parts = [bin_of(f, e) * bins**k for k, (f, e) in enumerate(zip(features, edges, strict=True)) if only is None or f in only]
    return sum(parts[1:], parts[0]).cast("long") if parts else F.lit(0).cast("long")


def cell_table(rows: DataFrame, target: str, weight: str | None = None) -> DataFrame:
    """``group, cell, strip, n, w, wy, wyy, up, down, ranks, squares`` from rows with ``group``, ``cell`` and the target.

    ``ranks`` and ``squares`` add the target's average rank within its group and that rank squared.
    """
    y = F.col(target).cast("double")
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    counted = rows.where(y.isNotNull()).groupBy("group", "cell", y.alias("y")).agg(F.count("*").alias("n"), F.sum(w).alias("w"))
    ties = counted.groupBy("group", "y").agg(F.sum("n").alias("n"))
    ranks = average_rank(ties, "y", ["group"], weight="n").select("group", "y", F.col("rank_avg").alias("rank"))
    return counted.join(ranks, ["group", "y"]).groupBy("group", "cell", F.floor(F.asinh("y") * STRIPS).alias("strip")).agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("wyy"),
        F.sum(F.when(F.col("y") > 0, F.col("n")).otherwise(0)).alias("up"), F.sum(F.when(F.col("y") < 0, F.col("n")).otherwise(0)).alias("down"),
        F.sum(F.col("n") * F.col("rank")).alias("ranks"), F.sum(F.col("n") * F.col("rank") * F.col("rank")).alias("squares"))


def slopes(loss: str, apart: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean gradient and curvature over a strip whose residuals have mean ``apart`` and variance ``spread``."""
    if loss == "squared":
        return apart, np.ones_like(apart)
    s = 1.0 + apart * apart
    return apart / np.sqrt(s) - 1.5 * spread * apart * s**-2.5, s**-1.5


def shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def rank_correlation(score: np.ndarray, n: np.ndarray, ranks: np.ndarray, squares: float) -> float:
    """Spearman correlation of a score per cell with the target, from the target's summed ranks per cell."""
    total = n.sum()
    _, tie = np.unique(score, return_inverse=True)
    held = np.bincount(tie, n)
    own = np.cumsum(held) - held + (held + 1) / 2
    mean = (total + 1) / 2
    a, b = (held * own * own).sum() - total * mean * mean, squares - total * mean * mean
    return float((own[tie] * ranks).sum() - total * mean * mean) / float(np.sqrt(a * b)) if a > 1e-9 and b > 1e-9 else float("nan")


class Cells:
    """The cells of one group: bins per feature and statistics."""

    def __init__(self, rows: dict[str, np.ndarray], n_features: int, bins: int):
        self.cell, self.at = np.unique(rows["cell"], return_inverse=True)
        self.bins = (self.cell[:, None] // bins ** np.arange(n_features)) % bins
        add = lambda c: np.bincount(self.at, rows[c], len(self.cell))
        self.n, self.ranks, self.up, self.down = add("n"), add("ranks"), add("up"), add("down")
        self.squares = float(rows["squares"].sum())
        self.count, self.w = rows["n"], rows["w"]
        self.mean = rows["wy"] / rows["w"]
        self.spread = np.maximum(rows["wyy"] / rows["w"] - self.mean**2, 0.0)


class Tree:
    """Splits of a full tree by heap position (feature -1: none) and leaf values."""

    def __init__(self, depth: int):
        self.feature, self.bin = np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, np.int64)
        self.value = np.zeros(1 << depth)
        self.cover = np.zeros(1 << depth)

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        for _ in range(len(self.value).bit_length() - 1):
            f = self.feature[node]
            right = (f >= 0) & (bins[np.arange(len(bins)), f] > self.bin[node])
            node = 2 * node + 1 + right
        return node - (len(self.value) - 1)


def grow(cells: Cells, g: np.ndarray, h: np.ndarray, allowed: np.ndarray, bins: int, p: dict) -> tuple[Tree, np.ndarray]:
    """One tree, level by level, from gradient and curvature sums per cell; also the leaf of every cell."""
    tree, node = Tree(p["depth"]), np.zeros(len(cells.cell), np.int64)
    gain_of = lambda a, b: shrunk(a, p["alpha"]) ** 2 / (b + p["lambda"])
    for level in range(p["depth"]):
        width, first = 1 << level, (1 << level) - 1
        best, which, cut = np.full(width, 1e-12), np.full(width, -1), np.zeros(width, np.int64)
        for f in allowed:
            key = (node - first) * bins + cells.bins[:, f]
            gs, hs = (np.bincount(key, x, width * bins).reshape(width, bins) for x in (g, h))
            left_g, left_h = np.cumsum(gs, 1), np.cumsum(hs, 1)
            all_g, all_h = left_g[:, -1:], left_h[:, -1:]
            gain = gain_of(left_g, left_h) + gain_of(all_g - left_g, all_h - left_h) - gain_of(all_g, all_h)
            gain[(left_h < p["min_child"]) | (all_h - left_h < p["min_child"])] = -1.0
            at = gain.argmax(1)
            top = gain[np.arange(width), at]
            better = top > best
            best[better], which[better], cut[better] = top[better], f, at[better]
        tree.feature[first : first + width], tree.bin[first : first + width] = which, cut
        f = which[node - first]
        node = 2 * node + 1 + ((f >= 0) & (cells.bins[np.arange(len(node)), f] > cut[node - first]))
    leaf = node - (len(tree.value) - 1)
    gs, hs = (np.bincount(leaf, x, len(tree.value)) for x in (g, h))
    tree.value, tree.cover = np.where(hs > 0, -shrunk(gs, p["alpha"]) / (hs + p["lambda"]), 0.0) * p["step"], hs
    return tree, leaf


def boost(train: Cells, judged: dict[str, Cells], p: dict, n_trees: int, patience: int | None = None, stop_on: str | None = None, seed: int = 42):
    """Trees, base value, the score per cell of every judged group, and its correlation after every tree.

    With ``patience``, boosting stops after so many trees without a better correlation on ``stop_on``.
    """
    rng = np.random.default_rng(seed)
    n_features, bins = train.bins.shape[1], p["bins"]
    features = np.array(p["features"])
    base = float((train.mean * train.w).sum() / train.w.sum())
    scores = {k: np.full(len(c.cell), base) for k, c in judged.items()}
    score, trees, course = np.full(len(train.cell), base), [], {k: [] for k in judged}
    best, since = -np.inf, 0
    for _ in range(n_trees):
        gradient, curve = slopes(p["loss"], score[train.at] - train.mean, train.spread)
        kept = rng.binomial(train.count, p["subsample"]) / train.count * train.w
        g, h = (np.bincount(train.at, kept * x, len(train.cell)) for x in (gradient, curve))
        allowed = np.sort(rng.permutation(features)[: max(1, round(p["colsample"] * len(features)))])
        tree, leaf = grow(train, g, h, allowed, bins, p)
        trees.append(tree)
        score = score + tree.value[leaf]
        for k, c in judged.items():
            scores[k] = scores[k] + tree.value[tree.leaf(c.bins)]
        if patience:
            c = judged[stop_on]
            ic = rank_correlation(scores[stop_on], c.n, c.ranks, c.squares)
            course[stop_on].append(ic)
            ic = -1.0 if np.isnan(ic) else ic
            best, since = (ic, 0) if ic > best else (best, since + 1)
            if since >= patience:
                break
    return trees, base, scores, course


FIT = "fit string, role string, n_trees int, n long, ic double, accuracy double, positive double, mean double, spread double, stumps string"


def fit_all(cells: DataFrame, fits: Sequence[dict], features: Sequence[str], bins: int, edges: Sequence[Sequence[float]]) -> DataFrame:
    """One row per fit and judged group (``FIT``), all fits in one plan.

    ``stumps`` (depth one) lists feature, threshold, values left and right of it, and the curvature on either side.

    A fit names its ``train`` group, ``judge`` groups (by role) and its parameters: ``features`` (names), ``params``, ``n_trees``
    and perhaps ``scout`` = (group to learn from, group to stop on, patience), which first chooses the number of trees. Fits
    without any training row give no rows.
    """
    spark = cells.sparkSession
    asked = []
    for f in fits:
        spec = json.dumps({**f, "params": {**f["params"], "bins": bins, "features": [list(features).index(x) for x in f["features"]]}})
        groups = {f["train"], *f["judge"].values(), *(f["scout"][:2] if f.get("scout") else ())}
        asked += [(f["fit"], g, spec) for g in sorted(groups)]
    wanted = spark.createDataFrame(asked, "fit string, group string, spec string")
    names = ("cell", "n", "w", "wy", "wyy", "up", "down", "ranks", "squares")

    def stump(t: Tree) -> list:
        f, b = int(t.feature[0]), int(t.bin[0])
        return [features[f] if f >= 0 else None, edges[f][b] if f >= 0 else None, *map(float, t.value), *map(float, t.cover)]

    def run(key, table):
        spec = json.loads(table["spec"][0].as_py())
        of, group = {}, np.array(table["group"].to_pylist())
        columns = {c: table[c].to_numpy() for c in names}
        order = np.lexsort((table["strip"].to_numpy(), columns["cell"]))  # the same in every run
        for g in set(group.tolist()):
            pick = order[group[order] == g]
            of[g] = Cells({c: v[pick] for c, v in columns.items()}, len(features), bins)
        out: dict[str, list] = {c.split()[0]: [] for c in FIT.split(", ")}
        if spec["train"] in of:
            n_trees, p = spec["n_trees"], spec["params"]
            if spec.get("scout") and spec["scout"][0] in of and spec["scout"][1] in of:
                learn, stop, patience = spec["scout"]
                course = boost(of[learn], {stop: of[stop]}, p, n_trees, patience, stop)[3][stop]
                n_trees = 1 + int(np.nanargmax(course)) if not np.all(np.isnan(course)) else 1
            judged = {role: of[g] for role, g in spec["judge"].items() if g in of}
            trees, base, scores, _ = boost(of[spec["train"]], judged, p, n_trees)
            stumps = json.dumps([stump(t) for t in trees]) if p["depth"] == 1 else None
            for role, c in judged.items():
                s, n = scores[role], c.n.sum()
                mean = float((s * c.n).sum() / n)
                right = float((c.up * (s > 0) + c.down * (s < 0) + (c.n - c.up - c.down) * (s == 0)).sum() / n)
                row = (spec["fit"], role, n_trees, int(n), rank_correlation(s, c.n, c.ranks, c.squares), right, float((c.n * (s > 0)).sum() / n), mean, float(np.sqrt(max(0.0, (c.n * (s - mean) ** 2).sum() / n))), stumps)
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
        kinds = {"n_trees": pa.int32(), "n": pa.int64()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.string() if c in ("fit", "role", "stumps") else pa.float64())) for c, v in out.items()})

    held = cells.join(F.broadcast(wanted), "group")  # a few rows per fit
    return held.groupBy("fit").applyInArrow(run, FIT).withColumn("ic", F.when(~F.isnan("ic"), F.col("ic")))


def keyed_position(n: int, replicate: np.ndarray, at: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Where a replicate's keyed bijection of [0, n) sends each position: a small Feistel network, walked until it falls inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(rounds):
            z = right + keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64((r + 1) * 0xD1B54A32D192ED03 % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, (left ^ (z >> np.uint64(31))) & mask
        return (left << np.uint64(half)) | right

    keys = replicate.astype(np.uint64)
    out = once(at.astype(np.uint64), keys)
    while (outside := out >= n).any():
        out[outside] = once(out[outside], keys[outside])
    return out.astype(np.int64)


def shuffled_cells(rows: DataFrame, n: int, n_replicates: int) -> DataFrame:
    """``group, cell, target`` of every replicate: each row (``at`` in [0, n), ``kept``, ``moved``, ``target``) with the ``moved`` part of another row."""

    def run(batches):
        for b in batches:
            at = b["at"].to_numpy()
            for r in range(1, n_replicates + 1):
                to = keyed_position(n, np.full(len(at), r), at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r, np.int32)), pa.array(to), b["kept"], b["target"]], ["r", "to", "kept", "target"])

    sent = rows.select("at", "kept", "target").mapInArrow(run, "r int, to long, kept long, target double")
    given = rows.select(F.col("at").alias("to"), "moved")
    return sent.join(given, "to").select(F.concat(F.lit("replicate "), F.col("r").cast("string")).alias("group"), (F.col("kept") + F.col("moved")).alias("cell"), "target")


def grouped(rows: DataFrame, groups: dict[str, Column], features: Sequence[str], edges, bins: int, keep: Sequence[str]) -> DataFrame:
    """A copy of every row for each group whose condition it meets, with its cell."""
    named = F.explode(F.filter(F.array(*(F.when(c, F.lit(g)) for g, c in groups.items())), lambda g: g.isNotNull())).alias("group")
    return rows.select(named, code(features, edges, bins).alias("cell"), *keep)


def study(rows: DataFrame, features: Sequence[str], target: str, groups: dict[str, Column], fits: Sequence[dict], weight: str | None = None) -> DataFrame:
    """``fit_all`` over groups given as conditions on the rows."""
    features = list(features)
    bins = bins_for(len(features))
    kept = settle(rows.where(F.col(target).isNotNull()), "study")
    edges = bin_edges(kept, features, bins)
    cells = settle(cell_table(grouped(kept, groups, features, edges, bins, [target, *([weight] if weight else [])]), target, weight), "cells")
    return fit_all(cells, fits, features, bins, edges)
