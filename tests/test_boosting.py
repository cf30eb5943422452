"""The batched booster against a plain row-by-row loop, and its study functions."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.models import boosting, learners

PLAIN = {"depth": 1, "step": 0.1, "subsample": 1.0, "colsample": 1.0, "alpha": 0.05, "lambda": 2.0, "min_child": 3.0}


def table(n=600, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.choice([0.0, 1.0, 2.0, 3.0]), rng.random()
        y = 0.05 * (a > 0.3) - 0.04 * (b >= 2) * (c > 0.5) + rng.gauss(0, 0.05)
        out.append((i, a, b, c, round(y, 3)))
    return out


def plain_ranks(v):
    order = sorted(range(len(v)), key=v.__getitem__)
    out, i = [0.0] * len(v), 0
    while i < len(order):
        j = i
        while j + 1 < len(order) and v[order[j + 1]] == v[order[i]]:
            j += 1
        for k in range(i, j + 1):
            out[order[k]] = (i + j) / 2 + 1
        i = j + 1
    return out


def plain_fit(rows, edges, p, n_trees):
    """Second-order boosting of full trees, one row at a time; scores of the rows."""
    bins = [[sum(x > e for e in es) for x, es in zip(r[1:4], edges, strict=True)] for r in rows]
    y = [r[4] for r in rows]
    score = [sum(y) / len(y)] * len(y)
    shrink = lambda g: math.copysign(max(abs(g) - p["alpha"], 0.0), g)
    gain = lambda g, h: shrink(g) ** 2 / (h + p["lambda"])
    for _ in range(n_trees):
        d = [s - t for s, t in zip(score, y, strict=True)]
        g = [x / math.sqrt(1 + x * x) for x in d] if p["loss"] == "pseudo_huber" else d
        h = [(1 + x * x) ** -1.5 for x in d] if p["loss"] == "pseudo_huber" else [1.0] * len(d)
        leaves = [list(range(len(rows)))]
        for _level in range(p["depth"]):
            after = []
            for leaf in leaves:
                G, H, best, split = sum(g[i] for i in leaf), sum(h[i] for i in leaf), 1e-12, None
                for f in range(3):
                    for cut in range(len(edges[f])):
                        left = [i for i in leaf if bins[i][f] <= cut]
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        if hl < p["min_child"] or H - hl < p["min_child"]:
                            continue
                        value = gain(gl, hl) + gain(G - gl, H - hl) - gain(G, H)
                        if value > best + 1e-12:
                            best, split = value, (f, cut)
                after += [leaf] if split is None else [[i for i in leaf if bins[i][split[0]] <= split[1]], [i for i in leaf if bins[i][split[0]] > split[1]]]
            leaves = after
        for leaf in leaves:
            step = -shrink(sum(g[i] for i in leaf)) / (sum(h[i] for i in leaf) + p["lambda"]) * p["step"]
            for i in leaf:
                score[i] += step
    return score


@pytest.mark.parametrize("loss, depth, trees, close", [("squared", 1, 15, 1e-9), ("squared", 3, 8, 1e-9), ("pseudo_huber", 1, 15, 1e-4), ("pseudo_huber", 2, 8, 1e-4)])
def test_fits_equal_a_plain_loop(spark, loss, depth, trees, close):
    rows, p = table(), PLAIN | {"loss": loss, "depth": depth}
    d = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    fit = {"fit": "x", "train": "all", "judge": {"all": "all"}, "n_trees": trees, "features": ["a", "b", "c"], "params": p}
    got = boosting.study(d, ["a", "b", "c"], "y", {"all": F.lit(True)}, [fit]).first()
    edges = boosting.bin_edges(d, ["a", "b", "c"], boosting.bins_for(3))
    score = plain_fit(rows, edges, p, trees)
    ic = np.corrcoef(plain_ranks([round(s, 9) for s in score]), plain_ranks([r[4] for r in rows]))[0, 1]
    assert got.n == len(rows) and abs(got.ic - ic) < max(close, 1e-3 if loss != "squared" else close)
    assert abs(got["mean"] - sum(score) / len(score)) < close and abs(got.spread - float(np.std(score))) < close
    assert got.accuracy == pytest.approx(sum((s > 0) == (r[4] > 0) if r[4] else s == 0 for s, r in zip(score, rows, strict=True)) / len(rows), abs=0.02)


def test_stumps_score_rows_like_the_fit(spark):
    d = spark.createDataFrame(table(), "id long, a double, b double, c double, y double")
    fit = {"fit": "x", "train": "all", "judge": {"all": "all"}, "n_trees": 20, "features": ["a", "b", "c"], "params": boosting.STUMPS | {"min_child": 5.0}}
    got = boosting.study(d, ["a", "b", "c"], "y", {"all": F.lit(True)}, [fit]).first()
    stumps = json.loads(got.stumps)
    base = sum(r[4] for r in table()) / 600
    score = [base + sum((s[2] if s[0] is None or r["abc".index(s[0]) + 1] <= s[1] else s[3]) for s in stumps) for r in table()]
    assert len(stumps) == got.n_trees == 20 and sum(score) / 600 == pytest.approx(got["mean"], abs=1e-9) and float(np.std(score)) == pytest.approx(got.spread, abs=1e-9)


def test_scout_stops_where_the_held_out_correlation_is_best(spark):
    d = spark.createDataFrame(table(900), "id long, a double, b double, c double, y double")
    groups = {"pre": F.col("id") < 500, "val": (F.col("id") >= 500) & (F.col("id") < 700), "train": F.col("id") < 700, "test": F.col("id") >= 700}
    fit = {"fit": "x", "train": "train", "judge": {"val": "val", "test": "test"}, "scout": ["pre", "val", 10], "n_trees": 200, "features": ["a", "b", "c"], "params": boosting.STUMPS}
    rows = boosting.study(d, ["a", "b", "c"], "y", groups, [fit]).collect()
    assert {r.role for r in rows} == {"val", "test"} and len({r.n_trees for r in rows}) == 1 and 1 <= rows[0].n_trees <= 200
    again = boosting.study(d.repartition(7), ["a", "b", "c"], "y", groups, [fit]).collect()
    assert sorted((r.role, r.n_trees, r.ic) for r in rows) == sorted((r.role, r.n_trees, r.ic) for r in again)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_keyed_positions_are_a_bijection(n):
    orders = [boosting.keyed_position(n, np.full(n, r), np.arange(n)).tolist() for r in range(1, 6)]
    assert all(sorted(o) == list(range(n)) for o in orders) and (n < 17 or len({tuple(o) for o in orders}) == 5)


def test_informative_columns_lose_their_correlation_when_shuffled(spark):
    rows = [(i + 1, *r[1:]) for i, r in enumerate(table(800))]
    d = spark.createDataFrame(rows, "row_index long, a double, b double, c double, y double")
    ics = {r.replicate: r.ic for r in learners.refit_ics(d, d, ["a", "b", "c"], ["a", "b"], "y", "row_index", n=6, n_trees=30, depth=2).collect()}
    assert sorted(ics) == list(range(7)) and ics[0] > max(v for k, v in ics.items() if k)


def test_empty_and_small_groups(spark):
    d = spark.createDataFrame(table(50), "id long, a double, b double, c double, y double").withColumn("date", F.when(F.col("id") < 25, F.lit("2001-01-01")).otherwise("2002-01-01").cast("date"))
    got = learners.walk_forward_ics(d, {"all": ["a", "b", "missing"]}, [((2001,), (2002,)), ((1999,), (2001,))], "y", n_trees=3)
    assert [(r.window, r.ic) for r in got.collect()] == [(1, None)]  # too few rows; a window without training rows gives none
    assert learners.walk_forward_ics(d.limit(0), {"all": ["a"]}, [((2001,), (2002,))], "y", n_trees=2).count() == 0
