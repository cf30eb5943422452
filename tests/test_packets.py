"""Resampling by packets of draws: nothing is lost in packing, results equal plain loops, and traffic stays below a byte a draw."""

import numpy as np
import pandas as pd
import pytest

from pulsegrid.operators import resample


def unpack(batch):
    rows = zip(*(batch.column(c).to_pylist() for c in ("tile", "size", "code")))
    return np.concatenate([np.empty(0, np.int64), *(tile * resample.TILE + resample.unpacked(code, size) for tile, size, code in rows)])


@pytest.mark.parametrize("at", [[], [0], [0, 0, 0], [255, 510, 511], [65_535, 65_536, 65_536 * 3 + 254], [7, 7 + 254, 7 + 254 + 255, 70_000, 2**40]])
def test_packets_give_back_every_draw(at):
    assert unpack(resample.packed(np.array(at, np.int64), 1, 5)).tolist() == at


def test_packets_take_less_than_a_byte_a_draw(spark):
    n = 900_000
    size = sum(len(r.code) for r in resample.draw_packets(spark, 2, n // 5, 5, n - 4).collect())
    assert 0 < size < 2 * n // 5


def test_hash_equals_the_expression(spark):
    from pyspark.sql import functions as F

    p = resample.PRIME
    rows = [0, 1, 2, p - 1, p, p + 1, 3 * p + 7, 2**40]
    want = spark.createDataFrame([(r,) for r in rows], "r long").select(resample.mix(F.col("r"), F.lit(9)).alias("h")).collect()
    assert resample.mix_of(np.array(rows), 9).tolist() == [r.h for r in want]


@pytest.mark.parametrize("n, block", [(66_003, 5), (70_000, 7), (20, 30)])
def test_block_bootstrap_equals_a_plain_loop(spark, n, block):
    value = np.random.default_rng(3).normal(5, 1, n)
    null = np.arange(n) % 11 == 3
    rows = [(i + 1, None if null[i] else float(value[i])) for i in range(n)]
    got = {r.b: r.sharpe for r in resample.block_bootstrap(spark.createDataFrame(rows, "i long, v double"), "i", "v", block, 3).collect()}
    slots = np.arange(1, n + 1, block)
    assert len(got) == 3
    for b in got:
        start = resample.mix_of(slots, b) % max(1, n - block + 1)
        at = start[:, None] + np.arange(block)
        at = at[(slots[:, None] + np.arange(block) <= n) & (at < n)]
        v = value[at[~null[at]]]
        assert got[b] == pytest.approx(v.mean() / v.std() * 252**0.5, rel=1e-9)


def test_constant_series_have_no_sharpe(spark):
    d = spark.createDataFrame([(i, 0.1) for i in range(1, 101)], "i long, v double")
    assert resample.block_bootstrap(d, "i", "v", 5, 4).count() == 0


def test_permutation_pairs_travel_in_packets(spark):
    rankdata = lambda v: pd.Series(v).rank().to_numpy()

    n = 70_001  # two tiles
    rng = np.random.default_rng(5)
    pred, actual = rng.integers(0, 500, n) / 7.0, rng.normal(size=n)
    d = spark.createDataFrame(list(zip(range(1, n + 1), pred.tolist(), actual.tolist())), "i long, p double, a double")
    got = resample.permutation_test(d, "i", "p", "a", 3).first()
    rp, ra = rankdata(pred), rankdata(actual)
    ics = [np.corrcoef(rp, ra[resample.shuffled_to(np.arange(n), b, n)])[0, 1] for b in (1, 2, 3)]
    assert (got.n_permutations, got.null_ic_mean, got.null_ic_std) == (3, pytest.approx(np.mean(ics)), pytest.approx(np.std(ics)))
    ranked = spark.createDataFrame(list(zip(range(1, n + 1), rp.tolist())), "i long, r double")
    sent = resample.sent_packets(ranked, "i", "r", n, 3).collect()
    assert sum(r.n for r in sent) == 3 * n and sum(len(r.code) + len(r.value) for r in sent) < 6 * 3 * n


def test_bootstrap_rows_are_counted_from_packets(spark):
    n = 70_001  # two tiles
    d = spark.createDataFrame([(i + 1, float(i % 90)) for i in range(n)], "i long, p double")
    got = resample.bootstrap_draws(d, "i", n, 2).toPandas()
    for b in (1, 2):
        at, times = np.unique(resample.mix_of(np.arange(1, n + 1), b) % n, return_counts=True)
        own = got[got["b"] == b].sort_values("i")
        assert (own["i"].tolist(), own["_times"].tolist()) == ((at + 1).tolist(), times.tolist()) and (own["p"] == at % 90).all()
