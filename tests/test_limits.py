"""Ordered operators beyond the sizes that narrow keys, hashes and blocks would hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import equity, ordering, resample

BIG = 2**40


def test_order_of_large_ids(spark):
    rows = [(dt.date(2024, 1, 1 + i % 5), (i * 7919 % 500) * BIG + i, float(i % 11 - 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "day date, id long, v double")
    out = ordering.running(df, ["day", "id"], equity.sequence_key("day", "id"), sums={"s": "v"}, n_buckets=7).collect()
    total, want = 0.0, {}
    for day, i, v in sorted(rows):
        total += v
        want[(day, i)] = total
    assert {(r.day, r.id): r.s for r in out} == want


def test_hash_tells_far_rows_apart(spark):
    p = resample.PRIME
    rows = [5, 5 + p, 5 + 2 * p, p * p - 1]
    df = spark.createDataFrame([(r,) for r in rows], "r long").select("r", resample.mix(F.col("r"), F.lit(3)).alias("h"))
    got = {r.r: r.h for r in df.collect()}
    half = lambda row, b: (lambda h: (h * h + b * 40692) % p)((lambda h: (h * h + h * 1103515245) % p)((row % p * 48271 + b * 69621 + 11) % p))
    assert got == {r: half(r, 3) * p + half(r + r // p, 3) for r in rows} and len(set(got.values())) == 4
    assert max(got.values()) > 2**32


@pytest.mark.parametrize("size", [20, 101, 350])
def test_windows_longer_than_a_block(spark, size):
    df = spark.range(1, 1001).select(F.col("id").alias("i"))
    out = equity.rolling_rows(df, "i", size, {"n": F.count("i"), "lo": F.min("i")}, block=100).collect()
    assert {r.i: (r.n, r.lo) for r in out} == {i: (min(i, size), max(1, i - size + 1)) for i in range(1, 1001)}
