"""Bucketed scans against pandas, with a value and a key that hold a third of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import equity, ic
from pulsegrid.operators.ordering import average_rank, exact_quantiles, row_index, running


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(3)
    n = 3000
    x = np.where(rng.random(n) < 0.33, 0.0, np.round(rng.normal(size=n), 2))
    y = 0.3 * x + rng.normal(size=n)
    g = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n))
    return pd.DataFrame({"id": np.arange(n), "g": g, "x": x, "y": y})


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("buckets", [None, 1, 7, 64])
def test_average_rank_matches_pandas(df, pdf, buckets):
    got = average_rank(df, "x", ["g"], n_buckets=buckets).toPandas().set_index(["g", "x"])["rank_avg"]
    want = pdf.assign(r=pdf.groupby("g")["x"].rank()).groupby(["g", "x"])["r"].first()
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


@pytest.mark.parametrize("buckets", [None, 16])
def test_exact_quantiles(df, pdf, buckets):
    got = exact_quantiles(df, "x", [0.0, 0.1, 0.5, 0.975, 1.0], ["g"], names=list("abcde"), n_buckets=buckets).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["x"].quantile([0.0, 0.1, 0.5, 0.975, 1.0]).unstack()
    assert np.allclose(got[list("abcde")].to_numpy(), want.to_numpy())


@pytest.mark.parametrize("buckets", [None, 16])
def test_row_index_and_running(df, pdf, buckets):
    s = pdf.sort_values(["x", "id"]).reset_index(drop=True)
    by = F.col("x")
    idx = row_index(df, ["x", "id"], by, n_buckets=buckets).toPandas().sort_values("row_index")
    assert idx["id"].tolist() == s["id"].tolist()
    r = running(df, ["x", "id"], by, {"cs": "y"}, {"mx": "y"}, {"mn": "y"}, n_buckets=buckets).toPandas().sort_values(["x", "id"])
    assert np.allclose(r["cs"], s["y"].cumsum())
    assert np.allclose(r["mx"], s["y"].cummax()) and np.allclose(r["mn"], s["y"].cummin())


@pytest.mark.parametrize("buckets", [None, 16])
def test_spearman_matches_rank_correlation(df, pdf, buckets):
    got = {r.g: r.ic for r in ic.spearman(df, "x", "y", ["g"], n_buckets=buckets).collect()}
    for g, p in pdf.groupby("g"):
        assert got[g] == pytest.approx(p["x"].rank().corr(p["y"].rank()))


def test_small_group_rules(spark):
    d = spark.createDataFrame([("a", float(i), float(i)) for i in range(4)] + [("b", 1.0, float(i)) for i in range(30)], "g string, x double, y double")
    null = {r.g: r.ic for r in ic.spearman(d, "x", "y", ["g"]).collect()}
    zero = {r.g: r.ic for r in ic.spearman(d, "x", "y", ["g"], min_n=5, on_small=0.0).collect()}
    assert null == {"a": None, "b": None} and zero == {"a": 0.0, "b": 0.0}


def test_rolling_rows_crosses_blocks(spark):
    d = spark.createDataFrame([(i, float(i % 7)) for i in range(1, 201)], "i long, v double")
    got = equity.rolling_rows(d, "i", 20, {"m": F.avg("v")}, block=32).toPandas().sort_values("i")
    want = pd.Series([float(i % 7) for i in range(1, 201)]).rolling(20, min_periods=1).mean()
    assert np.allclose(got["m"], want)


def test_cusum_equals_the_recursion(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    d = spark.createDataFrame(rows, "id long, pred double, actual double")
    got = equity.cusum(d, ["id"], F.col("id"), "pred", "actual", n_buckets=8).orderBy("id").toPandas()["cusum"]
    s = np.where(np.array([a * b for _, a, b in rows]) > 0, 1.0, -1.0)
    z, c, want = (s - s.mean()) / max(s.std(), 0.1), 0.0, []
    for v in z:
        c = max(0.0, c - v + 0.5)
        want.append(c)
    assert np.allclose(got, want)
