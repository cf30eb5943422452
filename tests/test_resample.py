"""Short series in the block bootstrap."""

import pytest

from pulsegrid.operators import resample


@pytest.mark.parametrize("n", [2, 19, 20, 21])
def test_short_series_have_no_sharpe(spark, n):
    d = spark.createDataFrame([(i, float(i * i % 7) - 1.5) for i in range(1, n + 1)], "row_index long, pnl double")
    boot = resample.block_bootstrap(d, "row_index", "pnl", 5, 30)
    r = resample.sharpe_interval(boot).first()
    if n < 20:
        assert boot.count() == 0 and (r.n_bootstrap, r.sharpe_mean, r.sharpe_ci_low, r.sharpe_ci_high) == (0, None, None, None)
    else:
        assert r.n_bootstrap == 30 and r.sharpe_mean is not None
    if n == 21:
        assert r.sharpe_ci_low < r.sharpe_mean < r.sharpe_ci_high
