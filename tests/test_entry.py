"""Registry contract, and a sample of queries against DuckDB on the smallest tables."""

import re
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["w06_pct_change", "w08_atr_wilder", "w12_rolling_percentile", "w01_w03_attention_before_open", "w04_w05_lagged_post_features", "j04_asof_series",
          "j09_clear_of_events", "j16_pairwise_correlation", "a11_quartile_returns", "m01_spearman_pooled_bucketed", "m03_permutation_test", "m11_granger_lag1_bucketed",
          "m18_stump_scores", "f01_symbol_mentions", "f12_signal_rule", "u02_merge_feeds_by_period", "e2_calendar_panel", "t01_stream_daily_mentions", "s08_upsert_panel"]


def test_every_check_has_a_query():
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 230
    assert all(re.match(r"^[a-z]\d{2}[ab]?_|^e[123]_|^op\d+_|^pipeline$", n) for n in q)


def test_entry_runs(spark):
    assert e.entry(spark).count() == 1


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    df = e.queries()[name](spark, SF)
    cur = con.execute(e.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda row: tuple(str(v) for v in row)
    got, want = sorted(key(r) for r in df.select(*cols).collect()), sorted(key(r) for r in cur.fetchall())
    assert got == want
