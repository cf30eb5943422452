import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import signals as sig, special, text as tx
from pulsegrid.functions.exprs import clamp, nan_to_null
from pulsegrid.models import lexicon, stumps as st
from pulsegrid.operators import filters, joins, ranking, resample, setops
from pulsegrid.operators.windows import mention_growth


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])


def test_position_cap_and_missing_range(spark):
    d = spark.createDataFrame([(100.0, 0.1, 1.0), (100.0, 5.0, 0.5), (100.0, 0.0, 1.0), (100.0, None, 1.0)], "close double, atr_14 double, regime_multiplier double")
    r = sig.position_size(d, 10000.0).collect()
    assert r[0].n_shares == 25 and r[0].pct_of_portfolio == 0.25  # capped at a quarter
    assert r[1].n_shares == 20 and r[1].risk_dollars == 100.0
    assert r[2].n_shares == 0 and r[3].n_shares == 0 and r[3].position_dollars == 0.0


def test_risk_at_the_stop_never_exceeds_the_ceiling(spark):
    d = spark.createDataFrame([(50.0, 0.6, 1.0, "bull", 1, False), (50.0, 3.0, 1.0, "bull", 1, False), (50.0, 1.0, 0.0, "bear", 3, True)],
                              "close double, atr_14 double, confidence double, regime string, signal_rank int, below_ma20 boolean")
    for r in sig.risk_budget_position(d, 100000.0).collect():
        assert r.risk_dollars <= 750.0 and -0.12 <= r.stop_pct <= -0.04


def test_slippage_is_clamped(spark):
    r = spark.createDataFrame([(1.0,), (9.0,)], "g double").select(sig.slippage("g").alias("s")).collect()
    assert [x.s for x in r] == [0.0015, 0.0025]


def test_exit_priority(spark):
    pos = spark.createDataFrame([("A", 100.0, dt.date(2024, 1, 1), -0.05), ("B", 100.0, dt.date(2024, 1, 1), -0.05), ("C", 100.0, dt.date(2024, 1, 1), -0.05),
                                 ("D", 100.0, dt.date(2030, 1, 1), -0.05), ("E", 100.0, dt.date(2024, 1, 1), None)], "ticker string, entry_price double, stop_date date, stop_pct double")
    px = spark.createDataFrame([("A", 94.0), ("B", 120.0), ("C", 101.0), ("D", 101.0), ("E", 93.0)], "ticker string, price double")
    r = {x.ticker: x.exit_reason for x in sig.check_exits(pos, px, "2024-01-05").collect()}
    assert r == {"A": "stop_loss", "B": "take_profit_cap", "C": "hold_period_expired", "E": "hold_period_expired"}


def test_longer_horizon_wins_and_noise_is_dropped(spark):
    d = spark.createDataFrame([("a", -0.02, 0.03, 0.0, 10.0), ("b", 0.02, 0.0, -0.02, 10.0), ("c", 0.001, 0.002, 0.003, 10.0), ("d", 0.01, 0.0, 0.0, 10.0)],
                              "ticker string, pred_1d double, pred_3d double, pred_5d double, close double")
    r = {x.ticker: (x.signal, x.horizon, x.hold_days) for x in sig.classify_signals(d).collect()}
    assert r == {"a": ("BULLISH", "3D", 3), "b": ("BULLISH", "1D", 1), "d": ("NEUTRAL", "5D", 5)}


def test_clamp_keeps_null_and_nan_becomes_null(spark):
    d = spark.createDataFrame([(None,), (5.0,), (-5.0,)], "x double").select(clamp("x", -1.0, 1.0).alias("x"))
    assert [r.x for r in d.collect()] == [None, 1.0, -1.0]
    n = nan_to_null(spark.createDataFrame([(math.nan,), (math.inf,), (1.0,)], "x double"))
    assert [r.x for r in n.collect()] == [None, None, 1.0]


def test_symbols_are_whole_words_and_case_sensitive(spark):
    d = spark.createDataFrame([(1, "NVDA and $AMD, nvda AMDX"), (2, "Über $NVDA!"), (3, None)], "id int, t string")
    r = {(x.id, x.ticker): x.match_type for x in tx.symbol_mentions(d, "t", ["NVDA", "AMD"]).collect()}
    assert r == {(1, "NVDA"): "word", (1, "AMD"): "dollar", (2, "NVDA"): "dollar"}
    u = {x.symbol: x.n_mentions for x in tx.unknown_symbols(d, "t", known=["NVDA"]).collect()}
    assert u == {"AMD": 1, "AMDX": 1}


def test_tone_parsing(spark):
    d = spark.createDataFrame([("3.5,1",), ("-40",), ("x,2",), (None,), ("",)], "t string").select(tx.parse_tone("t").alias("v"))
    assert [r.v for r in d.collect()] == [0.35, -1.0, 0.0, 0.0, 0.0]


def test_events_block_signals_inside_the_window(spark):
    s = spark.createDataFrame([("A", dt.date(2024, 1, 1)), ("A", dt.date(2024, 1, 10)), ("B", dt.date(2024, 1, 1))], "ticker string, entry_date date")
    e = spark.createDataFrame([("A", dt.date(2024, 1, 9)), ("A", dt.date(2025, 1, 1))], "ticker string, event_date date")
    r = {(x.ticker, x.entry_date.day) for x in joins.clear_of_events(s, e).collect()}
    assert r == {("A", 10), ("B", 1)}


def test_growth_falls_back_to_today(spark):
    h = spark.createDataFrame([("A", dt.date(2024, 1, 1), 4), ("A", dt.date(2024, 1, 2), 8), ("A", dt.date(2024, 1, 8), 2)], "ticker string, date date, count long")
    r = [(x.mention_growth_1d, x.mention_growth_7d) for x in mention_growth(h).orderBy("date").collect()]
    assert r == [(1.0, 1.0), (2.0, 1.0), (1.0, 0.5)]


def test_sector_cap_spares_exempt_sectors(spark):
    rows = [(f"T{i}", "tech", 0.1 - i / 100) for i in range(6)] + [(f"U{i}", "Unknown", 0.05) for i in range(5)]
    d = spark.createDataFrame([(k, dt.date(2024, 1, 1), "BULLISH", v, s) for k, s, v in rows], "ticker string, date date, signal string, pred_5d double, sector string")
    r = [x.ticker for x in ranking.cap_per_group(d, [*ranking.side_order(), F.col("ticker")]).collect()]
    assert sorted(r) == ["T0", "T1", "T2", "U0", "U1", "U2", "U3", "U4"]


def test_contract_reports_every_violation(spark):
    d = spark.createDataFrame([(1, "ABC", 1, 0.5, 0.5), (2, "abc", -1, 2.0, None)], "post_id long, ticker string, upvotes long, sentiment_score double, sentiment_confidence double")
    from pulsegrid.schema import MENTION_CONTRACT
    c = filters.contract_violations(d, MENTION_CONTRACT)
    assert [r.post_id for r in filters.contract_valid(c).collect()] == [1]
    assert {(r.column, r.check) for r in filters.contract_report(c, ["post_id"]).collect()} == {("ticker", "matches"), ("upvotes", "ge_0"), ("sentiment_score", "between_-1_1")}


def test_distribution_tails():
    assert special.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.f_upper(4.965, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.binomial_upper(8, 10) == pytest.approx(56 / 1024)
    assert special.binomial_two_sided(8, 10) == pytest.approx(112 / 1024)
    assert special.incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248)


def test_significance_row(spark):
    d = spark.createDataFrame([(0.1,)] * 8 + [(-0.1,)] * 2, "pnl_pct double")
    r = resample.significance(d).first()
    assert (r.n_trades, r.n_wins) == (10, 8) and r.p_two_sided == pytest.approx(0.109375) and not r.significant
    assert r.ci_low == pytest.approx(0.4902, abs=1e-3) and r.ci_high == pytest.approx(0.9433, abs=1e-3)


def test_probabilistic_sharpe_of_a_symmetric_sample(spark):
    d = spark.createDataFrame([(x,) for x in (0.01, -0.01) * 20], "r double")
    r = resample.sharpe_significance(d, "r").first()
    assert r.psr == pytest.approx(0.5) and r.dsr < 0.01 and r.min_track_record == 9999


def test_permutation_is_a_bijection(spark):
    d = spark.range(1, 501).select(F.col("id").alias("i"), F.lit(3).alias("b"))
    p = resample.shuffled_position(d, "i", "b", "pos", 8).toPandas()
    assert sorted(p["pos"]) == list(range(1, 501)) and (p["pos"] != p["i"]).mean() > 0.9


def model_json():
    def tree(i, feat, thr, left, right):
        return {"id": i, "left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [feat, 0, 0], "split_conditions": [thr, left, right],
                "default_left": [1, 0, 0], "sum_hessian": [100.0, 30.0, 70.0], "base_weights": [0.0, left, right]}
    leaf = {"id": 2, "left_children": [-1], "right_children": [-1], "split_indices": [0], "split_conditions": [0.25], "default_left": [0], "sum_hessian": [10.0], "base_weights": [0.25]}
    return json.dumps({"learner": {"feature_names": ["a", "b"], "learner_model_param": {"base_score": "[1E-1]"},
                                   "gradient_booster": {"model": {"trees": [tree(0, 0, 0.5, -1.0, 1.0), tree(1, 1, 0.1, 2.0, 3.0), leaf]}}}})


def test_model_file_scores_and_attributions_add_up(spark):
    table, base = st.stumps_from_json(spark, {"5d": model_json()})
    rows = spark.createDataFrame([(1, 0.4, 0.2), (2, 0.5, 0.0), (3, None, 0.1)], "id int, a double, b double")
    got = {r.id: r.score for r in st.score_stumps(rows, table, ["id"], ["a", "b"], base).collect()}
    assert got == {1: pytest.approx(0.1 - 1 + 3 + 0.25), 2: pytest.approx(0.1 + 1 + 2 + 0.25), 3: pytest.approx(0.1 - 1 + 3 + 0.25)}
    exp = st.expected_value(table, base).first().expected
    parts = st.attributions(rows, table, ["id"], ["a", "b"]).groupBy("id").agg(F.sum("attribution").alias("s")).collect()
    for r in parts:
        assert got[r.id] == pytest.approx(exp + r.s)


def test_lexicon_and_custom_scorer(spark):
    d = spark.createDataFrame([(1, "Good good day"), (2, "bad"), (3, None)], "id int, t string")
    r = {x.id: x.sentiment_score for x in lexicon.score_texts(d, "t", {"good": 2.0, "bad": -1.0}).collect()}
    assert r[1] == pytest.approx(4 / math.sqrt(31)) and r[2] == pytest.approx(-0.25) and r[3] == 0.0
    lens = lexicon.score_batches(d, "t", lambda b: [("x", len(s), 1.0) for s in b], batch=2)
    assert {x.id: x.model_score for x in lens.collect()} == {1: 13.0, 2: 3.0, 3: 0.0}


def test_keep_last_prefers_the_later_batch(spark):
    a = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 1.0)], "ticker string, date int, v double")
    b = spark.createDataFrame([("A", 1, 2.0), ("C", 1, 3.0)], "ticker string, date int, v double")
    assert {(r.ticker, r.v) for r in setops.keep_last([a, b]).collect()} == {("A", 2.0), ("B", 1.0), ("C", 3.0)}
    assert {(r.ticker, r.v) for r in setops.insert_new(a, b).collect()} == {("A", 1.0), ("B", 1.0), ("C", 3.0)}
