"""Streams fed in several micro-batches against their batch meaning."""

import datetime as dt

import pandas as pd

from pulsegrid.sources import readers, writers
from pulsegrid.streaming import sinks, stateful

D0 = dt.date(2024, 1, 1)


def staged_stream(spark, path, frames):
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def ev(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date date, kind string, close double")


def day(i):
    return D0 + dt.timedelta(days=i)


def test_labels_resolve_over_batches_and_late_signals(spark, tmp_path):
    bars = [("A", day(i), "bar", 100.0 + i) for i in range(12)]
    first = ev(spark, [("A", day(0), "signal", 0.0), *bars[:4]])
    second = ev(spark, bars[4:9])
    third = ev(spark, [("A", day(2), "signal", 0.0), ("A", day(10), "signal", 0.0), *bars[9:]])
    out = sinks.drain(stateful.pending_labels(staged_stream(spark, str(tmp_path / "e"), [first, second, third]))).toPandas()
    got = {r.date.day: round(r.target_return, 6) for r in out.itertuples()}
    assert got == {1: round(105 / 100 - 1, 6), 3: round(107 / 102 - 1, 6)}  # the signal of the 11th stays pending


def test_cooldown_stream_equals_batch(spark, tmp_path):
    offs = [0, 3, 7, 8, 13, 14, 15, 21, 22, 40]
    df = spark.createDataFrame([(k, day(o)) for k in "AB" for o in offs], "ticker string, date date")
    parts = [df.where(f"day(date) <= 9 AND month(date) = 1"), df.where("day(date) > 9 OR month(date) > 1")]
    live = sinks.drain(stateful.cooldown_stream(staged_stream(spark, str(tmp_path / "c"), parts)))
    want = {(k, day(o)) for k in "AB" for o in (0, 7, 14, 21, 40)}
    assert {(r.ticker, r.date) for r in live.collect()} == want
    assert {(r.ticker, r.date) for r in stateful.cooldown_batch(df).collect()} == want


def test_baseline_emits_silent_days(spark, tmp_path):
    d = spark.createDataFrame([("A", day(i), 4) for i in (0, 1, 2, 6, 7)], "ticker string, date date, count long")
    out = sinks.drain(stateful.rolling_baseline(staged_stream(spark, str(tmp_path / "b"), [d.where("day(date) <= 3"), d.where("day(date) > 3")]))).toPandas().sort_values("date")
    counts = [4, 4, 4, 0, 0, 0, 4, 4]
    assert out["count"].tolist() == counts
    m = pd.Series(counts).rolling(20, min_periods=5).mean().fillna(1.0)
    assert (out["baseline"].to_numpy() - m.to_numpy()).__abs__().max() < 1e-12


def test_upsert_rewrites_only_touched_years(spark, tmp_path):
    p = str(tmp_path / "panel")
    a = spark.createDataFrame([("A", dt.date(2022, 1, 1), 1.0), ("A", dt.date(2023, 1, 1), 1.0)], "ticker string, date date, v double")
    b = spark.createDataFrame([("A", dt.date(2023, 1, 1), 2.0), ("B", dt.date(2023, 1, 2), 3.0)], "ticker string, date date, v double")
    writers.upsert_panel(a, p)
    old = {f.name for f in (tmp_path / "panel" / "year=2022").glob("*.parquet")}
    writers.upsert_panel(b, p)
    writers.upsert_panel(b, p)
    assert {f.name for f in (tmp_path / "panel" / "year=2022").glob("*.parquet")} == old
    assert {(r.ticker, str(r.date), r.v) for r in spark.read.parquet(p).collect()} == {("A", "2022-01-01", 1.0), ("A", "2023-01-01", 2.0), ("B", "2023-01-02", 3.0)}


def test_readers_skip_what_is_broken(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert [r.a for r in readers.json_lines(spark, str(tmp_path / "log.jsonl"), "a int").where("a IS NOT NULL").orderBy("a").collect()] == [1, 2]
    (tmp_path / "s.txt").write_text("nvda\n# note\n\n AMD \nNVDA\ntsla\n")
    s = readers.symbol_list(spark, str(tmp_path / "s.txt"), exclude=["TSLA"]).orderBy("position").collect()
    assert [r.ticker for r in s] == ["NVDA", "AMD"]


def test_labels_of_late_signals_and_unordered_bars(spark, tmp_path):
    bars = [("A", day(i), "bar", 100.0 + i) for i in range(45)]
    first = ev(spark, [*bars[:20:2], *bars[1:20:2]])  # every second bar comes late
    second = ev(spark, bars[20:])
    third = ev(spark, [("A", day(3), "signal", 0.0)])  # 41 bars late
    out = sinks.drain(stateful.pending_labels(staged_stream(spark, str(tmp_path / "l"), [first, second, third]))).collect()
    assert [(r.date, r.close_t0, r.close_tn) for r in out] == [(day(3), 103.0, 108.0)]
    old = ev(spark, [*bars, ("A", day(3), "signal", 0.0)])
    short = sinks.drain(stateful.pending_labels(staged_stream(spark, str(tmp_path / "o"), [old]), keep_days=10)).collect()
    assert [(r.date, r.close_t0) for r in short] == [(day(3), None)]


def test_labels_keep_state_over_gaps_and_drop_old_bars(spark, tmp_path):
    parts = [[0, 1, 2, 5, 6, 9], [30, 31, 60, 61, 62], [63, 64, 65, 80]]  # days with a bar and a signal
    frames = [ev(spark, [("A", day(d), kind, 100.0 + d) for d in at for kind in ("signal", "bar")]) for at in parts]
    src = staged_stream(spark, str(tmp_path / "g"), frames)
    got = {r.date: r.target_return for r in sinks.drain(stateful.pending_labels(src, keep_days=40)).collect()}
    assert {d for d, v in got.items() if v is None} == {day(d) for d in (1, 2, 5, 6, 9, 30, 31)}  # older than the bars kept
    want = {day(0): 109 / 100 - 1, day(60): 165 / 160 - 1, day(61): 180 / 161 - 1}
    assert {d: round(v, 9) for d, v in got.items() if v is not None} == {d: round(v, 9) for d, v in want.items()}


def test_baseline_leaves_out_late_days(spark, tmp_path):
    d = spark.createDataFrame([("A", day(i), 4) for i in (0, 1, 2, 3)], "ticker string, date date, count long")
    late = d.where("day(date) = 2")
    out = sinks.drain(stateful.rolling_baseline(staged_stream(spark, str(tmp_path / "b"), [d, late]))).collect()
    assert sorted(r.date for r in out) == [day(i) for i in range(4)]


def test_upserts_raise_on_a_broken_panel_and_fold_repeats(spark, tmp_path):
    import pytest

    p = tmp_path / "panel"
    rows = spark.createDataFrame([("A", dt.date(2023, 1, 1), 1.0), ("A", dt.date(2023, 1, 1), 2.0)], "ticker string, date date, v double")
    writers.insert_panel(rows, str(p))
    writers.insert_panel(rows.selectExpr("concat(ticker, 'B') AS ticker", "date", "v"), str(p))
    assert {(r.ticker, r.v) for r in spark.read.parquet(str(p)).collect()} == {("A", 2.0), ("AB", 2.0)}
    for f in p.glob("year=*/*.parquet"):
        f.write_bytes(b"no parquet")
    with pytest.raises(Exception):
        writers.upsert_panel(rows, str(p))
    assert all(f.read_bytes() == b"no parquet" for f in p.glob("year=*/*.parquet"))
