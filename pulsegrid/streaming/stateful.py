"""Keyed state machines: pending labels, cooldown, rolling baseline.

Each has a batch twin elsewhere or a group form here; rows of one key arrive as one
row per day, so a key's batch and state stay bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EPOCH = pd.Timestamp("1970-01-01")


def _days(s: pd.Series) -> pd.Series:
    return (pd.to_datetime(s) - EPOCH).dt.days


# --- T4 ----------------------------------------------------------------------------------

LABEL_OUT = "ticker string, date date, close_t0 double, close_tn double, target_return double"


class PendingLabels(StatefulProcessor):
    """State of a key: its bars by day (map), the days of open signals (list), first and last stored day (value).

    Bars are written and read one by one, so a batch touches the days from its oldest open signal on and not all
    stored bars. Old bars go by bar date: the store's time to live counts by the clock, and a trial run over everything
    available did not end in that mode within two minutes.
    """

    def __init__(self, rows: int, min_days: int, keep_days: int, key: str):
        self.rows, self.min_days, self.keep_days, self.key = rows, min_days, keep_days, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getMapState("bars", "day bigint", "close double")
        self.open = handle.getListState("open", "day bigint")
        self.span = handle.getValueState("span", "first bigint, last bigint")

    def _stored(self, day: int, seen: dict[int, float | None]) -> float | None:
        if day not in seen:
            found = self.bars.getValue((day,)) if self.bars.containsKey((day,)) else None
            seen[day] = found[0] if found is not None else None
        return seen[day]

    def _closes(self, day: int, last: int, seen: dict[int, float | None]) -> list[float]:
        """Closes of the first ``rows + 1`` bars from ``day`` on, or of as many as there are."""
        out = []
        while day <= last and len(out) <= self.rows:
            c = self._stored(day, seen)
            if c is not None:
                out.append(c)
            day += 1
        return out

    def _forget(self, first: int, last: int, horizon: int) -> None:
        """Drop stored bars before ``horizon``; first and last are the stored days."""
        if last < horizon:
            self.bars.clear()
        else:
            for day in range(first, horizon):
                self.bars.removeKey((day,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, last = self.span.get() if self.span.exists() else (None, None)
        fresh, signals = {}, [x[0] for x in self.open.get()] if self.open.exists() else []
        for pdf in rows:
            days, is_bar = _days(pdf["date"]), pdf["kind"] == "bar"
            signals += [int(d) for d in days[~is_bar]]
            fresh.update(zip((int(d) for d in days[is_bar]), pdf["close"][is_bar].tolist()))
        newest = max([*fresh, *([] if last is None else [last])], default=None)
        horizon = newest - self.keep_days if newest is not None else None
        if last is not None and first < horizon:
            self._forget(first, last, horizon)
        kept = {d: c for d, c in fresh.items() if d >= horizon}
        for d, c in kept.items():
            self.bars.updateValue((d,), (c,))
        if newest is not None:
            old = [] if last is None or last < horizon else [max(first, horizon)]
            self.span.update((min([*kept, *old]), newest))
        seen, waiting, out = dict(kept), [], []
        for day in signals:
            if horizon is not None and day < horizon:
                out.append((key[0], day, None, None, None))
            elif horizon is None or newest - day < self.min_days:
                waiting.append(day)
            elif len(c := self._closes(day, newest, seen)) > self.rows:
                out.append((key[0], day, c[0], c[-1], c[-1] / c[0] - 1))
            else:
                waiting.append(day)
        if waiting:
            self.open.put([(d,) for d in waiting])
        else:
            self.open.clear()
        if out:
            df = pd.DataFrame(out, columns=[self.key, "date", "close_t0", "close_tn", "target_return"])
            df["date"] = [(EPOCH + pd.Timedelta(days=d)).date() for d in df["date"]]
            yield df.astype({c: "float64" for c in ("close_t0", "close_tn", "target_return")})

    def close(self) -> None:
        pass


def pending_labels(events: DataFrame, rows=5, min_days=7, keep_days=3660, key="ticker") -> DataFrame:
    """T4: the label of a signal is the close ``rows`` bars after its base, by bar date.

    ``events`` holds (ticker, date, kind, close) with kind ``signal`` or ``bar``. The base is the bar of the
    signal's date or the first later one. Bars count in the order of their dates, however they arrive. A label is
    emitted once its bar is known and, where later bars are still to come, bars reach ``min_days`` past the signal;
    so bars that are late by less than that still enter. State keeps a key's bars, one per day, over ``keep_days``;
    a signal older than that is reported at once with null closes instead of a wrong base. The session's state
    store must be RocksDB (``session.configure``).
    """
    out = LABEL_OUT.replace("ticker", key, 1)
    return events.groupBy(key).transformWithStateInPandas(PendingLabels(rows, min_days, keep_days, key), out, "Append", "None")


# --- T5 ----------------------------------------------------------------------------------

COOL_OUT = "ticker string, date date"


def _greedy(days: list[int], last: int | None, wait: int) -> tuple[list[int], int | None]:
    kept = []
    for d in days:
        if last is None or d - last >= wait:
            kept.append(d)
            last = d
    return kept, last


def _distinct_days(events: DataFrame, key: str) -> DataFrame:
    """Repeats of (key, day) dropped inside every Arrow batch, before rows are sent to their key:
    a key with a large share of the events sends few rows."""

    def thin(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf.drop_duplicates()

    d = events.select(key, "date")
    return d.mapInPandas(thin, d.schema)


def cooldown_stream(events: DataFrame, wait=7, key="ticker") -> DataFrame:
    """T5: an event passes if the last *passed* event of its key is ``wait`` days old."""

    def step(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        days = sorted(set(_days(pd.concat(list(parts))["date"]).tolist()))
        kept, last = _greedy(days, last, wait)
        if last is not None:
            state.update((last,))
        if kept:
            yield pd.DataFrame({"ticker": [k[0]] * len(kept), "date": [(EPOCH + pd.Timedelta(days=d)).date() for d in kept]})

    return _distinct_days(events, key).groupBy(key).applyInPandasWithState(step, COOL_OUT, "last bigint", "append", GroupStateTimeout.NoTimeout)


def cooldown_batch(events: DataFrame, wait=7, key="ticker", time="date") -> DataFrame:
    """Batch twin of T5 over distinct (key, day)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, _ = _greedy(sorted(_days(pdf[time]).tolist()), None, wait)
        return pd.DataFrame({"ticker": [pdf[key].iloc[0]] * len(kept), "date": [(EPOCH + pd.Timedelta(days=d)).date() for d in kept]})

    return events.select(key, time).distinct().groupBy(key).applyInPandas(run, COOL_OUT)


# --- T8 ----------------------------------------------------------------------------------

BASE_OUT = "ticker string, date date, count bigint, baseline double, spike_ratio double"


def rolling_baseline(daily: DataFrame, size=20, min_rows=5, cap=10.0, key="ticker") -> DataFrame:
    """Each day's count against the mean of the last ``size`` days of its key; days without
    posts between two arrivals enter as zeros (and are emitted). A day that is not after the last one of its key
    has been emitted already and is left out."""

    def step(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, hist = (state.get[0], list(state.get[1])) if state.exists else (None, [])
        pdf = pd.concat(list(parts))
        pdf = pdf.assign(_d=_days(pdf["date"])).sort_values("_d")
        out = []
        for d, n in zip(pdf["_d"].tolist(), pdf["count"].tolist()):
            if last is not None and d <= last:
                continue
            gap = [] if last is None else [(x, 0) for x in range(last + 1, d)]
            for day, c in [*gap, (d, int(n))]:
                hist = (hist + [c])[-size:]
                mean = sum(hist) / len(hist) if len(hist) >= min_rows else 1.0
                out.append((k[0], (EPOCH + pd.Timedelta(days=day)).date(), c, mean, min(c / (mean + 1.0), cap)))
            last = d
        state.update((last, hist))
        yield pd.DataFrame(out, columns=["ticker", "date", "count", "baseline", "spike_ratio"])

    return daily.groupBy(key).applyInPandasWithState(step, BASE_OUT, "last bigint, hist array<bigint>", "append", GroupStateTimeout.NoTimeout)


def as_label_events(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """One stream of signals and bars for ``pending_labels``."""
    s = signals.select("ticker", "date", F.lit("signal").alias("kind"), F.lit(0.0).alias("close"))
    return s.unionByName(bars.select("ticker", "date", F.lit("bar").alias("kind"), "close"))
