"""Keyed state on streams: cooldown, active anomalies, down and recovered.

Column names that reach a processor must not start with an underscore: the row batches
handed to Python lose such names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidelog.functions import fixed
from tidelog.session import with_state_store


def _in_order(frames: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    """One key's rows of a micro-batch, in event time."""
    return pd.concat(list(frames), ignore_index=True).sort_values(by, kind="stable")


PIECE = 10_000  # rows that are given out at once


def _lines_in_order(frames: Iterator[pd.DataFrame], order: str, line: str) -> Iterator[tuple[np.ndarray, list]]:
    """(event_us, lines) of one key's rows of a micro-batch in pieces, in event time, then by `order` (nulls last).

    A line waits as its bytes beside two numbers; it becomes a Python text in its piece only.
    """
    times, orders, lines = [], [], []
    for frame in frames:
        times.append(frame["event_us"].astype("int64").to_numpy())
        orders.append(frame[order])
        lines.append(pa.array(frame[line], pa.large_string(), from_pandas=True))
    if not times:
        return
    us, ties, text = np.concatenate(times), pd.concat(orders, ignore_index=True), pa.concat_arrays(lines)
    del times, orders, lines
    if ties.dtype.kind in "iuf":
        at = np.lexsort((ties.to_numpy(), us))
    else:
        at = pd.DataFrame({"us": us, "tie": ties}).sort_values(["us", "tie"], kind="stable").index.to_numpy()
    del ties
    for start in range(0, len(at), PIECE):
        some = at[start:start + PIECE]
        yield us[some], text.take(pa.array(some)).to_pylist()


class Cooldown(StatefulProcessor):
    """Passes an event only `seconds` after the last one that passed."""

    def __init__(self, ts: str, seconds: float):
        self.ts, self.pause_us = ts, int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = _in_order(rows, self.ts)
        last = self.last.get()[0] if self.last.exists() else None
        keep = np.zeros(len(events), dtype=bool)
        for i, us in enumerate(events["event_us"]):
            if last is None or us - last >= self.pause_us:
                keep[i], last = True, int(us)
        if last is not None:
            self.last.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + self.pause_us) // 1000 + 1)
        yield events[keep].drop(columns="event_us")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The pause is over: whatever comes next passes, so nothing needs to be known."""
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_throttle(df: DataFrame, key: str, ts: str, seconds: float, watermark: str = "10 minutes") -> DataFrame:
    """The cooldown on arrival. A key's state is gone once the watermark has passed the end of its pause."""
    rows = (with_state_store(df).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
            .withColumn("event_us", F.unix_micros(F.col(ts))))
    return rows.groupBy(key).transformWithStateInPandas(
        Cooldown(ts, seconds), rows.drop("event_us").schema, outputMode="Append", timeMode="EventTime")


class Episodes(StatefulProcessor):
    """One alert per run of consecutive anomalous windows."""

    def __init__(self, step_seconds: float):
        self.step_us = int(step_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_window", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        windows = _in_order(rows, "event_us")
        last = self.last.get()[0] if self.last.exists() else None
        alert = np.zeros(len(windows), dtype=bool)
        for i, us in enumerate(windows["event_us"]):
            alert[i] = last is None or us - last > self.step_us
            last = int(us) if last is None else max(last, int(us))
        if last is not None:
            self.last.update((last,))
        yield windows[alert].drop(columns="event_us")

    def close(self) -> None:
        pass


def stream_episodes(groups: DataFrame, step_seconds: float = 60.0) -> DataFrame:
    """Alerts of the first window of each run, from rows of anomalous windows."""
    rows = with_state_store(groups).withColumn("event_us", F.unix_micros("window_start"))
    return rows.groupBy("ContainerId", "grp").transformWithStateInPandas(
        Episodes(step_seconds), groups.schema, outputMode="Append", timeMode="None")


class DownUp(StatefulProcessor):
    """A timer fires when a key has been silent for the gap; the next log recovers it."""

    def __init__(self, gap_seconds: float):
        self.gap_ms = int(gap_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last_us bigint, down boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        slots = _in_order(rows, "first_us")
        last, down = self.state.get() if self.state.exists() else (None, False)
        out = []
        for first_us, last_us in zip(slots["first_us"], slots["last_us"]):
            # A pause inside one micro-batch: both changes are known here.
            if last is not None and not down and first_us - last > self.gap_ms * 1000:
                out.append(("container_down", "critical", last + self.gap_ms * 1000, last))
                down = True
            if down:
                out.append(("container_recovered", "info", int(first_us), last))
                down = False
            last = int(last_us) if last is None else max(last, int(last_us))
        if last is None:
            return
        self.state.update((last, down))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last // 1000 + self.gap_ms + 1)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, down = self.state.get()
        if down:
            yield self._rows(key, [])
            return
        self.state.update((last, True))
        yield self._rows(key, [("container_down", "critical", last + self.gap_ms * 1000, last)])

    @staticmethod
    def _rows(key, out) -> pd.DataFrame:
        # Plain Python text: chunked string columns cannot be sent back.
        text = lambda values: pd.Series(values, dtype=object)
        return pd.DataFrame({
            "key": text([str(key[0])] * len(out)), "type": text([o[0] for o in out]),
            "severity": text([o[1] for o in out]),
            "at_us": pd.array([o[2] for o in out], dtype="int64"),
            "last_us": pd.array([o[3] for o in out], dtype="int64")})

    def close(self) -> None:
        pass


def stream_down_up(df: DataFrame, key: str = "ContainerId", gap_seconds: float = fixed.SILENCE_SECONDS,
                   watermark: str = "30 seconds", slot: str = "10 seconds", ts: str = "Timestamp") -> DataFrame:
    """Down and recovered changes per key on event time.

    Rows are first combined to first and last time per key and short slot, so the state
    machine of a busy key reads a few rows per slot.
    """
    us = F.unix_micros(F.col(ts))
    slots = (with_state_store(df).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
             .groupBy(F.window(ts, slot).alias("w"), key)
             .agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"))
             .withColumn("event_time", F.window_time("w")).drop("w"))
    changes = slots.groupBy(key).transformWithStateInPandas(
        DownUp(gap_seconds), "key string, type string, severity string, at_us bigint, last_us bigint",
        outputMode="Append", timeMode="EventTime")
    return changes.select(F.col("key").alias(key), "type", "severity", F.timestamp_micros("at_us").alias("at"),
                          F.timestamp_micros("last_us").alias("last_log"))


class IdleLines(StatefulProcessor):
    """Gives each line the event it belongs to, and its number there; keeps three numbers of the open event."""

    def __init__(self, order: str, line: str, gap_seconds: float):
        self.order, self.line, self.gap_us = order, line, int(gap_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start bigint, last_us bigint, lines bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, last, lines = self.open.get() if self.open.exists() else (None, 0, 0)
        for times, messages in _lines_in_order(rows, self.order, self.line):
            starts, numbers = [], []
            for us in times.tolist():
                if start is None or us - last >= self.gap_us:
                    start, last, lines = us, us, 0
                last, lines = max(last, us), lines + 1
                starts.append(start)
                numbers.append(lines)
            yield pd.DataFrame({"key": pd.Series([str(key[0])] * len(times), dtype=object), "start_us": pd.array(starts, dtype="int64"),
                                "line_no": pd.array(numbers, dtype="int64"), "event_us": times, "message": pd.Series(messages, dtype=object)})
        if start is None:
            return
        self.open.update((start, last, lines))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.gap_us) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype=object), "start_us": pd.array([], dtype="int64"), "line_no": pd.array([], dtype="int64"),
                            "event_us": pd.array([], dtype="int64"), "message": pd.Series([], dtype=object)})

    def close(self) -> None:
        pass


def stream_idle_lines(df: DataFrame, key: str, ts: str = "timestamp", order: str = "event_id", line: str = "message",
                      gap_seconds: float = 2.0, watermark: str = "10 seconds") -> DataFrame:
    """Lines in order of arrival with `session_start` and `line_no`, as soon as they arrive; no line is held.

    The state of a key is gone once the watermark has passed the end of its event.
    """
    rows = (with_state_store(df).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
            .select(key, ts, order, line, F.unix_micros(ts).alias("event_us")))
    marked = rows.groupBy(key).transformWithStateInPandas(
        IdleLines(order, line, gap_seconds), "key string, start_us bigint, line_no bigint, event_us bigint, message string",
        outputMode="Append", timeMode="EventTime")
    return marked.select(F.col("key").alias(key), F.timestamp_micros("start_us").alias("session_start"), "line_no",
                         F.timestamp_micros("event_us").alias(ts), F.col("message").alias(line))
