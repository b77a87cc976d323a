"""Merging of log lines into events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidelog.functions.values import from_micros
from tidelog.operators.ordered import cuts_of, event_us, fold_lines, idle_sessions, numbered, piece_start, segments, with_chunks


def idle_gap_lines(df: DataFrame, keys: Sequence[str] = ("container_id", "stream"), ts: str = "timestamp",
                   order: str = "event_id", gap_seconds: float = 2.0, target_rows: int = 100_000) -> DataFrame:
    """Every line with the event it belongs to: `session_start`, and `line_no` from 1 on.

    Lines of a key less than the gap apart are one event. Nothing is collected, so events have any length.
    """
    lines, keys, named = _idle_lines(df, keys, ts, gap_seconds, target_rows)
    return (numbered(lines, keys, "session_us", ts, order)
            .withColumn("session_start", from_micros(F.col("session_us"))).select(*df.columns, "session_start", "line_no"))


def merge_idle_gap(df: DataFrame, keys: Sequence[str] = ("container_id", "stream"), ts: str = "timestamp",
                   order: str = "event_id", message: str = "message", gap_seconds: float = 2.0,
                   target_rows: int = 100_000) -> DataFrame:
    """Events of a key less than the gap apart folded into one row each, joined by newline.

    The text of an event is one value, as long as its lines; `idle_gap_lines` leaves the lines apart.
    """
    lines, keys, named = _idle_lines(df, keys, ts, gap_seconds, target_rows)
    return (fold_lines(lines, keys, "session_us", ts, order, message)
            .withColumn("session_start", from_micros(F.col("session_us")))
            .select(*[F.col(f"_k.{c}") for c in named], "session_start", "lines", "first_ts", "last_ts", "message"))


def idle_gap_segments(df: DataFrame, keys: Sequence[str] = ("container_id", "stream"), ts: str = "timestamp",
                      order: str = "event_id", message: str = "message", gap_seconds: float = 2.0,
                      target_rows: int = 100_000, segment_bytes: int = 1 << 20) -> DataFrame:
    """The events of `merge_idle_gap`, of any length: their text as numbered segments of bounded size (`ordered.segments`).

    An empty or null line is an empty one; an empty table has no segments.
    """
    lines, keys, named = _idle_lines(df, keys, ts, gap_seconds, target_rows)
    return (segments(lines, keys, "session_us", ts, order, message, segment_bytes)
            .select(*[F.col(f"_k.{c}") for c in named], from_micros(F.col("session_us")).alias("session_start"),
                    "segment", "lines", "first_ts", "last_ts", "message"))


def _idle_lines(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: float, target_rows: int):
    """Lines with `session_us` and `chunk`, the key as one struct, and the names in it."""
    # One struct as the key: equal also where a part of it is NULL.
    df, keys, named = df.withColumn("_k", F.struct(*keys)), ["_k"], keys
    gap = int(gap_seconds * 1_000_000)
    cuts = cuts_of(F.col("rows"), gap, target_rows)
    # One row per chunk: a busy slot has several, and its lines are joined chunk by chunk.
    sessions = (idle_sessions(df, keys, ts, gap_seconds)
                .withColumn("_cuts", cuts)
                .withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_cuts") - 1)))
                .select(*keys, piece_start(F.col("slot"), F.col("_piece"), F.col("_cuts"), gap).alias("chunk"), "session_us"))
    return with_chunks(df, keys, ts, gap_seconds, target_rows).join(sessions, [*keys, "chunk"]), keys, named


def stream_idle_gap(df: DataFrame, keys: Sequence[str] = ("container_id", "stream"), ts: str = "timestamp",
                    gap: str = "2 seconds", watermark: str = "10 seconds") -> DataFrame:
    """Length and times of the same events on a stream, each once the watermark has passed its end.

    The state of an open event is a few numbers. Its lines, numbered, come from `streaming.stateful.stream_idle_lines`.
    """
    keys = list(keys)
    return (df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
            .groupBy(*keys, F.session_window(ts, gap).alias("session"))
            .agg(F.count(F.lit(1)).alias("lines"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
            .select(*keys, F.col("session.start").alias("session_start"), "lines", "first_ts", "last_ts"))


def group_multiline(df: DataFrame, keys: Sequence[str], ts: str = "timestamp", order: str = "event_id",
                    line: str = "message", start: str = r"^\S", condition: str = r"^\s",
                    timeout_seconds: float | None = 2.0, chunk_seconds: float = 60.0,
                    target_rows: int = 100_000) -> DataFrame:
    """Runs of lines folded into one row each: see `multiline_lines`, which leaves the lines apart."""
    lines, keys, named = _run_lines(df, keys, ts, order, line, start, condition, timeout_seconds, chunk_seconds, target_rows)
    return (fold_lines(lines, keys, "_run", ts, order, line)
            .withColumn("run_start", from_micros(F.col("_run.us")))
            .withColumn("run_id", F.col("_run.id"))
            .select(*[F.col(f"_k.{c}") for c in named], "run_start", "run_id", "lines", "first_ts", "last_ts", "message"))


def multiline_segments(df: DataFrame, keys: Sequence[str], ts: str = "timestamp", order: str = "event_id",
                       line: str = "message", start: str = r"^\S", condition: str = r"^\s",
                       timeout_seconds: float | None = 2.0, chunk_seconds: float = 60.0,
                       target_rows: int = 100_000, segment_bytes: int = 1 << 20) -> DataFrame:
    """The runs of `group_multiline`, of any length: their text as numbered segments of bounded size (`ordered.segments`)."""
    lines, keys, named = _run_lines(df, keys, ts, order, line, start, condition, timeout_seconds, chunk_seconds, target_rows)
    return (segments(lines, keys, "_run", ts, order, line, segment_bytes)
            .select(*[F.col(f"_k.{c}") for c in named], from_micros(F.col("_run.us")).alias("run_start"), F.col("_run.id").alias("run_id"),
                    "segment", "lines", "first_ts", "last_ts", "message"))


def multiline_lines(df: DataFrame, keys: Sequence[str], ts: str = "timestamp", order: str = "event_id",
                    line: str = "message", start: str = r"^\S", condition: str = r"^\s",
                    timeout_seconds: float | None = 2.0, chunk_seconds: float = 60.0,
                    target_rows: int = 100_000) -> DataFrame:
    """Every line with the run it belongs to: `run_start`, `run_id` (time and order of its first line) and `line_no`.

    A run is opened by a `start` line and continued while lines match `condition`.
    A line outside any run stays alone; a pause longer than the timeout ends the run.
    A line that cannot continue a run is a break, so a run reaches from the first start
    line at or after a break up to the next break. Breaks and starts are looked for inside
    each chunk. What is open at a chunk's border comes from one summary row per chunk, made
    from times and flags without the texts. Nothing is collected, so runs have any length.
    """
    lines, keys, _ = _run_lines(df, keys, ts, order, line, start, condition, timeout_seconds, chunk_seconds, target_rows)
    return (numbered(lines, keys, "_run", ts, order)
            .select(*df.columns, from_micros(F.col("_run.us")).alias("run_start"), F.col("_run.id").alias("run_id"), "line_no"))


def _run_lines(df: DataFrame, keys: Sequence[str], ts: str, order: str, line: str, start: str, condition: str,
               timeout_seconds: float | None, chunk_seconds: float, target_rows: int):
    """Lines with `_run` and `chunk`, the key as one struct, and the names in it."""
    df, keys, named = df.withColumn("_k", F.struct(*keys)), ["_k"], keys
    rows = (df.withColumn("_continues", F.col(line).rlike(condition))
            .withColumn("_starts", F.col(line).rlike(start)))
    rows = with_chunks(rows, keys, ts, chunk_seconds, target_rows)
    rows = rows.withColumn("_pos", F.struct(event_us(ts).alias("us"), F.col(order).alias("id")))

    # Inside a chunk: blocks between breaks. Whether the first line is a break is open here.
    in_chunk = Window.partitionBy(*keys, "chunk").orderBy("_pos")
    upto = in_chunk.rowsBetween(Window.unboundedPreceding, 0)
    pause = F.col("_pos.us") - F.lag("_pos.us").over(in_chunk)
    too_long = (lambda p: F.lit(False)) if timeout_seconds is None else (
        lambda p: p > int(timeout_seconds * 1_000_000))
    breaks = F.when(pause.isNotNull(), (~F.col("_continues") | too_long(pause)).cast("int")).otherwise(0)
    rows = rows.withColumn("_break", breaks).withColumn("_block", F.sum("_break").over(upto))
    in_block = Window.partitionBy(*keys, "chunk", "_block").orderBy("_pos")
    opened = F.min(F.when(F.col("_starts"), F.col("_pos"))).over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_open", opened)

    borders = _open_at_borders(rows, keys, too_long)
    carried = (F.col("_block") == 0) & F.col("_carry").isNotNull()
    lines = (rows.join(borders, [*keys, "chunk"])
             .withColumn("_run", F.when(carried, F.col("_carry")).otherwise(F.coalesce("_open", "_pos"))))
    return lines, keys, named


def _open_at_borders(rows: DataFrame, keys: Sequence[str], too_long) -> DataFrame:
    """Per chunk, the run that is open at its start (`_carry`)."""
    blocks = (rows.groupBy(*keys, "chunk", "_block")
              .agg(F.min(F.struct("_pos", "_continues")).alias("_head"), F.max("_pos.us").alias("_last"), F.min("_open").alias("_first")))
    first, final = F.min(F.struct("_block", "_head")), F.max(F.struct("_block", "_first", "_last"))
    chunks = (blocks.groupBy(*keys, "chunk").agg(first.alias("f"), final.alias("l"))
              .select(*keys, "chunk", F.col("f._head._pos.us").alias("_from"), F.col("f._head._continues").alias("_continues"),
                      F.col("l._block").alias("_breaks"), F.col("l._first").alias("_tail"), F.col("l._last").alias("_to")))
    by_time = Window.partitionBy(*keys).orderBy("chunk")
    pause = F.col("_from") - F.lag("_to").over(by_time)
    fresh = pause.isNull() | ~F.col("_continues") | too_long(pause)
    stretch = F.sum((F.col("_fresh") | (F.col("_breaks") > 0)).cast("int")).over(
        by_time.rowsBetween(Window.unboundedPreceding, 0))
    chunks = chunks.withColumn("_fresh", fresh).withColumn("_stretch", stretch)
    # Since the last chunk with a break, the earliest start is the open run.
    running = (Window.partitionBy(*keys, "_stretch").orderBy("chunk")
               .rowsBetween(Window.unboundedPreceding, 0))
    return (chunks.withColumn("_state", F.min("_tail").over(running))
            .withColumn("_before", F.lag("_state").over(by_time))
            .select(*keys, "chunk", F.when(~F.col("_fresh"), F.col("_before")).alias("_carry")))
