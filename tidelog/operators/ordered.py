"""Order-dependent work on keys of any size.

A window over one busy key would put all of its rows in one task. Here rows are cut into
chunks of time with a bounded number of rows, windows run inside a chunk, and the state
between chunks comes from one summary row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelog.functions.values import micros
from tidelog.operators.bounded import MAX_BROADCAST_ROWS, counted


def event_us(ts: str) -> Column:
    """Event time in microseconds; a row without a time sorts first instead of being lost."""
    return F.coalesce(micros(ts), F.lit(0).cast("bigint"))


def slot_of(us: Column, width_us: int) -> Column:
    return F.floor(us / F.lit(width_us)).cast("bigint")


def with_chunks(df: DataFrame, keys: Sequence[str], ts: str, width_seconds: float = 60.0,
                target_rows: int = 100_000) -> DataFrame:
    """Adds `chunk`, the start of the row's time chunk in microseconds.

    Chunks are `width_seconds` long; one with more than `target_rows` rows is cut evenly
    into shorter ones. Most data has no such chunk: it is counted first, so that rows are
    joined only where there is one, and shuffled for it only where there are very many.
    """
    width = int(width_seconds * 1_000_000)
    keys = list(keys)
    us = event_us(ts)
    slots = df.groupBy(*keys, slot_of(us, width).alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    heavy, number = counted(slots.filter(F.col("_n") > target_rows))
    rows = df.withColumn("_us", us).withColumn("_slot", slot_of(F.col("_us"), width))
    if number == 0:
        return rows.withColumn("chunk", F.col("_slot") * width).drop("_us", "_slot")
    side = F.broadcast(heavy) if number <= MAX_BROADCAST_ROWS else heavy
    cuts = cuts_of(F.col("_n"), width, target_rows)
    piece = F.floor((F.col("_us") - F.col("_slot") * width) * cuts / width).cast("bigint")
    return (rows.join(side, [*keys, "_slot"], "left")
            .withColumn("chunk", piece_start(F.col("_slot"), piece, cuts, width))
            .drop("_us", "_slot", "_n"))


def cuts_of(rows: Column, width: int, target_rows: int) -> Column:
    """Number of pieces a slot of `rows` rows (NULL: not many) is cut into."""
    return F.least(F.ceil(F.coalesce(rows, F.lit(1)) / target_rows), F.lit(width)).cast("bigint")


def piece_start(slot: Column, piece: Column, cuts: Column, width: int) -> Column:
    return (slot * width + F.floor(piece * width / cuts)).cast("bigint")


def fold_lines(df: DataFrame, keys: Sequence[str], group: str, ts: str, order: str, line: str) -> DataFrame:
    """Joins the lines of each (keys, group) by newline, in (ts, order): an event whole, whatever its length.

    `df` carries `chunk`. Lines are joined inside a chunk first, then the chunks' texts are.
    """
    by = [*keys, group]
    row = F.struct(F.col(ts).alias("t"), F.col(order).alias("o"), F.col(line).alias("m"))
    return (df.groupBy(*by, "chunk")
            .agg(F.array_sort(F.collect_list(row)).alias("_rows"))
            .select(*by, "chunk", F.size("_rows").cast("bigint").alias("lines"),
                    F.col("_rows")[0]["t"].alias("first_ts"), F.element_at("_rows", -1)["t"].alias("last_ts"),
                    F.array_join(F.transform("_rows", lambda r: r["m"]), "\n").alias("_text"))
            .groupBy(*by)
            .agg(F.sum("lines").alias("lines"), F.min("first_ts").alias("first_ts"),
                 F.max("last_ts").alias("last_ts"),
                 F.array_sort(F.collect_list(F.struct("chunk", "_text"))).alias("_texts"))
            .withColumn("message", F.array_join(F.transform("_texts", lambda r: r["_text"]), "\n"))
            .drop("_texts"))


def numbered(df: DataFrame, keys: Sequence[str], group: str, ts: str, order: str) -> DataFrame:
    """Adds `line_no`, the place of a line in its (keys, group) from 1 on.

    Lines are counted per chunk; only lines of one chunk are sorted together, so an event may have any number.
    """
    by = [*keys, group]
    earlier = Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (df.groupBy(*by, "chunk").agg(F.count(F.lit(1)).alias("_n"))
              .select(*by, "chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    inside = F.row_number().over(Window.partitionBy(*by, "chunk").orderBy(ts, order))
    return df.join(before, [*by, "chunk"]).withColumn("line_no", F.col("_before") + inside).drop("_before")


def segments(df: DataFrame, keys: Sequence[str], group: str, ts: str, order: str, line: str, segment_bytes: int) -> DataFrame:
    """The text of each (keys, group) as ordered pieces: `segment`, `lines`, first and last time, `message`.

    A line lies in the segment in which its first byte falls, newlines counted, so a segment has less than `segment_bytes` and a line;
    one that no line begins in is left out. All segments of an event, joined by newline in order, are its text. Bytes
    are summed per chunk first: no task holds an event, whatever its length.
    """
    by = [*keys, group]
    size = F.coalesce(F.octet_length(line), F.lit(0)).cast("bigint") + 1
    earlier = Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (df.groupBy(*by, "chunk").agg(F.sum(size).alias("_bytes"))
              .select(*by, "chunk", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_before")))
    inside = F.sum(size).over(Window.partitionBy(*by, "chunk").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, -1))
    row = F.struct(F.col(ts).alias("t"), F.col(order).alias("o"), F.col(line).alias("m"))
    return (df.join(before, [*by, "chunk"])
            .withColumn("segment", F.floor((F.col("_before") + F.coalesce(inside, F.lit(0))) / segment_bytes).cast("bigint"))
            .groupBy(*by, "segment").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
            .select(*by, "segment", F.size("_rows").cast("bigint").alias("lines"), F.col("_rows")[0]["t"].alias("first_ts"),
                    F.element_at("_rows", -1)["t"].alias("last_ts"),
                    F.array_join(F.transform("_rows", lambda r: r["m"]), "\n", "").alias("message")))


def idle_sessions(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: float) -> DataFrame:
    """One row per key and time slot of the gap's length, with the session it belongs to.

    Two rows in one slot are always less than a gap apart, so a slot never spans two
    sessions and its first and last time are enough. The windows see slots, not rows.
    """
    keys = list(keys)
    gap = int(gap_seconds * 1_000_000)
    us = event_us(ts)
    slots = (df.groupBy(*keys, slot_of(us, gap).alias("slot"))
             .agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.count(F.lit(1)).alias("rows")))
    w = Window.partitionBy(*keys).orderBy("slot")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    idle = F.col("first_us") - F.lag("last_us").over(w)
    opens = idle.isNull() | (idle >= gap)
    session = F.last(F.when(F.col("_opens"), F.col("first_us")), ignorenulls=True).over(upto)
    return slots.withColumn("_opens", opens).withColumn("session_us", session).drop("_opens")
