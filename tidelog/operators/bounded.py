"""Joins with a side that is small as a rule but not by proof."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidelog.session import cut_lineage

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 << 20  # as text


def counted(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """The rows computed once into the checkpoint folder, and their number up to `max_rows` + 1."""
    kept = cut_lineage(df)
    return kept, kept.limit(max_rows + 1).count()


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A join side, marked for broadcast where it was counted to be small, in rows and in bytes.

    The other side is then not shuffled at all. A larger one is joined by a shuffle as usual.
    """
    kept, rows = counted(df, max_rows)
    if rows > max_rows:
        return kept
    size = kept.agg(F.sum(F.octet_length(F.to_json(F.struct(*kept.columns))))).first()[0] or 0
    return F.broadcast(kept) if size <= MAX_BROADCAST_BYTES else kept
