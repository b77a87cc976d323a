"""Forms whose state is bounded, against the plain ones."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import analytics, merge


def _busy(spark, n=400):
    """One key without a pause, one with pauses, one null key; some lines empty or null."""
    key = F.when(F.col("id") % 10 < 7, "busy").when(F.col("id") % 10 < 9, "slow")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.expr("make_dt_interval(0, 0, 0, CASE WHEN id % 10 < 7 THEN id DIV 9 ELSE id * 3 END)")
    text = F.when(F.col("id") % 11 == 0, "").when(F.col("id") % 13 != 0, F.concat(F.repeat(F.lit("é"), (F.col("id") % 5).cast("int")), F.col("id")))
    return spark.range(n).select(key.alias("container_id"), at.alias("ts"), F.col("id").alias("event_id"), text.alias("line"))


def _joined(rows, by):
    found = {}
    for r in sorted(rows, key=lambda r: r["segment"]):
        found.setdefault(tuple(r[c] for c in by), []).append(r)
    return {k: ("\n".join(r["message"] for r in v), sum(r["lines"] for r in v), v[0]["first_ts"], v[-1]["last_ts"]) for k, v in found.items()}


def _plain(rows, by, ts="ts"):
    found = {}
    for r in sorted(rows, key=lambda r: r["line_no"]):
        found.setdefault(tuple(r[c] for c in by), []).append(r)
    return {k: ("\n".join(r["line"] or "" for r in v), len(v), v[0][ts], v[-1][ts]) for k, v in found.items()}


@pytest.mark.parametrize("size", [1, 40, 10_000])
def test_segments_join_to_the_event(size, spark):
    df, args = _busy(spark), dict(ts="ts", order="event_id", gap_seconds=2.0, target_rows=10)
    pieces = merge.idle_gap_segments(df, ["container_id"], message="line", segment_bytes=size, **args).collect()
    lines = merge.idle_gap_lines(df, ["container_id"], **args).collect()
    by = ["container_id", "session_start"]
    assert _joined(pieces, by) == _plain(lines, by)
    longest = max(len((r["line"] or "").encode()) for r in df.collect())
    assert max(len(r["message"].encode()) for r in pieces) < size + longest + 1


def test_segments_of_runs_join_to_the_run(spark):
    df = _busy(spark).withColumn("line", F.when(F.col("event_id") % 50 > 0, F.concat(F.lit("  "), F.col("line"))).otherwise("start"))
    args = dict(ts="ts", order="event_id", line="line", target_rows=10)
    pieces = merge.multiline_segments(df, ["container_id"], segment_bytes=64, **args).collect()
    lines = merge.multiline_lines(df, ["container_id"], **args).collect()
    by = ["container_id", "run_start", "run_id"]
    assert _joined(pieces, by) == _plain(lines, by)
    assert max(r["segment"] for r in pieces) > 3


def test_no_lines_no_segments(spark):
    assert merge.idle_gap_segments(_busy(spark, 0), ["container_id"], ts="ts", order="event_id", message="line").count() == 0


def _messages(spark, rare=40_000):
    """Three frequent patterns, which words tell apart, among very many that occur once."""
    word = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    body = F.when(F.col("id") < rare, F.concat(F.lit("once "), word)).otherwise(
        F.concat(F.lit("often "), F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.sqrt(F.col("id") % 9) + 1).cast("int"))))
    return spark.range(0, rare + 9_000, 1, 8).select(
        body.alias("Body"), F.lit("svc").alias("ServiceName"), F.lit("c").alias("ContainerName"),
        F.element_at(F.array(F.lit("INFO"), F.lit("ERROR")), (F.col("id") % 2 + 1).cast("int")).alias("SeverityText"),
        (F.expr("timestamp_ntz'2024-01-30 23:30:00'") + F.expr("make_dt_interval(0, 0, 0, id % 600)")).alias("Timestamp"))


def test_frequent_patterns_are_found_among_very_many(spark):
    df = _messages(spark)
    exact = analytics.patterns(df, "2024-01-31 00:00:00", limit=3).collect()
    found = analytics.heavy_patterns(df, "2024-01-31 00:00:00", limit=20, tracked=512)
    top = found.filter("certain").collect()
    assert [tuple(r)[:-1] for r in top] == [tuple(r) for r in exact]
    assert not [r for r in found.collect() if not r["certain"] and r["frequency"] > 1]


def test_few_patterns_equal_the_plain_list(spark):
    df = _messages(spark, 30)
    for as_of in ("2024-01-31 00:00:00", "2030-01-01 00:00:00"):
        plain = analytics.patterns(df, as_of).collect()
        assert [tuple(r)[:-1] for r in analytics.heavy_patterns(df, as_of).collect()] == [tuple(r) for r in plain]


def test_more_rows_than_are_tracked_cannot_be_listed(spark):
    with pytest.raises(ValueError):
        analytics.heavy_patterns(_messages(spark, 1), "2024-01-31 00:00:00", limit=50, tracked=10)


def test_idle_lines_leave_a_busy_key_in_pieces():
    """Lines that arrive in any order, with ties and nulls, are given out in order and never all at once."""
    import numpy as np
    import pandas as pd

    from tidelog.streaming import stateful

    class Kept:
        value, timers = None, []
        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, value: setattr(self, "value", value)
        getValueState = lambda self, *a: self
        listTimers = lambda self: []
        registerTimer = lambda self, at: self.timers.append(at)

    n = 2 * stateful.PIECE + 500
    random = np.random.default_rng(3)
    rows = pd.DataFrame({"event_us": np.sort(random.integers(0, 4 * n, n)) * 1_000_000, "id": np.arange(n)})
    rows["line"] = [None if i % 100 == 0 else f"line {i}" for i in range(n)]
    mixed = rows.sample(frac=1, random_state=1)
    kept, lines = Kept(), stateful.IdleLines("id", "line", 3.0)
    lines.init(kept)
    found = list(lines.handleInputRows(("a",), iter([mixed[:7000], mixed[7000:9000], mixed[9000:]]), None))
    assert max(map(len, found)) <= stateful.PIECE and len(found) == 3
    whole = pd.concat(found, ignore_index=True)
    assert whole["message"].tolist() == rows["line"].tolist() and whole["event_us"].tolist() == rows["event_us"].tolist()
    start = last = None
    for us, own, number in zip(whole["event_us"], whole["start_us"], whole["line_no"]):
        start, count = (us, 1) if last is None or us - last >= 3_000_000 else (start, count + 1)
        last = us
        assert (own, number) == (start, count)
    assert kept.value == (start, last, count) and len(kept.timers) == 1
    assert list(lines.handleInputRows(("b",), iter([]), None)) == []
