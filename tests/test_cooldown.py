"""Cooldown against a plain loop, with busy keys and blocks shorter than the data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions.values import micros
from tidelog.operators import cooldown, detect
from tidelog.operators.cooldown import throttle


def loop(events, pause):
    last, out = {}, []
    for key, us, i in sorted(events, key=lambda e: (e[1], e[2])):
        if key not in last or us - last[key] >= pause:
            last[key] = us
            out.append((key, us, i))
    return sorted(out)


def run(spark, events, seconds, block):
    df = spark.createDataFrame(events, "k string, us bigint, i bigint").withColumn("ts", F.timestamp_micros("us"))
    rows = throttle(df, ["k"], "ts", seconds, order=["i"], block_seconds=block)
    return sorted((r["k"], r["us"], r["i"]) for r in rows.collect())


@pytest.mark.parametrize("seed, seconds, block", [(1, 60, 60), (2, 60, 600), (3, 7.5, 20), (4, 300, 3600)])
def test_equals_loop(spark, seed, seconds, block):
    rng = random.Random(seed)
    events = []
    for i in range(3000):
        # One key holds two thirds of the events; times tie now and then.
        key = "busy" if rng.random() < 0.66 else f"k{rng.randrange(5)}"
        events.append((key, rng.randrange(0, 4_000) * 1_000_000 + rng.choice([0, 1, 500_000]), i))
    assert run(spark, events, seconds, block) == loop(events, int(seconds * 1_000_000))


def test_sparse_keys_and_exact_pause(spark):
    events = [("a", 0, 0), ("a", 60_000_000, 1), ("a", 119_999_999, 2), ("a", 10**10, 3), ("b", -5_000_000, 4), ("b", 1, 5)]
    assert run(spark, events, 60, 60) == loop(events, 60_000_000)


def test_critical_alerts_fall_through_to_the_next_class(spark):
    bodies = [(0, "error: deadlock"), (1, "error: deadlock and segfault"), (2, "error: segfault"), (30, "error: too many connections, deadlock"),
              (70, "error: dead lock, out of memory"), (71, "error: deadlock, out of memory, disk full"), (72, "fine")]
    df = spark.createDataFrame([(i, s, b) for i, (s, b) in enumerate(bodies)], "LogId bigint, s bigint, Body string")
    df = df.select("LogId", F.timestamp_seconds("s").alias("Timestamp"), F.lit("app").alias("ServiceName"),
                   F.lit("INFO").alias("SeverityText"), F.lit("c").alias("ContainerId"), F.lit("n").alias("ContainerName"), "Body")
    found = sorted((r["LogId"], r["type"]) for r in detect.critical_alerts(df).collect())
    assert found == [(0, "deadlock"), (1, "crash"), (3, "ddos"), (4, "deadlock"), (5, "oom")]


def test_a_key_without_a_pause_over_a_day(spark, monkeypatch):
    """Every phase of the pause gives another chain, so no map collapses; and no task holds more than FAN of the maps."""
    monkeypatch.setattr(cooldown, "FAN", 4)
    step, count = 100_000, 864_000
    df = spark.range(count).selectExpr("'busy' AS k", f"timestamp_micros(id * {step}) AS ts", "id AS i")
    passed = sorted(r.i for r in throttle(df, ["k"], "ts", 7.25, order=["i"], block_seconds=600).select("i").collect())
    expected, free = [], 0
    for i in range(count):
        if i * step >= free:
            expected.append(i)
            free = i * step + 7_250_000
    assert passed == expected


def _solved(times, pause, free):
    last = None
    for t in times:
        if t >= free:
            last, free = t, t + pause
    return last


@pytest.mark.parametrize("seed", range(20))
def test_composed_maps_equal_the_chain_over_both(seed):
    rng = random.Random(seed)
    pause, length = 50, rng.choice([60, 500])
    parts = [sorted({rng.randrange(i * length, (i + 1) * length) for _ in range(rng.randint(1, 60))}) for i in range(5)]
    maps = []
    for times in parts:
        us = np.array(times, np.int64)
        maps.append(cooldown._collapsed(us, us[cooldown._chain_ends(us, pause)]))
    now, times = maps[0], list(parts[0])
    for other, more in zip(maps[1:], parts[1:]):
        now, times = cooldown.composed(now, other, pause, pause), times + more
        for free in range(-1, pause + 1):
            at = int(np.searchsorted(now[0], free, side="left"))
            assert (int(now[1][at]) if at < len(now[0]) else None) == _solved(times, pause, free)


def test_no_step_deals_rows_by_key_alone(spark):
    df = spark.range(5000).selectExpr("concat('k', id % 3) AS k", "timestamp_seconds(id * 7) AS ts", "id AS i")
    plan = throttle(df, ["k"], "ts", 60, order=["i"], block_seconds=600)._jdf.queryExecution().executedPlan().toString()
    # Only the count of blocks per key, which is summed before it is dealt, goes by the key.
    dealt = [line for line in plan.splitlines() if "hashpartitioning(_key#" in line and line.split("hashpartitioning(")[1].split(",")[1].strip().isdigit()]
    assert all("REPARTITION" not in line for line in dealt)


def first_request_windows(rows, per_minute):
    """(client, opened, at, requests, path) of each window's requests from the per_minute-th on: one window after the other."""
    out, opened, count = [], {}, {}
    for us, client, path in sorted(rows):
        if client not in opened or us >= opened[client] + 60_000_000:
            opened[client], count[client] = us, 0
        count[client] += 1
        if count[client] >= per_minute:
            out.append((client, opened[client], us, count[client], path))
    return out


@pytest.mark.parametrize("seed, per_minute, pause", [(1, 5, 120), (2, 20, 120), (3, 3, 7200)])
def test_floods_from_the_first_request(spark, seed, per_minute, pause):
    rng = random.Random(seed)
    rows = [(rng.randrange(0, 7200) * 1_000_000 + rng.choice([0, 1, 999_999]), rng.choice(["busy"] * 6 + ["a", "b", None]), rng.choice(["/x", "/y", None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "us bigint, remote_addr string, path string").withColumn("Timestamp", F.timestamp_micros("us"))
    found = sorted(((r.remote_addr, r.us, r.requests, r.latest_path) for r in detect.first_request_floods(df, per_minute, pause).withColumn("us", micros("at")).collect()), key=repr)
    last, expected = {}, []
    for client, _, at, requests, path in first_request_windows([(u, c or "", p or "") for u, c, p in rows], per_minute):
        if client not in last or at - last[client] >= pause * 1_000_000:
            last[client] = at
            expected.append((client or None, at, requests, path or None))
    assert found == sorted(expected, key=repr) and expected


def test_a_burst_across_a_minute_border_is_a_flood(spark):
    df = spark.range(120).selectExpr("'10.0.0.1' AS remote_addr", "timestamp_millis(1706600000000 + 35000 + id * 400) AS Timestamp", "'/p' AS path")
    assert detect.request_floods(df, 120, None).count() == 0
    row = detect.first_request_floods(df, 120).first()
    assert (row.requests, str(row.opened), str(row["at"])) == (120, "2024-01-30 07:33:55", "2024-01-30 07:34:42.600000")


def test_minutes_are_opened_from_times_alone(spark, monkeypatch):
    """Without a cooldown no row goes through `throttle`: its search for the first row of each time is not needed."""
    rows = [("a", "2024-01-01 00:00:00", "/x"), ("a", "2024-01-01 00:00:00", "/x"), ("a", "2024-01-01 00:01:10", "/y"), (None, "2024-01-01 00:00:30", "/x"),
            ("", "2024-01-01 00:00:30", "/x"), (None, "2024-01-01 00:00:50", "/z"), ("a", None, "/x")]
    df = spark.createDataFrame(rows, "remote_addr string, Timestamp string, path string").withColumn("Timestamp", F.col("Timestamp").cast("timestamp"))
    monkeypatch.setattr(detect, "throttle", None)
    found = detect.first_request_floods(df, 2, None).collect()
    assert sorted((str(r.remote_addr), str(r.opened), str(r["at"]), r.requests, r.latest_path) for r in found) == [
        ("None", "2024-01-01 00:00:30", "2024-01-01 00:00:50", 2, "/z"), ("a", "2024-01-01 00:00:00", "2024-01-01 00:00:00", 2, "/x")]
    assert detect.first_request_floods(df.limit(0), 2, None).count() == 0
