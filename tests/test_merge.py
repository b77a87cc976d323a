"""Line merging against plain loops, with chunks far smaller than the groups."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidelog.operators.merge import group_multiline, idle_gap_lines, merge_idle_gap, multiline_lines


def lines(seed, n=800):
    rng = random.Random(seed)
    rows, us = [], 0
    for i in range(n):
        us += rng.choice([0, 100_000, 500_000, 1_000_000, 1_000_000, 3_000_000 if rng.random() < 0.2 else 200_000])
        key = "busy" if rng.random() < 0.7 else f"k{rng.randrange(3)}"
        rows.append((key, us, i, rng.choice(["start ", "  at ", "  at ", "\tby ", ""]) + str(i)))
    return rows


def frame(spark, rows):
    return (spark.createDataFrame(rows, "container_id string, us bigint, event_id bigint, message string")
            .withColumn("timestamp", F.timestamp_micros("us")))


def in_parts(groups, max_text=None):
    return sorted((key, "\n".join(texts)) for key, texts in groups)


def whole(rows):
    return sorted((r["container_id"], r["message"]) for r in rows)


def from_lines(rows, start):
    """Events put together from numbered lines."""
    found = {}
    for r in sorted(rows, key=lambda r: r["line_no"]):
        texts = found.setdefault((r["container_id"], *[r[c] for c in start]), [])
        texts.append(r["message"])
        assert r["line_no"] == len(texts)
    return sorted((k[0], "\n".join(v)) for k, v in found.items())


def loop_runs(rows, start, condition, timeout):
    groups, open_run, last = [], {}, {}
    for key, us, _, text in sorted(rows, key=lambda r: (r[1], r[2])):
        late = key in last and timeout is not None and us - last[key] > timeout
        if open_run.get(key) is not None and re.search(condition, text) and not late:
            open_run[key].append(text)
        else:
            run = [text]
            groups.append((key, run))
            open_run[key] = run if re.search(start, text) else None
        last[key] = us
    return in_parts(groups)


@pytest.mark.parametrize("seed, start, condition, timeout", [
    (1, r"^\S", r"^\s", 2.0), (2, r"^\S", r"^\S", 2.0), (3, r"^\S", r"^\S", None), (4, r"^start", r"^\s", None),
    (5, r"^start", r"at|by", 1.0)])
def test_multiline_equals_loop(spark, seed, start, condition, timeout):
    rows = lines(seed)
    given = {"start": start, "condition": condition, "timeout_seconds": timeout, "chunk_seconds": 5, "target_rows": 3}
    found = group_multiline(frame(spark, rows), ["container_id"], **given).collect()
    expected = loop_runs(rows, start, condition, None if timeout is None else timeout * 1_000_000)
    assert whole(found) == expected
    assert from_lines(multiline_lines(frame(spark, rows), ["container_id"], **given).collect(), ["run_start", "run_id"]) == expected
    assert sum(r["lines"] for r in found) == len(rows)


def test_a_very_long_event_is_one_row(spark):
    df = spark.range(25_000).selectExpr("'a' AS container_id", "timestamp_micros(id * 1000) AS timestamp", "id AS event_id",
                                        "if(id = 0, 'start', concat('  at ', id)) AS message")
    for found in (merge_idle_gap(df, ["container_id"], target_rows=1000), group_multiline(df, ["container_id"], target_rows=1000)):
        row = found.collect()
        assert [(r["lines"], r["message"].count("\n")) for r in row] == [(25_000, 24_999)]


def loop_sessions(rows, gap):
    groups, last = [], {}
    for key, us, _, text in sorted(rows, key=lambda r: (r[1], r[2])):
        if key in last and us - last[key][0] < gap:
            last[key][1].append(text)
            last[key] = (us, last[key][1])
        else:
            run = [text]
            groups.append((key, run))
            last[key] = (us, run)
    return in_parts(groups)


@pytest.mark.parametrize("gap, target", [(2.0, 100_000), (2.0, 2), (0.5, 1)])
def test_idle_gap_equals_loop(spark, gap, target):
    rows = lines(7)
    expected = loop_sessions(rows, gap * 1_000_000)
    assert whole(merge_idle_gap(frame(spark, rows), ["container_id"], gap_seconds=gap, target_rows=target).collect()) == expected
    lines_found = idle_gap_lines(frame(spark, rows), ["container_id"], gap_seconds=gap, target_rows=target).collect()
    assert from_lines(lines_found, ["session_start"]) == expected


def test_missing_keys_and_times_are_kept(spark):
    rows = [("a", 5_000_000, 1, "x"), (None, 5_000_000, 2, "y"), (None, 5_500_000, 3, "z"), ("a", None, 4, "w")]
    for found in (merge_idle_gap(frame(spark, rows), ["container_id"]), group_multiline(frame(spark, rows), ["container_id"])):
        found = found.collect()
        assert sum(r["lines"] for r in found) == 4
        assert {t for r in found for t in r["message"].split("\n")} == {"x", "y", "z", "w"}
