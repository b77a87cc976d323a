"""Streams fed file by file against their batch forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelog.operators.cooldown import throttle
from tidelog.operators.detect import down_up_transitions
from tidelog.operators.ingest import ingest_logs
from tidelog.streaming import stateful, tails

ROWS = "LogId bigint, Timestamp timestamp, ServiceName string, ContainerName string, ContainerId string, SeverityText string, Body string"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def log(i, seconds, container="a", body="x", severity="INFO"):
    return (i, at(seconds), "app", container, container, severity, body)


class Feed:
    """Files that arrive one after the other, each its own micro-batch."""

    def __init__(self, spark, root, schema=ROWS):
        self.spark, self.root, self.schema = spark, root, schema
        (root / "in").mkdir()

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.root / "in"))

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.root / "in"))

    def run(self, rows, name="out"):
        query = (rows.writeStream.format("parquet").option("checkpointLocation", str(self.root / f"{name}-state"))
                 .outputMode("append").trigger(availableNow=True).start(str(self.root / name)))
        query.awaitTermination()
        return self.spark.read.schema(rows.schema).parquet(str(self.root / name))


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_cooldown_state_lasts_over_batches_and_restarts(spark, feed):
    times = [0, 10, 59, 60, 61, 130, 500, 520, 560]
    first = [log(i, s, "a") for i, s in enumerate(times[:4])] + [log(100, 30, "b")]
    second = [log(i + 4, s, "a") for i, s in enumerate(times[4:])] + [log(101, 89, "b"), log(102, 90, "b")]
    feed.add(first)
    feed.run(stateful.stream_throttle(feed.stream(), "ContainerName", "Timestamp", 60))
    feed.add(second)
    found = feed.run(stateful.stream_throttle(feed.stream(), "ContainerName", "Timestamp", 60))
    batch = throttle(spark.createDataFrame(first + second, ROWS), ["ContainerName"], "Timestamp", 60, ["LogId"])
    ids = lambda df: sorted(r["LogId"] for r in df.collect())
    assert ids(found) == ids(batch) == [0, 3, 5, 6, 8, 100, 102]


def test_down_and_recovered_over_batches(spark, feed):
    batches = [[log(0, 0), log(1, 20), log(2, 0, "b")], [log(3, 400, "b"), log(4, 900, "b")], [log(5, 1000), log(6, 2000, "b")]]
    for rows in batches:
        feed.add(rows)
        found = feed.run(stateful.stream_down_up(feed.stream(), "ContainerId", 300, "10 seconds", "10 seconds"))
    changes = {(r["ContainerId"], r["type"], r["at"].timestamp()) for r in found.collect()}
    expected = {(r["ContainerId"], r["type"], r["at"].replace(tzinfo=dt.timezone.utc).timestamp()) for r in down_up_transitions(
        spark.createDataFrame([r for b in batches for r in b], ROWS)).collect()}
    # The last log of the stream has not been passed by the watermark.
    late = {c for c in expected if c[2] >= at(1990).timestamp()}
    assert changes - {("a", "container_down", at(1300).timestamp())} == expected - late


def test_repeated_deliveries_are_dropped(feed):
    feed.add([log(1, 0), log(2, 5), log(1, 0)])
    feed.add([log(2, 5), log(3, 8)])
    found = feed.run(tails.with_lateness(feed.stream(), "Timestamp", "1 minute", ["LogId"]))
    assert sorted(r["LogId"] for r in found.collect()) == [1, 2, 3]


def test_windows_wait_for_late_rows(feed):
    feed.add([log(i, 30) for i in range(5)])
    feed.add([log(10, 100)])
    feed.add([log(11, 50)])   # late, but within the watermark
    feed.add([log(12, 500)])
    found = feed.run(tails.spam_stream(feed.stream(), "1 minute", None, "2 minutes", rate=0.0))
    first = [r for r in found.collect() if r["window_start"].timestamp() == START.timestamp()]
    assert [r["cnt"] for r in first] == [6]


def test_episodes_alert_once_per_run(spark, tmp_path):
    schema = "ContainerId string, grp string, window_start timestamp, cnt bigint"
    feed = Feed(spark, tmp_path, schema)
    feed.add([("a", "g", at(0), 9), ("a", "g", at(60), 9), ("b", "g", at(0), 9)])
    feed.add([("a", "g", at(120), 9), ("a", "g", at(300), 9), ("b", "g", at(60), 9)])
    found = feed.run(stateful.stream_episodes(feed.stream(), 60))
    assert sorted((r["ContainerId"], r["window_start"].timestamp() - START.timestamp()) for r in found.collect()) == [
        ("a", 0), ("a", 300), ("b", 0)]


def test_tail_delivers_ties_and_late_rows(feed):
    feed.add([log(i, 10, body=f"Hit {i}") for i in range(700)])
    feed.add([log(1000, 1, body="hit late"), log(1001, 20, body="miss")])
    got = []
    tails.start_tail(tails.tail_logs(feed.stream(), ["a"], text="HIT"), lambda b: got.extend(r["Body"] for r in b.collect()),
                     str(feed.root / "tail"), every=None).awaitTermination()
    assert len(got) == 701 and "hit late" in got


def test_ingest_stream_equals_batch(spark, tmp_path):
    schema = ROWS + ", ResourceAttributes map<string,string>"
    feed = Feed(spark, tmp_path, schema)
    rows = [(*log(i, i * 3600, body=b, severity=s), {"container.name": n}) for i, (b, s, n) in enumerate(
        [("  ", "", "x"), ("panic now", "", "x"), ("warned", "", "y"), ("trace", "", "y"), ("ok", "", "self"), ("ok", "ERROR", "x")] * 10)]
    feed.add(rows[:30])
    feed.add(rows[30:])
    tails.ingest_stream(feed.stream(), str(tmp_path / "t"), str(tmp_path / "c"), ["self"], ["DEBUG"]).awaitTermination()
    columns = ["LogId", "SeverityText", "ContainerName", "log_date"]
    batch = ingest_logs(spark.createDataFrame(rows, schema), ["self"], ["DEBUG"])
    both = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert both(spark.read.parquet(str(tmp_path / "t"))) == both(batch)


def test_idle_lines_are_numbered_as_they_arrive(spark, feed):
    times = [0, 1, 1.5, 3, 10, 11, 11.5, 12, 12.5, 13, 40]
    rows = [log(i, s, "a", f"m{i}") for i, s in enumerate(times)]
    marked = lambda: stateful.stream_idle_lines(feed.stream(), "ContainerName", "Timestamp", "LogId", "Body", 2.0, "1 second")
    for part in (rows[:2], rows[2:6], rows[6:], [log(99, 100, "z")], [log(100, 200, "z")]):
        feed.add(part)
        found = feed.run(marked())
    got = sorted((r["session_start"].timestamp() - START.timestamp(), r["line_no"], r["Body"])
                 for r in found.filter("ContainerName = 'a'").collect())
    starts = [0, 0, 0, 0, 10, 10, 10, 10, 10, 10, 40]
    numbers = [1, 2, 3, 4, 1, 2, 3, 4, 5, 6, 1]
    assert got == [(s, n, f"m{i}") for i, (s, n) in enumerate(zip(starts, numbers))]
