"""Following growing files: each line once, over triggers, restarts and rotation."""

import json

import pytest

from tidelog.sources import readers, tailing


class Follow:
    """A stream of lines into a folder, one trigger at a time."""

    def __init__(self, spark, make, tmp_path):
        self.spark, self.make, self.out, self.checkpoint = spark, make, str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def trigger(self):
        """Starts the stream where it stopped, and lets it read what is there."""
        query = self.make().writeStream.format("parquet").option("checkpointLocation", self.checkpoint).option("path", self.out).start()
        query.processAllAvailable()
        query.stop()

    def lines(self, column="value"):
        return sorted(r[0] for r in self.spark.read.parquet(self.out).select(column).collect())


def append(path, text):
    with open(path, "a", encoding="utf-8") as file:
        file.write(text)


def test_appended_lines_arrive_once_over_restarts(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    follow = Follow(spark, lambda: tailing.tail_lines(spark, str(logs / "*.log")), tmp_path)
    append(logs / "a.log", "a1\na2\nhalf")
    follow.trigger()
    assert follow.lines() == ["a1", "a2"]
    append(logs / "a.log", " done\né3\r\n")
    append(logs / "b.log", "b1\n\nb3\n")
    follow.trigger()
    follow.trigger()
    assert follow.lines() == sorted(["a1", "a2", "half done", "é3", "b1", "", "b3"])


def test_one_running_stream_sees_what_is_appended_and_rotated(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    append(logs / "a.log", "1\n")
    follow = Follow(spark, lambda: tailing.tail_lines(spark, str(logs / "*.log")), tmp_path)
    query = follow.make().writeStream.format("parquet").option("checkpointLocation", follow.checkpoint).option("path", follow.out).start()
    query.processAllAvailable()
    append(logs / "a.log", "2\n3\n")
    query.processAllAvailable()
    append(logs / "a.log", "4 before the rename\n")
    (logs / "a.log").rename(logs / "a.log.1")
    append(logs / "a.log", "5 in the new file\n")
    query.processAllAvailable()
    append(logs / "a.log", "6\n")
    query.processAllAvailable()
    query.stop()
    assert follow.lines() == ["1", "2", "3", "4 before the rename", "5 in the new file", "6"]


def test_start_at_end_passes_over_what_is_there(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    append(logs / "access.log", "old\nolder\n")
    follow = Follow(spark, lambda: readers.tail_access_lines(spark, str(logs / "*.log")), tmp_path)
    follow.trigger()
    append(logs / "access.log", "new\n")
    append(logs / "later.log", "all of it\n")
    follow.trigger()
    append(logs / "access.log", "newer\n")
    follow.trigger()
    assert follow.lines("message") == ["all of it", "new", "newer"]


def test_container_lines_are_parsed_as_in_batch(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    rows = [json.dumps({"log": f"line {i}", "stream": "stdout", "time": f"2024-01-01T00:00:0{i}.123456789Z"}) for i in range(5)] + ["no json"]
    append(logs / "c.log", "\n".join(rows[:3]) + "\n")
    follow = Follow(spark, lambda: readers.tail_container_logs(spark, str(logs / "*.log")).select("Body", "ts_nanos", "parsed", "LogAttributes"), tmp_path)
    follow.trigger()
    append(logs / "c.log", "\n".join(rows[3:]) + "\n")
    follow.trigger()
    key = lambda r: (r.Body, r.ts_nanos if r.parsed else None, r.parsed, sorted(r.LogAttributes.items()))
    batch = readers.read_container_logs(spark, str(logs)).select("Body", "ts_nanos", "parsed", "LogAttributes")
    assert sorted(map(key, spark.read.parquet(follow.out).collect()), key=str) == sorted(map(key, batch.collect()), key=str)


@pytest.mark.parametrize("part", [1, 2, 5, 7, 1000])
def test_a_file_in_parts_gives_each_line_once(tmp_path, monkeypatch, part):
    monkeypatch.setattr(tailing, "PART_BYTES", part)
    path = tmp_path / "x.log"
    path.write_bytes(b"one\n\ntwo\r\nthree is longer\nx\nrest")
    reader = tailing.TailReader({"path": str(path)})
    start, end = reader.initialOffset(), reader.latestOffset()
    rows = [row for span in reader.partitions(start, end) for row in reader.read(span)]
    assert [r[2] for r in rows] == ["one", "", "two", "three is longer", "x"]
    path.write_bytes(b"cut\n")
    again = reader.latestOffset()
    assert [row[2] for span in reader.partitions(end, again) for row in reader.read(span)] == ["cut"]


def test_no_files(tmp_path):
    reader = tailing.TailReader({"path": str(tmp_path / "*.log"), "startat": "end"})
    assert reader.initialOffset() == reader.latestOffset() == {"files": {}} and reader.partitions({"files": {}}, {"files": {}}) == []
