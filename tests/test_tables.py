"""Files in and out, and the life cycle of the stored table."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidelog.operators import lifecycle
from tidelog.operators.access_ingest import normalize_access, parse_access
from tidelog.sources import readers, sinks


def table(spark, days=10, rows=400):
    return spark.range(rows).select(
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.col("id") % days, F.col("id") % 24)).alias("Timestamp"),
        F.when(F.col("id") % 7 == 0, "nginx").otherwise("app").alias("ServiceName"),
        F.when(F.col("id") % 3 == 0, "ERROR").otherwise("INFO").alias("SeverityText"),
        F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("ContainerName"),
        F.lit("img").alias("ContainerImage"), F.lit("id").alias("ContainerId"), F.lit("h").alias("HostName"),
        F.when(F.col("id") % 2 == 0, "").otherwise("stack").alias("ComposeProject"),
        F.concat(F.lit("body "), F.col("id").cast("string")).alias("Body"),
        F.create_map(F.lit("container.label.com.docker.compose.project"), F.lit("late")).alias("ResourceAttributes"),
    ).withColumn("log_date", F.to_date("Timestamp"))


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "logs")
    sinks.write_logs(table(spark), path)
    return path


def test_container_lines_keep_what_is_no_json(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.log").write_text(
        json.dumps({"log": "hi", "stream": "stderr", "time": "2024-01-02T03:04:05.123456789Z"}) + "\nnot json\n")
    rows = {r["Body"]: r for r in readers.read_container_logs(spark, str(tmp_path)).collect()}
    assert set(rows) == {"hi", "not json"}
    assert rows["hi"]["ts_nanos"] % 10**9 == 123456789
    assert rows["hi"]["LogAttributes"] == {"log.iostream": "stderr"}
    assert rows["not json"]["Timestamp"] is not None  # that of the file


def test_container_events_without_the_collector(spark, tmp_path):
    (tmp_path / "e.json").write_text("\n".join(json.dumps({"container_name": n, "message": "m"}) for n in ("a", "collector")))
    found = readers.read_container_events(spark, str(tmp_path), ["collector"])
    assert [r["container_name"] for r in found.collect()] == ["a"]


def test_access_lines_of_recent_files(spark, tmp_path):
    for name, age in (("new.log", 0), ("old.log", 3 * 86400)):
        (tmp_path / name).write_text(name)
        stamp = dt.datetime.now().timestamp() - age
        os.utime(tmp_path / name, (stamp, stamp))
    assert [r[0] for r in readers.read_access_lines(spark, str(tmp_path)).collect()] == ["new.log"]
    assert readers.read_access_lines(spark, str(tmp_path), None).count() == 2


def test_access_forms(spark):
    lines = [
        '{"client": "1.1.1.1", "request": "GET /a?x=1 HTTP/1.1", "status": 200, "size": 5, "request_time": 0.25}',
        '2.2.2.2 - bob [02/Jan/2024:03:04:05 +0700] "POST /b HTTP/1.1" 404 7 "-" "curl"',
        'prefix 3.3.3.3 - - [02/Jan/2024:03:04:05 +0000] "PUT /c HTTP/1.1" 500 9', '{"broken": ', "nothing", "17", ""]
    rows = normalize_access(parse_access(spark.createDataFrame([(x,) for x in lines], "message string")),
                            F.lit("2024-05-05 00:00:00").cast("timestamp")).collect()
    found = {r["remote_addr"]: (r["method"], r["path"], r["status"], r["bytes_sent"], r["request_time"]) for r in rows}
    assert found == {"1.1.1.1": ("GET", "/a", 200, 5, 0.25), "2.2.2.2": ("POST", "/b", 404, 7, 0.0),
                     "3.3.3.3": ("PUT", "/c", 500, 9, 0.0)}
    times = {r["remote_addr"]: r["timestamp"] for r in rows}
    utc = lambda *a: dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp()
    assert times["2.2.2.2"].timestamp() == utc(2024, 1, 1, 20, 4, 5)
    assert times["1.1.1.1"].timestamp() == utc(2024, 5, 5)


def test_export_is_json_lines_in_time_order(spark, stored, tmp_path):
    sinks.export_logs(spark.read.parquet(stored), str(tmp_path / "out"), ["c1", "c2"], "2024-01-02 00:00:00", "2024-01-08 00:00:00")
    lines = [json.loads(x) for part in sorted((tmp_path / "out").glob("*.json")) for x in part.read_text().splitlines()]
    times = [x["Timestamp"] for x in lines]
    assert lines and times == sorted(times) and {x["ContainerName"] for x in lines} == {"c1", "c2"}
    assert list(lines[0]) == sinks.EXPORT_COLUMNS


def test_notifications_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("spam", "critical", "???? Spam", " m ", "id", "n", dt.datetime(2024, 1, 1))],
                                 "type string, severity string, title string, message string, container_id string, container_name string, created_at timestamp")
    for _ in range(2):
        sinks.write_notifications(rows.unionByName(rows), str(tmp_path / "n"))
    found = spark.read.parquet(str(tmp_path / "n")).collect()
    assert [(r["title"], r["message"], r["read_at"]) for r in found] == [("Spam", "m", None)]


def test_files_are_sorted_and_partitioned(spark, stored):
    assert len(list(os.scandir(stored))) >= 10
    plan = spark.read.parquet(stored).filter("log_date = '2024-01-03'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan


def rows_of(spark, path):
    return sorted(r["Body"] for r in spark.read.parquet(path).collect())


def test_retention_drops_days_only(spark, stored):
    assert lifecycle.apply_retention(spark, stored, "2024-01-12 00:00:00", 5) == 7
    assert {str(r[0]) for r in spark.read.parquet(stored).select("log_date").distinct().collect()} == {
        "2024-01-08", "2024-01-09", "2024-01-10"}


@pytest.mark.parametrize("kind, name, keep", [("container", "c1", "ContainerName <> 'c1'"), ("stack", "stack", "ComposeProject <> 'stack'")])
def test_purge(spark, stored, kind, name, keep):
    expected = sorted(r["Body"] for r in table(spark).filter(keep).collect())
    assert lifecycle.purge(spark, stored, kind, name) == 400 - len(expected)
    assert rows_of(spark, stored) == expected
    assert lifecycle.purge(spark, stored, kind, name) == 0
    with pytest.raises(ValueError):
        lifecycle.purge(spark, stored, "image", "x")


def test_purge_drops_a_day_that_becomes_empty(spark, tmp_path):
    path = str(tmp_path / "one")
    sinks.write_logs(table(spark).filter("log_date <> '2024-01-02' OR ContainerName = 'c1'"), path)
    lifecycle.purge(spark, path, "container", "c1")
    assert "log_date=2024-01-02" not in os.listdir(path)


def test_clear_older_keeps_the_gateway(spark, stored):
    lifecycle.clear_older(spark, stored, 7, "2024-01-12 00:00:00")
    left = spark.read.parquet(stored).filter("Timestamp < '2024-01-05 00:00:00'")
    assert {r[0] for r in left.select("ServiceName").distinct().collect()} == {"nginx"}


def test_archive_clear_and_restore(spark, stored, tmp_path):
    before = rows_of(spark, stored)
    archive = str(tmp_path / "archive")
    assert lifecycle.archive_and_clear(spark, stored, archive) == 400
    assert not [d for d in os.listdir(stored) if d.startswith("log_date")]
    row = lifecycle.restore(spark, archive, str(tmp_path / "again")).first()
    assert row["rows"] == 400 and rows_of(spark, str(tmp_path / "again")) == before


def test_failed_archive_clears_nothing(spark, stored, tmp_path):
    archive = str(tmp_path / "taken")
    os.mkdir(archive)
    with pytest.raises(Exception):
        lifecycle.archive_and_clear(spark, stored, archive)
    assert len(rows_of(spark, stored)) == 400


def test_backfill(spark, stored):
    assert lifecycle.backfill_project(spark, stored) == 200
    found = spark.read.parquet(stored).groupBy("ComposeProject").count().collect()
    assert {r[0]: r[1] for r in found} == {"late": 200, "stack": 200}


def test_dimension_tables(spark, sf_dir):
    a, b = readers.load_dims(spark, f"{sf_dir}/customer.parquet", f"{sf_dir}/supplier.parquet")
    assert a.count() > 0 and b.count() > 0
