"""From envelopes to the stored table, and the operators on that table."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidelog.operators import access, analytics, detect, incident, runtime, search, services
from tidelog.operators.access_ingest import access_to_log, drop_probe_paths, normalize_access, parse_access
from tidelog.operators.ingest import ingest_logs, materialize, stored_columns
from tidelog.sources import readers, sinks

AS_OF = "2024-01-02 00:00:00"
START = dt.datetime(2024, 1, 1, 23, tzinfo=dt.timezone.utc)


def envelope(seconds, body, container="api", severity=""):
    nanos = int((START.timestamp() + seconds) * 10**9) + 7
    pair = lambda k, v: {"key": k, "value": {"stringValue": v}}
    resource = [pair("service.name", container), pair("container.name", container), pair("container.id", f"id-{container}"),
                pair("host.name", "h1"), pair("container.label.com.docker.compose.project", "shop"),
                pair("container.label.com.docker.compose.service", container)]
    record = {"timeUnixNano": str(nanos), "severityText": severity, "body": {"stringValue": body}, "traceId": "t1",
              "attributes": [pair("log.iostream", "stdout")]}
    return (json.dumps({"resourceLogs": [{"resource": {"attributes": resource}, "scopeLogs": [{"logRecords": [record]}]}]}),)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "logs")
    payloads = [envelope(i * 10, f"request {i} took {i} ms") for i in range(100)]
    payloads += [envelope(1000, "error: deadlock found"), envelope(1010, "WARNING low disk"), envelope(5, "  "),
                 envelope(2000, "ok", "web", "DEBUG")]
    rows = ingest_logs(readers.flatten_otlp(spark.createDataFrame(payloads, "value string")), dropped=["DEBUG"])
    sinks.write_logs(rows, path)
    line = '10.0.0.{} - - [01/Jan/2024:23:{:02d}:00 +0000] "GET /{} HTTP/1.1" {} {} "-" "agent"'
    lines = [(line.format(i % 3, i % 60, "healthz" if i % 10 == 0 else f"p{i % 2}?q=1", 502 if i % 25 == 1 else 200, i),) for i in range(100)]
    requests = drop_probe_paths(normalize_access(parse_access(spark.createDataFrame(lines, "message string"))))
    sinks.write_logs(stored_columns(materialize(access_to_log(requests))), path)
    return spark.read.option("mergeSchema", "true").parquet(path)


def test_rows_and_columns(table):
    assert table.count() == 102 + 90
    assert {"LogId", "ContainerName", "ComposeProject", "log_date", "ts_nanos"} <= set(table.columns)
    assert table.select("LogId").distinct().count() == table.count()
    assert {r[0] for r in table.select("SeverityText").distinct().collect()} == {"INFO", "ERROR", "WARN", ""}


def test_services_and_search(table):
    logs = search.not_gateway(table)
    row = services.service_summary(logs, AS_OF).collect()
    assert [(r["service_key"], r["instance_count"], r["log_count"], r["error_count"]) for r in row] == [("h1/shop/api", 1, 102, 1)]
    found = search.search(table, AS_OF, level="warn")
    assert [r["Body"] for r in search.page(found, 0, 10).collect()] == ["WARNING low disk"]
    around = search.context(table, "api", "2024-01-01 23:16:40", 30)
    summary = search.context_summary(around, "2024-01-01 23:16:40").first()
    assert (summary["rows"], summary["errors"], summary["warnings"]) == (5, 1, 1)
    assert search.trace(logs, "t1").count() == 102


def test_patterns_detectors_and_silence(table):
    top = analytics.patterns(table, AS_OF, 60).first()
    assert (top["pattern"], top["frequency"]) == ("request ? took ? ms", 99)
    assert [(r["type"], r["container_name"]) for r in detect.critical_alerts(table).collect()] == [("deadlock", "api")]
    open_silence = detect.silences(table, as_of=AS_OF).collect()
    assert [(r["ContainerId"], r["until"]) for r in open_silence] == [("id-api", None)]
    assert analytics.headline(table, AS_OF).first()["containers"] == 1


def test_requests(table):
    acc = access.access_logs(table)
    overview = access.access_overview(acc, AS_OF, 2).first()
    assert (overview["total_requests"], overview["errors_5xx_exact"], overview["total_bytes"]) == (90, 4, sum(i for i in range(100) if i % 10))
    paths = {r["path"]: r["total"] for r in access.top_paths(acc, AS_OF, 2).collect()}
    assert sum(paths.values()) == 90 and set(paths) == {"/p0", "/p1"}


def test_incident(spark, table):
    acc = access.access_logs(table)
    listed = spark.createDataFrame([(json.dumps({"Id": "abc", "Names": ["/shop-api-1"], "State": "exited", "Status": "Exited"}),)], "value string")
    inspect = spark.createDataFrame([(json.dumps({"Id": "abc", "RestartCount": 2, "State": {"ExitCode": 1, "FinishedAt": "2024-01-01T23:59:00Z"}}),)], "value string")
    snap = runtime.runtime_diagnose(runtime.runtime_rows(readers.parse_runtime_snapshots(listed, inspect)))
    feed = sinks.notification_rows(detect.critical_alerts(table).withColumn("created_at", F.col("Timestamp")))
    args = (table, acc, snap, feed, "h1/shop/api", AS_OF, 1)
    status = incident.incident_status(*args).first()
    assert (status["status"], status["error_logs"], status["runtime_signals"], status["notifications"]) == ("danger", 1, 1, 1)
    timeline = incident.incident_timeline(*args).collect()
    assert {r["source"] for r in timeline} == {"gateway", "application_log", "runtime", "notification"}
    assert [r["timestamp"] for r in timeline] == sorted((r["timestamp"] for r in timeline), reverse=True)
    bundle = json.loads(incident.evidence_bundle(*args).first()["bundle"])
    assert bundle["scope"]["service_key"] == "h1/shop/api" and len(bundle["timeline"]) == len(timeline)
