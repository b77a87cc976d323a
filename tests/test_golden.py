"""Known inputs with known results."""

import json

import pytest
from pyspark.sql import functions as F

from tidelog.functions.text import clean_text, effective_level, level_predicate, message_pattern
from tidelog.operators import incident, runtime, scope, search, services
from tidelog.operators.ingest import service_identity
from tidelog.sources.readers import parse_runtime_snapshots

SERVICE = "host_id string, service_key string, instance_count bigint, active_instance_count bigint, log_count bigint, error_count bigint"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_overview_of_three_services(spark):
    rows = spark.createDataFrame([
        ("home-server", "home-server/shop-stack/api", 2, 1, 100, 4),
        ("home-server", "home-server/shop-stack/nginx", 1, 1, 50, 0),
        ("test-vm", "test-vm/demo/postgres", 1, 0, 10, 2)], SERVICE)
    assert one(services.overview(rows)) == {
        "hosts": 2, "services": 3, "instances": 4, "active_instances": 2, "logs": 160, "errors": 6,
        "services_with_errors": 2, "inactive_services": 1, "status": "warning"}
    assert services.top_services(rows).first()["service_key"] == "home-server/shop-stack/api"


def test_empty_overview_is_quiet(spark):
    rows = spark.createDataFrame([], SERVICE)
    result = one(services.overview(rows))
    assert (result["services"], result["hosts"], result["status"]) == (0, 0, "quiet")
    assert services.top_services(rows).count() == 0


@pytest.mark.parametrize("attributes, key, instance, confidence", [
    ({"edge_host_id": "home-server", "compose_project": "shop-stack", "compose_service": "api", "container_id": "abc123",
      "container_name": "shop-stack-api-1"}, "home-server/shop-stack/api", "abc123", "high"),
    ({"edge_host_id": "home-server", "compose_project": "shop-stack", "compose_service": "api",
      "container_id": "new-container"}, "home-server/shop-stack/api", "new-container", "high"),
    ({"host.name": "test-vm", "container.name": "nginx-gateway", "container.id": "def456"},
     "test-vm/standalone/nginx-gateway", "def456", "fallback"),
    ({"host_id": "", "edge_host_id": " h "}, "h/standalone/unknown-container", None, "fallback"),
    ({}, "unknown-host/standalone/unknown-container", None, "fallback"),
])
def test_service_identity(spark, attributes, key, instance, confidence):
    df = spark.createDataFrame([(attributes,)], "attributes map<string,string>")
    row = one(service_identity(df))
    assert (row["service_key"], row["instance_key"], row["identity_confidence"]) == (key, instance, confidence)


@pytest.mark.parametrize("text, cleaned", [
    ("???? Database Deadlock", "Database Deadlock"), ("?????? Backup Failed", "Backup Failed"),
    ("???? ?????? twice", "twice"), ("﻿ zero​width ", "zerowidth"), (None, ""), ("?? kept", "?? kept")])
def test_clean_text(spark, text, cleaned):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(clean_text("t")).first()[0] == cleaned


def snapshot(spark):
    listed = [("abc123def456", "/log-backend", "Up 2 minutes (healthy)"), ("def456abc123", "/log-dashboard", "Up 2 minutes"),
              ("badbadbadbad", "/otel-gateway", "Up 2 minutes (unhealthy)")]
    inspected = [("abc123def456", 0, False, 0), ("def456abc123", 2, False, 0), ("badbadbadbad", 1, True, 137)]
    a = spark.createDataFrame([(json.dumps({"Id": i, "Names": [n], "Image": "x", "State": "running", "Status": s}),)
                               for i, n, s in listed], "value string")
    b = spark.createDataFrame([(json.dumps({"Id": i, "RestartCount": r, "State": {"OOMKilled": o, "ExitCode": e}}),)
                               for i, r, o, e in inspected], "value string")
    return runtime.runtime_diagnose(runtime.runtime_rows(parse_runtime_snapshots(a, b)))


def test_runtime_snapshot(spark):
    rows = snapshot(spark)
    assert one(runtime.runtime_summary(rows)) == {"total": 3, "running": 3, "healthy": 1, "unhealthy": 1}
    assert one(runtime.runtime_counts(rows)) == {"restarted": 2, "oom_killed": 1, "exited": 0, "unhealthy": 1}
    found = {r["name"]: (r["diagnostic"], r["display_state"]) for r in rows.collect()}
    assert found == {"log-backend": ("no restart or OOM signal", "running"),
                     "log-dashboard": ("restarted 2 times", "restarted"), "otel-gateway": ("OOM killed", "oom")}
    assert [r["name"] for r in runtime.runtime_signals(rows).collect()] == ["log-dashboard", "otel-gateway"]


def test_gateway_correlation(spark):
    overview = spark.createDataFrame([(100, 5.0, 1.25)], "total_requests bigint, error_rate double, p95_response_time double")
    paths = spark.createDataFrame([(7,)], "errors bigint")
    app = spark.createDataFrame([(3, "2026-07-02 14:00:00")], "app_errors bigint, latest_error_ts string")
    rows = incident.correlate(overview, paths, app)
    result = one(rows)
    assert (result["status"], result["errors_5xx"], result["errors_4xx"], result["app_errors"]) == ("danger", 5, 2, 3)
    assert {r["id"] for r in incident.correlation_signals(rows).collect()} >= {"gateway_5xx", "gateway_slow", "app_errors"}


def test_incident_counts_give_danger(spark):
    row = spark.createDataFrame([(42, 6, 2, 1, 1, 1, 3, 1.2)], """total_logs bigint, error_logs bigint, warning_logs bigint,
        runtime_signals bigint, notifications bigint, critical bigint, gateway_5xx bigint, gateway_p95 double""")
    assert one(incident._status(row))["status"] == "danger"
    calm = row.withColumns({c: F.lit(0).cast("bigint") for c in ("error_logs", "runtime_signals", "critical", "gateway_5xx")})
    assert one(incident._status(calm))["status"] == "warn"


def test_service_container_match(spark):
    svc = spark.createDataFrame([("h/shop/api", "Shop", "api"), ("h/x/db", "x", "db")],
                                "service_key string, compose_project string, compose_service string")
    cont = spark.createDataFrame([("shop-api-1",), ("API",), ("db",), ("shop",), ("",), (None,)], "name string")
    found = {tuple(r) for r in scope.match_containers(svc, cont).collect()}
    assert found == {("h/shop/api", "shop-api-1"), ("h/shop/api", "API"), ("h/x/db", "db")}


LOG = "LogId bigint, Timestamp timestamp_ntz, ServiceName string, ContainerName string, SeverityText string, Body string"


def test_or_does_not_leave_the_scope(spark):
    rows = spark.createDataFrame([(1, None, "a", "mine", "INFO", "x"), (2, None, "a", "other", "ERROR", "x")], LOG)
    own = spark.createDataFrame([("mine", 7, "")], "container_id string, user_id bigint, custom_name string")
    sql = "SELECT LogId FROM logs WHERE SeverityText = 'INFO' OR SeverityText = 'ERROR'"
    assert [r[0] for r in search.query(spark, sql, scope.scoped(rows, own, 7, "developer")).collect()] == [1]
    assert search.query(spark, sql, scope.scoped(rows, own, 8, "developer")).count() == 0
    assert search.query(spark, sql, scope.scoped(rows, own, 8, "admin")).count() == 2
    with pytest.raises(ValueError):
        search.query(spark, "DROP TABLE logs", rows)


def test_levels(spark):
    rows = spark.createDataFrame([("INFO", "ferry left"), ("info", "wrn low"), ("DEBUG", "x"), ("", "fine"), ("FATAL", "x")],
                                 "SeverityText string, Body string")
    assert [r[0] for r in rows.select(effective_level()).collect()] == ["error", "warn", "debug", "", "fatal"]
    count = lambda level: rows.filter(level_predicate(level)).count()
    assert [count(x) for x in ("error", "warn", "info", "debug", "fatal")] == [1, 1, 0, 1, 1]


def test_effective_level_reads_the_first_characters_only(spark):
    rows = spark.createDataFrame([("info", "x" * 300 + " ERROR")], "SeverityText string, Body string")
    assert rows.select(effective_level()).first()[0] == "info"
    assert rows.select(effective_level(scan=None)).first()[0] == "error"


def test_pattern_forms(spark):
    rows = spark.createDataFrame([("2024-01-15 14:23:45 192.168.1.1 GET /api ok 42",)], "Body string")
    assert rows.select(message_pattern()).first()[0] == "GET /api ok ?"
    assert rows.select(message_pattern(literal=True)).first()[0] == "?-?-? ?:?:?  GET /api ok ?"
