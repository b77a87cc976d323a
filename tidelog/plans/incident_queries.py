"""Queries of runtime snapshots and incident evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import access, incident, runtime, scope
from tidelog.plans import views
from tidelog.plans.access_queries import _OVERVIEW, _PATHS
from tidelog.plans.analytics_queries import SERVICES
from tidelog.plans.registry import AS_OF, REGISTRY, given, register

KEY = "host-1/stack-1/app-1"
HOURS = 24

_ROWS = """
SELECT id, CASE WHEN raw_name = '' THEN substr(id, 1, 12) ELSE raw_name END AS name, substr(id, 1, 12) AS short_id,
  CASE WHEN raw_image = '' THEN 'unknown' ELSE raw_image END AS image,
  CASE WHEN raw_state = '' THEN 'unknown' ELSE raw_state END AS state,
  CASE WHEN raw_status = '' THEN CASE WHEN raw_state = '' THEN 'unknown' ELSE raw_state END ELSE raw_status END AS status,
  CASE WHEN contains(raw_status, '(healthy)') THEN 'healthy' WHEN contains(raw_status, '(unhealthy)') THEN 'unhealthy'
    WHEN raw_state = '' THEN 'unknown' ELSE raw_state END AS health,
  inspected, restart_count, oom_killed, exit_code, started_at, finished_at FROM snap"""
_DIAG = """
SELECT *, CASE WHEN NOT inspected THEN 'runtime snapshot only' WHEN oom_killed THEN 'OOM killed'
    WHEN restart_count > 0 THEN concat('restarted ', restart_count, ' times') WHEN state <> 'running' THEN concat('exited with code ', exit_code)
    WHEN health = 'unhealthy' THEN 'health check failing' ELSE 'no restart or OOM signal' END AS diagnostic,
  CASE WHEN oom_killed THEN 'oom' WHEN state <> 'running' THEN 'stopped' WHEN restart_count > 0 THEN 'restarted'
    WHEN health = 'unhealthy' THEN 'unhealthy' ELSE 'running' END AS display_state,
  oom_killed OR restart_count > 0 OR state <> 'running' OR health = 'unhealthy' AS is_signal
FROM rt"""
_RUNTIME = given("snap", rt=_ROWS, diag=_DIAG)


def containers(spark, sf):
    return runtime.runtime_diagnose(runtime.runtime_rows(views.snapshots(spark, sf)))


@register("runtime_rows", "RT-1", _RUNTIME + "SELECT id, name, short_id, image, state, status, health FROM rt")
def runtime_rows(spark, sf):
    return runtime.runtime_rows(views.snapshots(spark, sf)).select(
        "id", "name", "short_id", "image", "state", "status", "health")


@register("runtime_totals", "RT-1", _RUNTIME + """
SELECT count(*) AS total, count(*) FILTER (WHERE state = 'running') AS running, count(*) FILTER (WHERE health = 'healthy') AS healthy,
  count(*) FILTER (WHERE health = 'unhealthy') AS unhealthy FROM rt""")
def runtime_totals(spark, sf):
    return runtime.runtime_summary(containers(spark, sf))


@register("runtime_diagnoses", "RT-2", _RUNTIME + """
SELECT id, name, restart_count, oom_killed, exit_code, started_at, finished_at, diagnostic, display_state FROM diag""")
def runtime_diagnoses(spark, sf):
    return containers(spark, sf).select("id", "name", "restart_count", "oom_killed", "exit_code", "started_at",
                                        "finished_at", "diagnostic", "display_state")


@register("runtime_counts", "RT-3", _RUNTIME + """
SELECT count(*) FILTER (WHERE restart_count > 0) AS restarted, count(*) FILTER (WHERE oom_killed) AS oom_killed,
  count(*) FILTER (WHERE state <> 'running') AS exited, count(*) FILTER (WHERE health = 'unhealthy') AS unhealthy FROM diag""")
def runtime_counts(spark, sf):
    return runtime.runtime_counts(containers(spark, sf))


@register("runtime_signals", "RT-3", _RUNTIME + """
SELECT name, id, state, health, diagnostic FROM diag WHERE is_signal ORDER BY name, id LIMIT 12""")
def runtime_signals(spark, sf):
    return runtime.runtime_signals(containers(spark, sf)).select("name", "id", "state", "health", "diagnostic")


def _correlation(hours: float, exact: bool) -> str:
    minutes = incident.window_minutes(hours)
    since = f"{AS_OF} - INTERVAL {minutes} MINUTE"
    overview = _OVERVIEW[:_OVERVIEW.index("WHERE Timestamp >=")] + f"WHERE Timestamp >= {since}"
    paths = _PATHS.replace(_PATHS[_PATHS.index("WHERE Timestamp"):_PATHS.index(" AND path")], f"WHERE Timestamp >= {since}")
    e5 = "errors_5xx_exact" if exact else "CAST(round_even(total_requests * error_rate / 100, 0) AS BIGINT)"
    e4 = "exact_4xx" if exact else f"greatest(0, path_errors - {e5})"
    return f"""o AS ({overview}), p AS (SELECT CAST(coalesce(sum(errors), 0) AS BIGINT) AS path_errors FROM ({paths} LIMIT 5)),
x AS (SELECT count(*) AS exact_4xx FROM acc WHERE Timestamp >= {since} AND status BETWEEN 400 AND 499),
a AS (SELECT count(*) FILTER (WHERE bad) AS app_errors, max(Timestamp) FILTER (WHERE bad) AS latest_error_ts FROM (
  SELECT Timestamp, SeverityText IN ('ERROR', 'FATAL') OR contains(lower(Body), 'error') AS bad FROM logs
  WHERE ServiceName <> 'nginx' AND Timestamp >= {since})),
f AS (SELECT total_requests, {e4} AS errors_4xx, {e5} AS errors_5xx, p95_response_time, app_errors, latest_error_ts FROM o, p, a, x),
corr AS (SELECT CASE WHEN errors_5xx > 0 OR p95_response_time >= 1 THEN 'danger'
  WHEN errors_4xx > 0 OR p95_response_time >= 0.3 OR app_errors > 0 THEN 'warn' ELSE 'quiet' END AS status, * FROM f),
sig AS (SELECT 1 AS rank, 'gateway_5xx' AS id, 'danger' AS severity, 'Gateway 5xx' AS label, concat(errors_5xx, ' server errors in window') AS detail, 'network-errors' AS action FROM corr WHERE errors_5xx > 0
  UNION ALL SELECT 2, 'gateway_4xx', 'warn', 'Gateway 4xx', concat(errors_4xx, ' client errors in window'), 'network-4xx' FROM corr WHERE errors_4xx > 0
  UNION ALL SELECT 3, 'gateway_slow', CASE WHEN p95_response_time >= 1 THEN 'danger' ELSE 'warn' END, CASE WHEN p95_response_time >= 1 THEN 'Slow gateway path' ELSE 'Gateway latency' END,
    concat(printf('%.3f', p95_response_time), 's p95 latency'), 'network-paths' FROM corr WHERE p95_response_time >= 0.3
  UNION ALL SELECT 4, 'app_errors', 'warn', 'App logs in same window', concat(app_errors, ' app error logs nearby'), 'app-errors' FROM corr WHERE app_errors > 0)"""


def _correlated(hours: float, exact: bool = False, *tables: str) -> str:
    return given("logs", "acc", *tables).rstrip() + ",\n" + _correlation(hours, exact) + "\n"


@register("gateway_correlation", "INC-1", _correlated(HOURS) + "SELECT * FROM corr")
def gateway_correlation(spark, sf):
    return incident.gateway_correlation(views.logs(spark, sf), views.access(spark, sf), views.AS_OF, HOURS)


@register("gateway_correlation_exact", "INC-1", _correlated(HOURS, True) + "SELECT * FROM corr")
def gateway_correlation_exact(spark, sf):
    return incident.gateway_correlation(views.logs(spark, sf), views.access(spark, sf), views.AS_OF, HOURS, True)


@register("correlation_signals", "INC-1", _correlated(HOURS) + "SELECT rank, id, severity, label, detail, action FROM sig")
def correlation_signals(spark, sf):
    rows = incident.gateway_correlation(views.logs(spark, sf), views.access(spark, sf), views.AS_OF, HOURS)
    return incident.correlation_signals(rows).drop("latest_error_ts")


_OF_SERVICE = "HostName = 'host-1' AND ComposeProject = 'stack-1' AND (CASE WHEN ComposeService = '' THEN ContainerName ELSE ComposeService END) = 'app-1'"
_ERR_TEXT = "(contains(lower(Body), 'error') OR contains(lower(Body), 'exception') OR contains(lower(Body), 'timeout'))"


def _incident_summary(minutes: int) -> str:
    return f"""
SELECT count(*) AS total_logs, count(*) FILTER (WHERE SeverityText IN ('ERROR', 'FATAL') OR {_ERR_TEXT}) AS error_logs,
  count(*) FILTER (WHERE SeverityText IN ('WARN', 'WARNING')) AS warning_logs, max(Timestamp) AS latest_log_ts,
  arg_max(ContainerName, Timestamp) AS sample_container_name
FROM logs WHERE {_OF_SERVICE} AND Timestamp >= {AS_OF} - INTERVAL {minutes} MINUTE"""


def _incident_events(minutes: int, n: int) -> str:
    return f"""
SELECT Timestamp, LogId, ContainerName, CASE WHEN SeverityText = '' THEN 'INFO' ELSE upper(SeverityText) END AS SeverityText,
  CASE WHEN SeverityText IN ('ERROR', 'FATAL') OR contains(lower(Body), 'error') OR contains(lower(Body), 'exception') THEN 'danger' ELSE 'warn' END AS severity,
  substr(Body, 1, 220) AS detail
FROM logs WHERE {_OF_SERVICE} AND Timestamp >= {AS_OF} - INTERVAL {minutes} MINUTE
  AND (SeverityText IN ('ERROR', 'FATAL', 'WARN', 'WARNING') OR {_ERR_TEXT})
ORDER BY Timestamp DESC, LogId DESC LIMIT {n}"""


ALL = views.HOURS * 60


@register("incident_summary", "INC-2", given("logs") + _incident_summary(ALL))
def incident_summary(spark, sf):
    return incident.incident_summary(views.logs(spark, sf), KEY, views.AS_OF, ALL)


@register("incident_events", "INC-3", given("logs") + _incident_events(ALL, 12))
def incident_events(spark, sf):
    return incident.incident_events(views.logs(spark, sf), KEY, views.AS_OF, ALL)


@register("service_containers", "INC-4", SERVICES.rstrip() + f""",
snap AS ({views.RUNTIME_SQL}), rt AS ({_ROWS}), s AS (SELECT DISTINCT service_key, lower(compose_project) AS p, lower(compose_service) AS s FROM keyed_svc)
SELECT DISTINCT service_key, name AS container_name FROM s, rt
WHERE (contains(lower(name), p) AND contains(lower(name), s)) OR lower(name) = s""".replace("keyed_svc", "svc"))
def service_containers(spark, sf):
    from tidelog.plans.analytics_queries import summary
    return scope.match_containers(summary(spark, sf), containers(spark, sf))


_MATCH = "((contains(lower(n), 'stack-1') AND contains(lower(n), 'app-1')) OR lower(n) = 'app-1')"
_MIN = incident.window_minutes(HOURS)
_RECENT = f"""
SELECT * FROM (SELECT *, coalesce(nullif(container_name, ''), container_id) AS n FROM notif
  WHERE created_at >= {AS_OF} - INTERVAL {_MIN} MINUTE) WHERE {_MATCH}"""
_EVIDENCE = (given("logs", "acc", "snap", "notif").rstrip() + f""",
rt AS ({_ROWS}), diag AS ({_DIAG}), bad AS (SELECT * FROM (SELECT *, name AS n FROM diag WHERE is_signal) WHERE {_MATCH}),
recent AS ({_RECENT}), ev AS ({_incident_events(_MIN, 8)}), sm AS ({_incident_summary(_MIN)}),
{_correlation(HOURS, False)}
""")
_TIMELINE = f"""
SELECT * FROM (
SELECT coalesce(latest_error_ts, {AS_OF}) AS timestamp, 'gateway' AS source, severity, label AS title, detail, action, '' AS level, 'gateway' AS badge
  FROM (SELECT * FROM sig ORDER BY rank LIMIT 3), (SELECT latest_error_ts FROM corr)
UNION ALL SELECT Timestamp, 'application_log', severity, concat(SeverityText, ' in ', ContainerName), detail, 'logs',
  CASE WHEN severity = 'danger' THEN 'ERROR' ELSE '' END, ContainerName FROM ev
UNION ALL SELECT * FROM (SELECT coalesce(CAST(finished_at AS TIMESTAMP), CAST(started_at AS TIMESTAMP), {AS_OF}), 'runtime',
  CASE WHEN oom_killed OR health = 'unhealthy' OR state <> 'running' THEN 'danger' ELSE 'warn' END, name, diagnostic, 'runtime', '', 'runtime'
  FROM bad ORDER BY name, id LIMIT 6)
UNION ALL SELECT * FROM (SELECT created_at, 'notification', CASE WHEN severity = 'critical' THEN 'danger' ELSE 'warn' END,
  trim(concat('Notice ', regexp_extract(title, '[a-z]+ $'))), trim(message), 'alerts', '', type FROM recent ORDER BY created_at DESC, id DESC LIMIT 6)
) ORDER BY timestamp DESC, source, title, detail LIMIT 18"""


@register("incident_timeline", "INC-5", _EVIDENCE + _TIMELINE)
def incident_timeline(spark, sf):
    return incident.incident_timeline(views.logs(spark, sf), views.access(spark, sf), containers(spark, sf),
                                      views.notifications(spark, sf), KEY, views.AS_OF, HOURS)


@register("incident_status", "INC-6", _EVIDENCE + """
, c AS (SELECT total_logs, error_logs, warning_logs, (SELECT count(*) FROM bad) AS runtime_signals, (SELECT count(*) FROM recent) AS notifications,
  errors_5xx AS gateway_5xx, p95_response_time AS gateway_p95, (SELECT count(*) FROM recent WHERE severity = 'critical') AS critical FROM sm, corr)
SELECT * EXCLUDE (critical), CASE WHEN error_logs > 0 OR runtime_signals > 0 OR gateway_5xx > 0 OR critical > 0 THEN 'danger'
  WHEN warning_logs > 0 OR notifications > 0 THEN 'warn' ELSE 'quiet' END AS status FROM c""")
def incident_status(spark, sf):
    return incident.incident_status(views.logs(spark, sf), views.access(spark, sf), containers(spark, sf),
                                    views.notifications(spark, sf), KEY, views.AS_OF, HOURS)


@register("evidence_bundle", "INC-7")
def evidence_bundle(spark, sf):
    return incident.evidence_bundle(views.logs(spark, sf), views.access(spark, sf), containers(spark, sf),
                                    views.notifications(spark, sf), KEY, views.AS_OF, HOURS)


_BUNDLE = """scope STRUCT<service_key: STRING, window_minutes: BIGINT>,
summary STRUCT<total_logs: BIGINT, error_logs: BIGINT, warning_logs: BIGINT, runtime_signals: BIGINT, notifications: BIGINT, gateway_5xx: BIGINT, gateway_p95: DOUBLE>,
timeline ARRAY<STRUCT<timestamp: TIMESTAMP_NTZ, source: STRING, severity: STRING, title: STRING, detail: STRING, action: STRING, level: STRING, badge: STRING>>"""


# JSON has milliseconds.
@register("evidence_bundle_events", "INC-7", _EVIDENCE + f"SELECT * REPLACE (date_trunc('millisecond', timestamp) AS timestamp) FROM ({_TIMELINE})")
def evidence_bundle_events(spark, sf):
    """The timeline in the bundle's JSON, as rows."""
    found = evidence_bundle(spark, sf).select(F.from_json("bundle", _BUNDLE).alias("b"))
    return found.select(F.inline("b.timeline"))


@register("evidence_bundle_summary", "INC-7", REGISTRY["incident_status"].oracle.replace(
    "SELECT * EXCLUDE (critical),", f"SELECT * EXCLUDE (critical), '{KEY}' AS service_key, {_MIN} AS window_minutes,"))
def evidence_bundle_summary(spark, sf):
    """Scope, summary and status in the bundle's JSON, as a row."""
    found = evidence_bundle(spark, sf).select("status", F.from_json("bundle", _BUNDLE).alias("b"))
    return found.select("b.summary.*", "b.scope.*", "status")


@register("drill_windows", "INC-8", given("logs") + """
, e AS (SELECT ContainerName, max(Timestamp) AS anchor_ts FROM logs WHERE SeverityText = 'WARN' GROUP BY ContainerName)
SELECT l.ContainerName, anchor_ts, LogId, Timestamp, epoch_us(Timestamp) - epoch_us(anchor_ts) AS delta_us
FROM logs l JOIN e ON l.ContainerName = e.ContainerName AND Timestamp BETWEEN anchor_ts - INTERVAL 300 MINUTE AND anchor_ts + INTERVAL 300 MINUTE""")
def drill_windows(spark, sf):
    rows = views.logs(spark, sf)
    events = rows.filter(F.col("SeverityText") == "WARN").groupBy("ContainerName").agg(F.max("Timestamp").alias("anchor_ts"))
    return incident.drill_window(events, rows, 300).select("ContainerName", "anchor_ts", "LogId", "Timestamp", "delta_us")
