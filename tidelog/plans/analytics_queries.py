"""Queries of service roll-ups and log aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import fixed
from tidelog.operators import analytics, services
from tidelog.operators.access import access_overview
from tidelog.operators.runtime import runtime_rows, runtime_summary
from tidelog.plans import views
from tidelog.plans.registry import AS_OF, SINCE, given, register

_E = "(lower(SeverityText) = 'error' OR contains(upper(Body), 'ERR'))"
_BODY_ERR = "contains(upper(Body), 'ERR')"
_W = "(lower(SeverityText) IN ('warn', 'warning') OR contains(upper(Body), 'WARN') OR contains(upper(Body), 'WRN'))"

_KEYED = """
SELECT *, CASE WHEN HostName = '' THEN 'unknown-host' ELSE HostName END AS host_id,
  CASE WHEN ComposeProject = '' THEN 'standalone' ELSE ComposeProject END AS compose_project,
  CASE WHEN ComposeService = '' THEN ContainerName ELSE ComposeService END AS compose_service FROM logs"""
_SVC = f"""
SELECT concat(host_id, '/', compose_project, '/', compose_service) AS service_key, host_id, compose_project, compose_service,
  max(Timestamp) AS last_seen, count(DISTINCT ContainerId) AS instance_count,
  count(DISTINCT CASE WHEN Timestamp >= {AS_OF} - INTERVAL 5 MINUTE THEN ContainerId END) AS active_instance_count,
  count(*) AS log_count, count(*) FILTER (WHERE lower(SeverityText) IN ('error', 'fatal')) AS error_count,
  arg_max(ContainerName, Timestamp) AS sample_container_name
FROM keyed WHERE Timestamp >= {SINCE} GROUP BY ALL"""
SERVICES = given("logs", keyed=_KEYED, svc=_SVC)


def summary(spark, sf):
    """All services: the displayed list alone is limited."""
    return services.service_summary(views.logs(spark, sf), views.AS_OF, views.HOURS, limit=None)


@register("service_summary", "AN-4", SERVICES + "SELECT * FROM svc ORDER BY last_seen DESC LIMIT 500")
def service_summary(spark, sf):
    return services.service_summary(views.logs(spark, sf), views.AS_OF, views.HOURS)


@register("headline", "AN-1", given("logs") + f"""
SELECT count(*) AS total, count(*) FILTER (WHERE {_E}) AS errors,
  count(*) FILTER (WHERE {_W} AND NOT {_BODY_ERR}) AS warnings, count(DISTINCT ContainerName) AS containers
FROM logs WHERE Timestamp > {SINCE}""")
def headline(spark, sf):
    return analytics.headline(views.logs(spark, sf), views.AS_OF, views.HOURS)


_LIST = f"""
SELECT ContainerName, CASE WHEN ComposeProject = '' THEN 'Other' ELSE ComposeProject END AS compose_project,
  max(Timestamp) AS last_seen, count(*) AS log_count, count(*) FILTER (WHERE lower(SeverityText) = 'error') AS error_count
FROM logs WHERE Timestamp > {SINCE} GROUP BY ALL"""


@register("container_list", "AN-2", given("logs") + _LIST + " ORDER BY compose_project, last_seen DESC LIMIT 100")
def container_list(spark, sf):
    return services.container_list(views.logs(spark, sf), views.AS_OF, views.HOURS)


@register("activity", "AN-3", given("logs", l=_LIST) + f"""
SELECT ContainerName, compose_project, (epoch_us({AS_OF}) - epoch_us(last_seen)) / 1000000.0::DOUBLE AS age_seconds,
  CASE WHEN (epoch_us({AS_OF}) - epoch_us(last_seen)) < 6000000000 THEN 'green'
    WHEN (epoch_us({AS_OF}) - epoch_us(last_seen)) < 30000000000 THEN 'amber' ELSE 'red' END AS dot FROM l""")
def activity(spark, sf):
    rows = services.container_list(views.logs(spark, sf), views.AS_OF, views.HOURS, limit=None)
    return services.activity(rows, views.AS_OF, 6000, 30000).select(
        "ContainerName", "compose_project", "age_seconds", "dot")


@register("overview", "AN-5", SERVICES + """
SELECT count(DISTINCT host_id) AS hosts, count(DISTINCT service_key) AS services,
  sum(instance_count)::BIGINT AS instances, sum(active_instance_count)::BIGINT AS active_instances,
  sum(log_count)::BIGINT AS logs, sum(error_count)::BIGINT AS errors,
  count(*) FILTER (WHERE error_count > 0) AS services_with_errors,
  count(*) FILTER (WHERE instance_count > 0 AND active_instance_count = 0) AS inactive_services,
  CASE WHEN count(*) = 0 THEN 'quiet' WHEN count(*) FILTER (WHERE error_count > 0 OR active_instance_count = 0) > 0 THEN 'warning' ELSE 'healthy' END AS status
FROM svc""")
def overview(spark, sf):
    return services.overview(summary(spark, sf))


@register("top_error_services", "AN-6", SERVICES + """
SELECT service_key, error_count, log_count FROM svc WHERE error_count > 0
ORDER BY error_count DESC, log_count DESC, service_key LIMIT 5""")
def top_error_services(spark, sf):
    return services.top_services(summary(spark, sf)).select("service_key", "error_count", "log_count")


@register("busiest_services", "AN-6", SERVICES + "SELECT service_key, log_count FROM svc ORDER BY log_count DESC, service_key LIMIT 8")
def busiest_services(spark, sf):
    return services.top_services(summary(spark, sf), by="logs").select("service_key", "log_count")


@register("focus_service", "AN-7", SERVICES + """
SELECT service_key, error_count, log_count FROM svc ORDER BY error_count DESC, log_count DESC, service_key LIMIT 1""")
def focus_service(spark, sf):
    return services.focus_service(summary(spark, sf)).select("service_key", "error_count", "log_count")


_VOLUME = """count(*) AS total, count(*) FILTER (WHERE lower(SeverityText) = 'error') AS errors,
  count(*) FILTER (WHERE lower(SeverityText) IN ('warn', 'warning')) AS warnings"""


@register("daily_volume", "AN-8", given("logs") + f"""
SELECT CAST(date_trunc('day', Timestamp + INTERVAL 7 HOUR) AS TIMESTAMP) AS t, {_VOLUME} FROM logs WHERE Timestamp > {SINCE} GROUP BY 1""")
def daily_volume(spark, sf):
    return analytics.volume(views.logs(spark, sf), views.AS_OF, views.HOURS, fixed.DISPLAY_TIMEZONE)


@register("hourly_volume", "AN-8", given("logs") + f"""
SELECT date_trunc('hour', Timestamp) AS t, {_VOLUME} FROM logs
WHERE Timestamp > {AS_OF} - INTERVAL 167 HOUR GROUP BY 1""")
def hourly_volume(spark, sf):
    return analytics.volume(views.logs(spark, sf), views.AS_OF, 167)


@register("severity_distribution", "AN-9", given("logs") + f"""
SELECT CASE WHEN SeverityText = '' THEN 'unknown' ELSE lower(SeverityText) END AS lvl, count(*) AS c
FROM logs WHERE Timestamp > {SINCE} GROUP BY 1""")
def severity_distribution(spark, sf):
    return analytics.severity_dist(views.logs(spark, sf), "2023-12-31 00:00:00")


@register("search_histogram", "AN-10", given("logs") + f"""
SELECT date_trunc('hour', Timestamp + INTERVAL 7 HOUR) AS h, count(*) AS cnt FROM logs
WHERE Timestamp > {SINCE} AND {_E} GROUP BY 1""")
def search_histogram(spark, sf):
    from tidelog.operators.search import search
    rows = search(views.logs(spark, sf), views.AS_OF, level="error", hours=views.HOURS)
    return analytics.histogram(rows, fixed.DISPLAY_TIMEZONE)


# Bodies with a leading timestamp, so that stripping it matters.
_STAMPED = "SELECT * REPLACE (concat(strftime(Timestamp, '%Y-%m-%d %H:%M:%S.%f'), ' ', Body) AS Body) FROM logs"


def _stamped(spark, sf):
    stamp = F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return views.logs(spark, sf).withColumn("Body", F.concat_ws(" ", stamp, F.col("Body")))


def _pattern_sql(timestamp: str) -> str:
    return given("logs", stamped=_STAMPED) + f"""
SELECT ltrim(regexp_replace(regexp_replace(Body, '{timestamp}|{fixed.IPV4_RE}', '', 'g'), '{fixed.MASK_RE}', '?', 'g')) AS pattern,
  count(*) AS frequency, min(Timestamp) AS first_seen, max(Timestamp) AS last_seen, min(SeverityText) AS severity
FROM stamped WHERE Timestamp > {AS_OF} - INTERVAL {views.HOURS * 60} MINUTE AND SeverityText <> 'DEBUG' AND ServiceName <> 'nginx'
GROUP BY 1 ORDER BY frequency DESC, pattern LIMIT 50"""


@register("message_patterns", "AN-11", _pattern_sql(fixed.TIMESTAMP_RE))
def message_patterns(spark, sf):
    return analytics.patterns(_stamped(spark, sf), views.AS_OF, views.HOURS * 60)


@register("message_patterns_bounded", "AN-11", _pattern_sql(fixed.TIMESTAMP_RE).replace(
    "count(*) AS frequency,", "count(*) AS frequency, count(*) * 10000 * 1000 > sum(count(*)) OVER () * 5250 AS certain,"))
def message_patterns_bounded(spark, sf):
    return analytics.heavy_patterns(_stamped(spark, sf), views.AS_OF, views.HOURS * 60, tracked=10_000)


@register("message_patterns_literal", "AN-11", _pattern_sql(fixed.TIMESTAMP_RE + " " * 7))
def message_patterns_literal(spark, sf):
    return analytics.patterns(_stamped(spark, sf), views.AS_OF, views.HOURS * 60, literal=True)


@register("pattern_search_terms", "AN-12", """
WITH p AS (SELECT doc_id, regexp_replace(text, '[0-9]+', '?', 'g') AS pattern FROM documents)
SELECT doc_id, array_to_string(list_slice(list_filter(regexp_split_to_array(pattern, '[\\s?]+'),
  lambda t: regexp_matches(t, '[a-zA-Z]') AND length(t) >= 2), 1, 4), ' ') AS terms FROM p""")
def pattern_search_terms(spark, sf):
    docs = views.table(spark, sf, "documents").select(
        "doc_id", F.regexp_replace("text", "[0-9]+", "?").alias("pattern"))
    return analytics.pattern_terms(docs).select("doc_id", "terms")


@register("layer_status", "AN-13", given("acc", "snap", "notif") + f"""
, r AS (SELECT count(*) AS total, count(*) FILTER (WHERE (CASE WHEN raw_state = '' THEN 'unknown' ELSE raw_state END) = 'running') AS running,
    count(*) FILTER (WHERE contains(lower(raw_status), '(unhealthy)')) AS unhealthy FROM snap),
g AS (SELECT count(*) AS n, count(*) FILTER (WHERE status >= 500) / count(*) * 100 AS rate, quantile_cont(request_time, 0.95) AS p95 FROM acc),
c AS (SELECT raw_state = 'running' AS ok, p_layer FROM (SELECT raw_state, CASE WHEN raw_status = '' THEN 'pipeline' ELSE 'uptime' END AS p_layer FROM snap)),
u AS (SELECT count(*) FILTER (WHERE read_at IS NULL) AS unread FROM notif)
SELECT 'container' AS layer, CASE WHEN unhealthy > 0 THEN 'danger' ELSE 'ok' END AS status, concat(running, '/', total, ' running') AS value FROM r
UNION ALL SELECT 'gateway', CASE WHEN rate >= 5 OR p95 >= 1 THEN 'danger' WHEN rate >= 1 OR p95 >= 0.3 THEN 'warn' ELSE 'ok' END, concat(n, ' req') FROM g
UNION ALL SELECT 'pipeline', CASE WHEN count(*) FILTER (WHERE NOT ok) > 0 THEN 'warn' ELSE 'ok' END, CASE WHEN count(*) FILTER (WHERE NOT ok) > 0 THEN 'Degraded' ELSE 'Healthy' END FROM c WHERE p_layer = 'pipeline'
UNION ALL SELECT 'uptime', CASE WHEN count(*) FILTER (WHERE NOT ok) > 0 THEN 'warn' ELSE 'ok' END, CASE WHEN count(*) FILTER (WHERE NOT ok) > 0 THEN 'Degraded' ELSE 'Surfaces up' END FROM c WHERE p_layer = 'uptime'
UNION ALL SELECT 'alerts', CASE WHEN unread > 0 THEN 'warn' ELSE 'missing' END, concat(unread, ' unread') FROM u""")
def layer_status(spark, sf):
    snapshots = views.snapshots(spark, sf)
    checks = snapshots.select(
        F.when(F.col("raw_status") == "", "pipeline").otherwise("uptime").alias("layer"),
        F.when(F.col("raw_state") == "running", "ok").otherwise("failed").alias("status"))
    unread = views.notifications(spark, sf).agg(F.count_if(F.col("read_at").isNull()).alias("unread"))
    return analytics.layer_status(runtime_summary(runtime_rows(snapshots)),
                                  access_overview(views.access(spark, sf), views.AS_OF, views.HOURS), checks, unread)
