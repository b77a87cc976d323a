"""Queries of row scope, search and drill-down."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions.text import effective_level, level_predicate, text_match
from tidelog.operators import scope, search
from tidelog.plans import views
from tidelog.plans.registry import AS_OF, SINCE, given, register

_ERR = "(lower(SeverityText) = 'error' OR contains(upper(Body), 'ERR'))"
_WARN = "(lower(SeverityText) IN ('warn', 'warning') OR contains(upper(Body), 'WARN') OR contains(upper(Body), 'WRN'))"
_OWN = "(SELECT container_id FROM ownership WHERE user_id = 3)"


@register("scoped_rows", "SCP-1", given("logs", "ownership") + f"""
SELECT LogId, ContainerName FROM logs
WHERE ContainerName IN {_OWN} AND (SeverityText = 'ERROR' OR contains(Body, 'req 1'))""")
def scoped_rows(spark, sf):
    rows = scope.scoped(views.logs(spark, sf), views.ownership(spark, sf), 3, "developer")
    return search.query(spark, "SELECT LogId, ContainerName FROM logs WHERE SeverityText = 'ERROR' OR contains(Body, 'req 1')",
                        rows)


@register("requested_scope", "SCP-2", given("logs", "ownership") + f"""
SELECT LogId, ContainerName FROM logs WHERE ContainerName IN {_OWN} AND ContainerName IN ('svc-0', 'svc-1', 'svc-2', 'svc-3')""")
def requested_scope(spark, sf):
    rows = scope.scope_request(views.logs(spark, sf), views.ownership(spark, sf), 3, "developer",
                               ["svc-0", "svc-1", "svc-2", "svc-3"])
    return rows.select("LogId", "ContainerName")


@register("auto_assigned", "SCP-3", given("logs", "users", "ownership") + """
, logins AS (SELECT login, min(id) AS user_id FROM (
    SELECT id, lower(trim(username)) AS login FROM users
    UNION ALL SELECT id, split_part(lower(trim(username)), '@', 1) FROM users) GROUP BY login),
images AS (SELECT DISTINCT ContainerName AS container_id, concat('user', substr(ContainerId, 5)) AS login FROM logs
  WHERE CAST(substr(ContainerId, 5) AS BIGINT) % 6 > 1)
SELECT DISTINCT container_id, user_id FROM images JOIN logins USING (login)
WHERE (container_id, user_id) NOT IN (SELECT container_id, user_id FROM ownership)""")
def auto_assigned(spark, sf):
    return scope.auto_assign(views.image_logs(spark, sf), views.users(spark, sf), views.ownership(spark, sf),
                             [views.REGISTRY, "registry.example.org"])


@register("ownership_report", "SCP-4", given("users", "ownership") + """
SELECT container_id, container_id AS container_name, user_id, username, role, custom_name
FROM ownership JOIN users ON user_id = id""")
def ownership_report(spark, sf):
    return scope.ownership_report(views.ownership(spark, sf), views.users(spark, sf))


@register("container_aliases", "SCP-5", given("logs", "ownership") + """
SELECT LogId, ContainerName, coalesce(nullif(custom_name, ''), ContainerName) AS display_name
FROM logs LEFT JOIN (SELECT container_id, max(custom_name) AS custom_name FROM ownership WHERE user_id = 4 GROUP BY container_id)
  ON container_id = ContainerName""")
def container_aliases(spark, sf):
    return scope.with_alias(views.logs(spark, sf), views.ownership(spark, sf), 4).select(
        "LogId", "ContainerName", "display_name")


_KEY_SERVICE = "CASE WHEN ComposeService = '' THEN ContainerName ELSE ComposeService END"


@register("service_rows", "SCP-6", given("logs") + f"""
SELECT LogId, HostName, ComposeProject FROM logs
WHERE HostName = 'host-1' AND ComposeProject = 'stack-1' AND {_KEY_SERVICE} = 'app-1'""")
def service_rows(spark, sf):
    return scope.service_scope(views.logs(spark, sf), "host-1/stack-1/app-1").select("LogId", "HostName", "ComposeProject")


@register("search_rows", "SRH-1", given("logs") + f"""
SELECT LogId, Timestamp, ContainerName, SeverityText, Body, TraceId FROM logs
WHERE Timestamp > {SINCE} AND ServiceName <> 'nginx' AND ContainerName IN ('svc-1', 'svc-2', 'svc-4')
  AND {_ERR} AND (contains(lower(Body), 'req 1') OR contains(lower(ContainerName), 'req 1'))""")
def search_rows(spark, sf):
    rows = search.search(views.logs(spark, sf), views.AS_OF, containers=["svc-1", "svc-2", "svc-4"], level="error",
                         text="REQ 1", hours=views.HOURS)
    return rows.select("LogId", "Timestamp", "ContainerName", "SeverityText", "Body", "TraceId")


@register("level_classes", "SRH-2", given("logs") + f"""
SELECT count(*) FILTER (WHERE {_ERR}) AS error, count(*) FILTER (WHERE {_WARN} AND NOT {_ERR}) AS warn,
  count(*) FILTER (WHERE lower(SeverityText) = 'info' AND NOT contains(upper(Body), 'ERR') AND NOT contains(upper(Body), 'WARN') AND NOT contains(upper(Body), 'WRN')) AS info,
  count(*) FILTER (WHERE lower(SeverityText) = 'debug' AND NOT contains(upper(Body), 'ERR') AND NOT contains(upper(Body), 'WARN') AND NOT contains(upper(Body), 'WRN')) AS debug
FROM logs""")
def level_classes(spark, sf):
    return views.logs(spark, sf).agg(*[F.count_if(level_predicate(level)).alias(level)
                                       for level in ("error", "warn", "info", "debug")])


@register("literal_text", "SRH-3", """
SELECT doc_id, contains(lower(text), '%') AS percent, contains(lower(text), 'the_') AS underscore,
  contains(lower(text), 'and ') AS word FROM documents""")
def literal_text(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", text_match("text", "%").alias("percent"), text_match("text", "THE_").alias("underscore"),
        text_match("text", "And ").alias("word"))


@register("search_page", "SRH-4", given("logs") + f"""
SELECT LogId, Timestamp, Body FROM logs WHERE Timestamp > {SINCE} AND ServiceName <> 'nginx'
ORDER BY Timestamp DESC, LogId DESC LIMIT 50 OFFSET 100""")
def search_page(spark, sf):
    rows = search.search(views.logs(spark, sf), views.AS_OF, hours=views.HOURS)
    return search.page(rows, 2, 50).select("LogId", "Timestamp", "Body")


@register("search_page_count", "SRH-4", given("logs") + """
SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) AS pages FROM logs""")
def search_page_count(spark, sf):
    return search.page_count(search.search(views.logs(spark, sf), views.AS_OF, hours=views.HOURS), 50)


_LEVEL = """CASE WHEN lower({s}) IN ('info', 'debug', '') AND contains(upper(substr({b}, 1, 200)), 'ERR') THEN 'error'
  WHEN lower({s}) IN ('info', 'debug', '') AND (contains(upper(substr({b}, 1, 200)), 'WARN') OR contains(upper(substr({b}, 1, 200)), 'WRN')) THEN 'warn'
  ELSE lower({s}) END"""


@register("effective_levels", "SRH-5", given("logs") + f"SELECT LogId, {_LEVEL.format(s='SeverityText', b='Body')} AS level FROM logs")
def effective_levels(spark, sf):
    return views.logs(spark, sf).select("LogId", effective_level().alias("level"))


def _last_error_per_container(rows):
    return (rows.filter(F.col("SeverityText") == "ERROR").groupBy("ContainerName")
            .agg(F.max("Timestamp").alias("anchor_ts")))


@register("error_context", "SRH-6", given("logs") + """
, anchors AS (SELECT ContainerName, max(Timestamp) AS anchor_ts FROM logs WHERE SeverityText = 'ERROR' GROUP BY ContainerName)
SELECT l.ContainerName, anchor_ts, LogId, Timestamp, SeverityText, Body,
  epoch_us(Timestamp) - epoch_us(anchor_ts) AS delta_us
FROM logs l JOIN anchors a ON l.ContainerName = a.ContainerName
  AND Timestamp BETWEEN anchor_ts - INTERVAL 5 HOUR AND anchor_ts + INTERVAL 5 HOUR
QUALIFY row_number() OVER (PARTITION BY l.ContainerName, anchor_ts ORDER BY Timestamp, LogId) <= 2000""")
def error_context(spark, sf):
    rows = views.logs(spark, sf)
    found = search.context_bulk(rows, _last_error_per_container(rows), 5 * 3600)
    return found.select("ContainerName", "anchor_ts", "LogId", "Timestamp", "SeverityText", "Body", "delta_us")


@register("context_rows", "SRH-6", given("logs") + """
SELECT LogId, Timestamp, SeverityText, Body FROM logs
WHERE ContainerName = 'svc-2' AND Timestamp BETWEEN TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 300 SECOND
  AND TIMESTAMP '2024-01-15 12:00:00' + INTERVAL 300 SECOND ORDER BY Timestamp, LogId LIMIT 2000""")
def context_rows(spark, sf):
    rows = search.context(views.logs(spark, sf), "svc-2", "2024-01-15 12:00:00", 300)
    return rows.select("LogId", "Timestamp", "SeverityText", "Body")


@register("context_marks", "SRH-7", given("logs") + """
, c AS (SELECT *, epoch_us(Timestamp) - epoch_us(TIMESTAMP '2024-01-15 12:00:00') AS delta_us FROM logs
  WHERE ContainerName = 'svc-2' AND Timestamp BETWEEN TIMESTAMP '2024-01-15 11:55:00' AND TIMESTAMP '2024-01-15 12:05:00')
SELECT LogId, Timestamp, delta_us, row_number() OVER (ORDER BY abs(delta_us), Timestamp, LogId) = 1 AS is_anchor FROM c""")
def context_marks(spark, sf):
    rows = search.context(views.logs(spark, sf), "svc-2", "2024-01-15 12:00:00", 300)
    return search.with_distance(rows, "2024-01-15 12:00:00").select("LogId", "Timestamp", "delta_us", "is_anchor")


@register("context_totals", "SRH-7", given("logs") + """
, near AS (SELECT *, abs(epoch_us(Timestamp) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) AS d FROM logs)
SELECT ContainerName, count(*) AS rows, count(*) FILTER (WHERE lower(SeverityText) = 'error') AS errors,
  count(*) FILTER (WHERE lower(SeverityText) IN ('warn', 'warning')) AS warnings,
  arg_min(LogId, (d, Timestamp, LogId)) AS anchor_id, arg_min(Timestamp, (d, Timestamp, LogId)) AS anchor_row_ts, min(d) AS distance_us
FROM near GROUP BY ContainerName""")
def context_totals(spark, sf):
    return search.context_summary(views.logs(spark, sf), "2024-01-15 12:00:00", ["ContainerName"])


@register("trace_rows", "SRH-8", given("logs") + """
SELECT Timestamp, ServiceName, SeverityText, Body, ContainerName FROM logs WHERE TraceId = 't7' ORDER BY Timestamp LIMIT 500""")
def trace_rows(spark, sf):
    return search.trace(views.logs(spark, sf), "t7")


@register("trace_totals", "SRH-9", given("logs") + """
SELECT TraceId, count(*) AS rows, count(*) FILTER (WHERE lower(SeverityText) = 'error') AS errors,
  count(*) FILTER (WHERE lower(SeverityText) IN ('warn', 'warning')) AS warnings FROM logs GROUP BY TraceId""")
def trace_totals(spark, sf):
    return search.trace_summary(views.logs(spark, sf))


@register("bucket_samples", "SRH-10", given("logs") + """
SELECT Timestamp, ServiceName, ContainerName, SeverityText, Body FROM logs
WHERE Timestamp >= TIMESTAMP '2024-01-02 00:00:00' AND Timestamp < TIMESTAMP '2024-01-30 00:00:00'
  AND lower(SeverityText) = 'error' AND ServiceName <> 'nginx' ORDER BY Timestamp DESC, LogId DESC LIMIT 5""")
def bucket_samples(spark, sf):
    return search.sample_logs(views.logs(spark, sf), "2024-01-02 00:00:00", "2024-01-30 00:00:00", "error")


@register("adhoc_sql", "SRH-11", given("logs", "ownership") + f"""
SELECT ContainerName, SeverityText, count(*) AS n FROM logs WHERE ContainerName IN {_OWN} GROUP BY ALL""")
def adhoc_sql(spark, sf):
    rows = scope.scoped(views.logs(spark, sf), views.ownership(spark, sf), 3, "developer")
    return search.query(spark, "SELECT ContainerName, SeverityText, count(*) AS n FROM logs GROUP BY ContainerName, SeverityText",
                        rows)
