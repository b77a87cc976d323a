"""Queries of sources, sinks and ingest transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import fixed
from tidelog.functions.values import attr
from tidelog.operators import access_ingest, ingest, merge
from tidelog.plans import views
from tidelog.plans.registry import given, register
from tidelog.session import shared_dir
from tidelog.sources import readers, sinks

NTZ = lambda c: F.col(c).cast("timestamp_ntz").alias(c)


@register("container_lines", "SRC-1", given("logs") + """
SELECT CASE WHEN SeverityText <> '' THEN Timestamp END AS Timestamp,
  CASE WHEN SeverityText <> '' THEN epoch_us(Timestamp) * 1000 + 7 END AS ts_nanos,
  Body, CASE WHEN SeverityText <> '' THEN 'stdout' ELSE '' END AS iostream, SeverityText <> '' AS parsed
FROM logs""")
def container_lines(spark, sf):
    stamp = F.concat(F.date_format("Timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("007Z"))
    line = F.to_json(F.struct(F.col("Body").alias("log"), F.lit("stdout").alias("stream"), stamp.alias("time")))
    lines = views.logs(spark, sf).select(
        F.when(F.col("SeverityText") != "", line).otherwise(F.col("Body")).alias("value"))
    rows = readers.parse_container_lines(lines)
    return rows.select(NTZ("Timestamp"), "ts_nanos", "Body", attr("LogAttributes", "log.iostream").alias("iostream"),
                       "parsed")


@register("container_events_kept", "SRC-2", given("logs") + """
SELECT LogId AS event_id, ContainerName AS container_name, Body AS message FROM logs WHERE ContainerName <> 'svc-3'""")
def container_events_kept(spark, sf):
    events = readers.drop_containers(views.container_events(spark, sf), ["svc-3"])
    return events.select("event_id", "container_name", "message")


def _otlp_payloads(rows):
    """Ingress rows as envelopes, one per container and minute."""
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), F.struct(value.alias("stringValue")).alias("value"))
    record = F.struct(
        (F.unix_micros(F.col("Timestamp").cast("timestamp")) * 1000 + 5).cast("string").alias("timeUnixNano"),
        F.col("SeverityText").alias("severityText"), F.struct(F.col("Body").alias("stringValue")).alias("body"),
        F.col("TraceId").alias("traceId"), F.array(pair("log.iostream", F.lit("stdout"))).alias("attributes"))
    resource = F.struct(F.array(pair("service.name", F.col("ServiceName")), pair("container.name", F.col("ContainerName")),
                                pair("host.name", F.col("HostName"))).alias("attributes"))
    scope = F.struct(F.array(record).alias("logRecords"))
    envelope = F.struct(F.array(F.struct(resource.alias("resource"), F.array(scope).alias("scopeLogs"))).alias("resourceLogs"))
    return rows.select(F.to_json(envelope).alias("value"))


@register("otlp_rows", "SRC-4", given("logs") + """
SELECT Timestamp, epoch_us(Timestamp) * 1000 + 5 AS ts_nanos, TraceId, SeverityText, ServiceName, Body,
  ContainerName AS container, HostName AS host, 'stdout' AS iostream FROM logs""")
def otlp_rows(spark, sf):
    rows = readers.flatten_otlp(_otlp_payloads(views.logs(spark, sf)))
    return rows.select(NTZ("Timestamp"), "ts_nanos", "TraceId", "SeverityText", "ServiceName", "Body",
                       attr("ResourceAttributes", "container.name").alias("container"),
                       attr("ResourceAttributes", "host.name").alias("host"),
                       attr("LogAttributes", "log.iostream").alias("iostream"))


@register("alert_rows", "SRC-5", given("logs") + """
SELECT CASE WHEN SeverityText = 'ERROR' THEN 'critical' ELSE 'warning' END AS type,
  CASE WHEN SeverityText = 'ERROR' THEN 'critical' ELSE 'warning' END AS severity,
  concat(CASE WHEN SeverityText = 'INFO' THEN '[RESOLVED] ' ELSE '[ALERT] ' END, 'Alert ', TraceId) AS title,
  CASE WHEN SeverityText = 'WARN' THEN concat('Alert ', TraceId) ELSE Body END AS message,
  CASE WHEN SeverityText = 'DEBUG' THEN NULL WHEN SeverityText = '' THEN ContainerName ELSE ContainerId END AS container_name
FROM logs""")
def alert_rows(spark, sf):
    severity = F.col("SeverityText")
    name = F.concat(F.lit("Alert "), "TraceId")
    labels = F.struct(name.alias("alertname"),
                      F.when(severity == "ERROR", "critical").alias("severity"),
                      F.when(~severity.isin("DEBUG", ""), F.col("ContainerId")).alias("name"),
                      F.when(severity == "", F.col("ContainerName")).alias("container"))
    alert = F.struct(F.when(severity == "INFO", "resolved").alias("status"), labels.alias("labels"),
                     F.struct(F.when(severity != "WARN", F.col("Body")).alias("summary")).alias("annotations"))
    payloads = views.logs(spark, sf).select(F.to_json(F.struct(F.array(alert).alias("alerts"))).alias("value"))
    return readers.flatten_alert_payloads(payloads)


@register("runtime_snapshot_rows", "SRC-6", given("snap") + """
SELECT id, raw_image AS image, raw_state, inspected, restart_count, oom_killed, exit_code, started_at, finished_at
FROM snap""")
def runtime_snapshot_rows(spark, sf):
    rows = views.snapshots(spark, sf)
    listed = rows.select(F.to_json(F.struct(
        F.col("id").alias("Id"), F.col("names").alias("Names"), F.col("image").alias("Image"),
        F.col("raw_state").alias("State"), F.col("raw_status").alias("Status"))).alias("value"))
    state = F.struct(F.col("oom_killed").alias("OOMKilled"), F.col("exit_code").alias("ExitCode"),
                     F.col("started_at").alias("StartedAt"), F.col("finished_at").alias("FinishedAt"))
    inspected = rows.filter("inspected").select(F.to_json(F.struct(
        F.col("id").alias("Id"), F.col("restart_count").alias("RestartCount"), state.alias("State"))).alias("value"))
    found = readers.parse_runtime_snapshots(listed, inspected)
    return found.select("id", "image", "raw_state", "inspected", "restart_count", "oom_killed", "exit_code",
                        "started_at", "finished_at")


@register("dimension_tables", "SRC-7", """
SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def dimension_tables(spark, sf):
    people, nations = readers.load_dims(spark, f"{sf}/customer.parquet", f"{sf}/nation.parquet")
    return (people.join(nations, people["c_nationkey"] == nations["n_nationkey"])
            .groupBy("n_name").agg(F.count(F.lit(1)).alias("customers")))


@register("log_rows_written", "SNK-1", given("logs") + "SELECT *, CAST(Timestamp AS DATE) AS log_date FROM logs")
def log_rows_written(spark, sf):
    path = f"{shared_dir(spark, 'logs')}/table"
    sinks.write_logs(views.stored_logs(spark, sf), path)
    return spark.read.parquet(path)


@register("log_table_written", "SNK-1", given("logs") + """
SELECT CAST(Timestamp AS DATE) AS log_date, count(*) AS rows, min(Timestamp) AS first_ts, max(Timestamp) AS last_ts,
  count(DISTINCT ContainerId) AS instances FROM logs GROUP BY 1""")
def log_table_written(spark, sf):
    path = f"{shared_dir(spark, 'logs')}/table"
    sinks.write_logs(views.stored_logs(spark, sf), path)
    return spark.read.parquet(path).groupBy("log_date").agg(
        F.count(F.lit(1)).alias("rows"), F.min("Timestamp").alias("first_ts"), F.max("Timestamp").alias("last_ts"),
        F.count_distinct("ContainerId").alias("instances"))


@register("export_rows", "SNK-2", given("logs") + f"""
SELECT Timestamp, ContainerId, ContainerName, concat('image:', ContainerName) AS ContainerImage, SeverityText, HostName, Body
FROM logs WHERE ContainerName IN ('svc-1', 'svc-2', 'svc-3') AND Timestamp >= TIMESTAMP '2024-01-01 06:00:00'
  AND Timestamp <= TIMESTAMP '2024-01-30 18:00:00'""")
def export_rows(spark, sf):
    rows = views.stored_logs(spark, sf).withColumn("ContainerImage", F.concat(F.lit("image:"), "ContainerName"))
    return sinks.export_rows(rows, ["svc-1", "svc-2", "svc-3"], "2024-01-01 06:00:00", "2024-01-30 18:00:00")


@register("notification_rows", "SNK-3", given("notif") + """
SELECT type, severity, trim(concat('Notice ', regexp_extract(title, '[a-z]+ $'))) AS title, trim(message) AS message, container_name,
  sha256(concat_ws(chr(31), type, title, message, container_id, container_name,
    rtrim(strftime(created_at, '%Y-%m-%d %H:%M:%S.%f'), '0'))) AS id
FROM notif""")
def notification_rows(spark, sf):
    return sinks.notification_rows(views.notifications(spark, sf)).select(
        "type", "severity", "title", "message", "container_name", "id")


_LINES = """
  SELECT event_id, ts, concat('svc-', CAST(user_id % 7 AS STRING)) AS container_id,
    CASE WHEN event_type = 'view' THEN concat('    at frame ', CAST(event_id AS STRING))
         ELSE concat(event_type, ' ', CAST(event_id AS STRING)) END AS line
  FROM events"""


def _lines(spark, sf):
    return spark.sql(_LINES.replace("FROM events", "FROM {given}"), given=views.table(spark, sf, "events"))


_RUNS = "WITH lines AS (" + _LINES + """),
prev AS (SELECT *, lag(ts) OVER w AS p FROM lines WINDOW w AS (PARTITION BY container_id ORDER BY ts, event_id)),
marked AS (SELECT *, (NOT regexp_matches(line, '^\\s') OR p IS NULL OR ts - p > INTERVAL 2 HOUR)::INT AS brk,
  regexp_matches(line, '^\\S') AS starts FROM prev),
blocks AS (SELECT *, sum(brk) OVER (PARTITION BY container_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS block FROM marked),
opened AS (SELECT *, min(CASE WHEN starts THEN struct_pack(t := ts, i := event_id) END)
  OVER (PARTITION BY container_id, block ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM blocks),
runs AS (SELECT *, coalesce(run, struct_pack(t := ts, i := event_id)) AS r FROM opened)
"""
_RUN = {"ts": "ts", "order": "event_id", "line": "line", "timeout_seconds": 7200, "chunk_seconds": 21600}
SEGMENT = 100  # bytes; small, so that events of the test tables have several


def _segmented(event: str, source: str) -> str:
    """Lines of an event with their segment, in SQL."""
    return f"""placed AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY container_id, {event} ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {SEGMENT} AS seg FROM {source})
"""


@register("multiline_runs", "ING-1", _RUNS + """SELECT container_id, r.t AS run_start, r.i AS run_id, count(*) AS lines, min(ts) AS first_ts, max(ts) AS last_ts,
  string_agg(line, chr(10) ORDER BY ts, event_id) AS message
FROM runs GROUP BY container_id, r.t, r.i""")
def multiline_runs(spark, sf):
    return merge.group_multiline(_lines(spark, sf), ["container_id"], **_RUN)


@register("multiline_lines", "ING-1", _RUNS + """SELECT event_id, ts, container_id, line, r.t AS run_start, r.i AS run_id,
  row_number() OVER (PARTITION BY container_id, r ORDER BY ts, event_id) AS line_no FROM runs""")
def multiline_lines(spark, sf):
    return merge.multiline_lines(_lines(spark, sf), ["container_id"], **_RUN)


@register("multiline_segments", "ING-1", _RUNS.rstrip() + ",\n" + _segmented("r", "runs") + """
SELECT container_id, r.t AS run_start, r.i AS run_id, CAST(seg AS BIGINT) AS segment, count(*) AS lines, min(ts) AS first_ts, max(ts) AS last_ts,
  string_agg(line, chr(10) ORDER BY ts, event_id) AS message FROM placed GROUP BY container_id, r.t, r.i, seg""")
def multiline_segments(spark, sf):
    return merge.multiline_segments(_lines(spark, sf), ["container_id"], **_RUN, segment_bytes=SEGMENT)


_GAPS = "WITH lines AS (" + _LINES + """),
marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens
  FROM lines WINDOW w AS (PARTITION BY container_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY container_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM marked)
"""


@register("idle_gap_events", "ING-2", _GAPS + """SELECT container_id, min(ts) AS session_start, count(*) AS lines, min(ts) AS first_ts, max(ts) AS last_ts,
  string_agg(line, chr(10) ORDER BY ts, event_id) AS message
FROM numbered GROUP BY container_id, s""")
def idle_gap_events(spark, sf):
    return merge.merge_idle_gap(_lines(spark, sf), ["container_id"], "ts", "event_id", "line", gap_seconds=3600)


@register("idle_gap_lines", "ING-2", _GAPS + """SELECT event_id, ts, container_id, line, min(ts) OVER (PARTITION BY container_id, s) AS session_start,
  row_number() OVER (PARTITION BY container_id, s ORDER BY ts, event_id) AS line_no FROM numbered""")
def idle_gap_lines(spark, sf):
    return merge.idle_gap_lines(_lines(spark, sf), ["container_id"], "ts", "event_id", gap_seconds=3600)


@register("idle_gap_segments", "ING-2", _GAPS.rstrip() + ",\nstarted AS (SELECT *, min(ts) OVER (PARTITION BY container_id, s) AS session_start FROM numbered),\n"
          + _segmented("s", "started") + """
SELECT container_id, session_start, CAST(seg AS BIGINT) AS segment, count(*) AS lines, min(ts) AS first_ts, max(ts) AS last_ts,
  string_agg(line, chr(10) ORDER BY ts, event_id) AS message FROM placed GROUP BY container_id, s, session_start, seg""")
def idle_gap_segments(spark, sf):
    return merge.idle_gap_segments(_lines(spark, sf), ["container_id"], "ts", "event_id", "line", gap_seconds=3600, segment_bytes=SEGMENT)


_SERVICE = "CASE WHEN ComposeService = '' THEN ContainerName ELSE ComposeService END"


@register("log_records", "ING-3", given("logs") + f"""
SELECT LogId AS event_id, {_SERVICE} AS ServiceName, {_SERVICE} AS container, ContainerId AS container_id, Body,
  HostName AS host, ComposeProject AS project, CASE WHEN SeverityText = 'ERROR' THEN 'stderr' ELSE 'stdout' END AS iostream
FROM logs""")
def log_records(spark, sf):
    rows = ingest.to_log_record(views.container_events(spark, sf))
    resource = lambda key, name: attr("ResourceAttributes", key).alias(name)
    return rows.select("event_id", "ServiceName", resource(fixed.CONTAINER_NAME, "container"),
                       resource(fixed.CONTAINER_ID, "container_id"), "Body", resource(fixed.HOST_NAME, "host"),
                       resource(fixed.PROJECT_ATTR, "project"), attr("LogAttributes", "log.iostream").alias("iostream"))


@register("edge_metadata", "ING-4", given("logs") + """
SELECT LogId AS event_id, 'edge-1' AS edge_host_id, 'north' AS edge_site, 'dev' AS edge_env, ContainerId AS instance_key,
  nullif(ComposeProject, '') AS compose_project, nullif(ComposeService, '') AS compose_service,
  CASE WHEN ComposeProject <> '' AND ComposeService <> '' THEN concat('edge-1/', ComposeProject, '/', ComposeService) END AS service_key
FROM logs""")
def edge_metadata(spark, sf):
    rows = ingest.enrich_edge(views.container_events(spark, sf), "edge-1", "north")
    return rows.select("event_id", "edge_host_id", "edge_site", "edge_env", "instance_key", "compose_project",
                       "compose_service", "service_key")


@register("blank_bodies_dropped", "ING-5", """
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines FROM lines WHERE NOT regexp_full_match(line, '\\s*') GROUP BY doc_id""")
def blank_bodies_dropped(spark, sf):
    lines = views.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("Body"))
    return ingest.drop_blank(lines).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


_INFERRED = """CASE WHEN regexp_matches(lower({b}), 'error|fatal|panic|exception') THEN 'ERROR'
  WHEN regexp_matches(lower({b}), 'warn|warning') THEN 'WARN'
  WHEN regexp_matches(lower({b}), 'debug|trace') THEN 'DEBUG' ELSE 'INFO' END"""


@register("severity_inferred", "ING-6", given("logs") + f"""
SELECT LogId, CASE WHEN SeverityText <> '' THEN SeverityText ELSE {_INFERRED.format(b='Body')} END AS SeverityText FROM logs""")
def severity_inferred(spark, sf):
    return ingest.infer_severity(views.logs(spark, sf)).select("LogId", "SeverityText")


@register("document_severity", "ING-6", f"""
SELECT doc_id, {_INFERRED.format(b='text')} AS SeverityText FROM documents""")
def document_severity(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", F.lit("").alias("SeverityText"), F.col("text").alias("Body"))
    return ingest.infer_severity(docs).select("doc_id", "SeverityText")


@register("attrs_promoted", "ING-7", given("logs") + """
SELECT LogId, CASE WHEN SeverityText <> '' AND ComposeService <> '' THEN ComposeService ELSE ContainerName END AS container,
  ComposeProject AS project,
  CASE WHEN SeverityText <> '' AND ComposeService <> '' THEN ComposeService ELSE ContainerName END AS ServiceName FROM logs""")
def attrs_promoted(spark, sf):
    rows = views.ingress(spark, sf)
    label = lambda key, source: F.when(attr("ResourceAttributes", source) != "", F.struct(
        F.lit(key).alias("key"), attr("ResourceAttributes", source).alias("value")))
    attrs = F.map_from_entries(F.array_compact(F.array(
        label(fixed.SERVICE_LABEL, fixed.SERVICE_ATTR), label(fixed.PROJECT_LABEL, fixed.PROJECT_ATTR))))
    rows = rows.withColumn("attrs", F.when(F.col("SeverityText") != "", attrs))
    return ingest.promote_attrs(rows).select(
        "LogId", attr("ResourceAttributes", fixed.CONTAINER_NAME).alias("container"),
        attr("ResourceAttributes", fixed.PROJECT_ATTR).alias("project"), "ServiceName")


@register("severity_dropped", "ING-8", given("logs") + "SELECT LogId, SeverityText FROM logs WHERE SeverityText <> 'DEBUG'")
def severity_dropped(spark, sf):
    return ingest.drop_severity(views.logs(spark, sf)).select("LogId", "SeverityText")


@register("own_containers_dropped", "ING-9", given("logs") + "SELECT LogId FROM logs WHERE ContainerName NOT IN ('svc-0', 'svc-5')")
def own_containers_dropped(spark, sf):
    return ingest.exclude_containers(views.ingress(spark, sf), ["svc-0", "svc-5"]).select("LogId")


@register("level_parsed", "ING-10", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'DEBUG' ELSE '' END AS SeverityText,
  CASE event_type WHEN 'error' THEN 17 WHEN 'signup' THEN 13 WHEN 'click' THEN 9 WHEN 'view' THEN 5 ELSE 0 END AS SeverityNumber
FROM events""")
def level_parsed(spark, sf):
    level = (F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "signup", "WARNING")
             .when(F.col("event_type") == "click", "info").when(F.col("event_type") == "view", "debug"))
    rows = views.table(spark, sf, "events").select("event_id", level.alias("level"), F.lit("").alias("SeverityText"))
    return ingest.parse_level(rows).select("event_id", "SeverityText", "SeverityNumber")


def _access_lines(spark, sf):
    """Requests as log lines: JSON for POST, combined for PUT, the short form for GET."""
    time = F.date_format("Timestamp", "dd/MMM/yyyy:HH:mm:ss' +0000'")
    request = F.concat("method", F.lit(" "), "path", F.lit("?q=1 HTTP/1.1"))
    json = F.to_json(F.struct(F.col("remote_addr").alias("client"), time.alias("time"), request.alias("request"), "status",
                              F.col("bytes_sent").alias("size"), "referer", "request_time"))
    head = F.concat(F.col("remote_addr"), F.lit(" - - ["), time, F.lit('] "'), request, F.lit('" '), F.col("status"),
                    F.lit(" "), F.col("bytes_sent"))
    combined = F.concat(head, F.lit(' "'), F.col("referer"), F.lit('" "agent/1.0"'))
    line = F.when(F.col("method") == "POST", json).when(F.col("method") == "PUT", combined).otherwise(head)
    return views.raw_access(spark, sf).select(line.alias("message"))


_KEPT = "(method = 'POST' OR status <> 'abc')"


@register("access_lines_read", "SRC-3", given("access") + f"""
SELECT method, count(*) AS requests FROM access WHERE {_KEPT} GROUP BY method""")
def access_lines_read(spark, sf):
    path = f"{shared_dir(spark, 'access-lines')}/access"
    _access_lines(spark, sf).write.text(path)
    requests = access_ingest.parse_access(readers.read_access_lines(spark, path))
    return (requests.groupBy(F.substring_index("request", " ", 1).alias("method"))
            .agg(F.count(F.lit(1)).alias("requests")))


@register("access_parsed", "ING-11", given("access") + f"""
SELECT remote_addr, strftime(Timestamp, '%d/%b/%Y:%H:%M:%S +0000') AS time, concat(method, ' ', path, '?q=1 HTTP/1.1') AS request,
  status, bytes_sent AS size, CASE method WHEN 'POST' THEN referer WHEN 'PUT' THEN nullif(referer, '-') END AS http_referer,
  CASE method WHEN 'PUT' THEN 'agent/1.0' END AS user_agent, CASE method WHEN 'POST' THEN request_time END AS request_time
FROM access WHERE {_KEPT}""")
def access_parsed(spark, sf):
    return access_ingest.parse_access(_access_lines(spark, sf)).select(
        "remote_addr", "time", "request", "status", "size", "http_referer", "user_agent", "request_time")


@register("access_normalized", "ING-12", given("access") + f"""
SELECT Timestamp AS timestamp, remote_addr, method, path, coalesce(TRY_CAST(status AS INTEGER), 0) AS status,
  CAST(bytes_sent AS BIGINT) AS bytes_sent, CASE method WHEN 'POST' THEN CAST(request_time AS DOUBLE) ELSE 0.0::DOUBLE END AS request_time
FROM access WHERE {_KEPT}""")
def access_normalized(spark, sf):
    rows = access_ingest.normalize_access(access_ingest.parse_access(_access_lines(spark, sf)))
    return rows.select(NTZ("timestamp"), "remote_addr", "method", "path", "status", "bytes_sent", "request_time")


@register("page_paths", "ING-12", """
SELECT page_id, regexp_extract(url, '^[^?]*') AS path, 'GET' AS method FROM pages""")
def page_paths(spark, sf):
    lines = views.table(spark, sf, "pages").select("page_id", F.to_json(F.struct(
        F.concat(F.lit("GET "), "url", F.lit(" HTTP/1.1")).alias("request"))).alias("message"))
    rows = access_ingest.normalize_access(access_ingest.parse_access(lines))
    return rows.select("page_id", "path", "method")


@register("probes_dropped", "ING-13", given("access") + """
SELECT path, count(*) AS requests FROM access WHERE path <> '/healthz' GROUP BY path""")
def probes_dropped(spark, sf):
    return access_ingest.drop_probe_paths(views.raw_access(spark, sf)).groupBy("path").agg(
        F.count(F.lit(1)).alias("requests"))


@register("access_log_records", "ING-14", given("access") + f"""
SELECT Timestamp, 'nginx' AS ServiceName, concat(method, ' ', path, ' ', CAST(coalesce(TRY_CAST(status AS INTEGER), 0) AS STRING)) AS Body, remote_addr,
  CASE method WHEN 'POST' THEN CAST(request_time AS DOUBLE) ELSE 0.0::DOUBLE END AS request_time,
  CASE method WHEN 'GET' THEN '-' ELSE referer END AS referer, 'production' AS environment
FROM access WHERE {_KEPT} AND path <> '/healthz'""")
def access_log_records(spark, sf):
    rows = access_ingest.normalize_access(access_ingest.parse_access(_access_lines(spark, sf)))
    rows = access_ingest.access_to_log(access_ingest.drop_probe_paths(rows))
    log = lambda key: attr("LogAttributes", key)
    return rows.select(NTZ("Timestamp"), "ServiceName", "Body", log("remote_addr").alias("remote_addr"),
                       log("request_time").cast("double").alias("request_time"), log("referer").alias("referer"),
                       attr("ResourceAttributes", fixed.ENVIRONMENT).alias("environment"))


@register("materialized", "ING-15", given("logs") + """
SELECT LogId, ContainerName, '' AS ContainerImage, ContainerId, HostName, 'production' AS Environment, ComposeProject,
  CAST(Timestamp AS DATE) AS log_date FROM logs""")
def materialized(spark, sf):
    return ingest.materialize(views.ingress(spark, sf), "production").select(
        "LogId", "ContainerName", "ContainerImage", "ContainerId", "HostName", "Environment", "ComposeProject", "log_date")


@register("service_identity", "ING-16", given("logs") + """
SELECT LogId,
  CASE WHEN ComposeProject <> '' AND ComposeService <> ''
    THEN concat(CASE WHEN HostName = '' THEN 'unknown-host' ELSE HostName END, '/', ComposeProject, '/', ComposeService)
    ELSE concat(CASE WHEN HostName = '' THEN 'unknown-host' ELSE HostName END, '/standalone/', ContainerName) END AS service_key,
  ContainerId AS instance_key,
  CASE WHEN ComposeProject <> '' AND ComposeService <> '' THEN 'high' ELSE 'fallback' END AS identity_confidence
FROM logs""")
def service_identity(spark, sf):
    sources = [("edge_host_id", "HostName"), ("com.docker.compose.project", "ComposeProject"),
               ("compose_service", "ComposeService"), ("container.name", "ContainerName"), ("container_id", "ContainerId")]
    attributes = F.create_map(*[x for key, c in sources for x in (F.lit(key), F.col(c))])
    rows = views.logs(spark, sf).withColumn("attributes", attributes)
    return ingest.service_identity(rows).select("LogId", "service_key", "instance_key", "identity_confidence")
