"""Queries of detectors and alerting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import fixed
from tidelog.operators import cooldown, detect
from tidelog.plans import views
from tidelog.plans.analytics_queries import _KEYED
from tidelog.plans.registry import AS_OF, given, register

_LIKE_ERROR = "(SeverityText = 'ERROR' OR contains(lower(Body), 'error') OR contains(lower(Body), 'fatal'))"
_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(lower(Body), '{p}') THEN '{n}'" for n, p, _ in fixed.CRITICAL_CLASSES) + " END"
_TITLE = "CASE type " + " ".join(f"WHEN '{n}' THEN '{t}'" for n, _, t in fixed.CRITICAL_CLASSES) + " END"
_CRITICAL = f"""
SELECT LogId, Timestamp, type, 'critical' AS severity, {_TITLE} AS title, substr(Body, 1, 200) AS message,
  ContainerId AS container_id, ContainerName AS container_name
FROM (SELECT *, {_CLASS} AS type FROM logs WHERE ServiceName <> 'nginx' AND {_LIKE_ERROR}) WHERE type IS NOT NULL"""


def greedy(source: str, key: str, ts: str, seconds: int) -> str:
    """Recursive form of the cooldown: the next time that passes per key."""
    return f"""RECURSIVE_CTE AS (
  SELECT {key} AS k, min({ts}) AS t FROM {source} GROUP BY {key}
  UNION ALL
  SELECT p.k, (SELECT min(s.{ts}) FROM {source} s WHERE s.{key} = p.k AND s.{ts} >= p.t + INTERVAL {seconds} SECOND)
  FROM RECURSIVE_CTE p WHERE p.t IS NOT NULL)"""


def _throttled(source_sql: str, key: str, ts: str, seconds: int, columns: str, *tables: str) -> str:
    head = given(*tables, src=source_sql).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    return (head + ",\n" + greedy("src", key, ts, seconds).replace("RECURSIVE_CTE", "passed")
            + f"\nSELECT {columns} FROM src JOIN passed ON src.{key} = passed.k AND src.{ts} = passed.t")


@register("critical_events", "DET-1", given("logs") + _CRITICAL)
def critical_events(spark, sf):
    return detect.critical_events(views.logs(spark, sf))


@register("critical_alerts", "DET-1", _throttled(_CRITICAL, "type", "Timestamp", 86400, "src.*", "logs"))
def critical_alerts(spark, sf):
    return detect.critical_alerts(views.logs(spark, sf), 86400)


@register("document_critical_classes", "DET-1", "SELECT doc_id, " + _CLASS.replace("Body", "text") + " AS type FROM documents")
def document_critical_classes(spark, sf):
    from tidelog.functions.text import critical_class
    return views.table(spark, sf, "documents").select("doc_id", critical_class("text").alias("type"))


_SPAM_GRP = "substr(regexp_replace(lower(Body), '[0-9:\\.\\+\\-]+', '', 'g'), 1, 60)"
_SPAM = f"""
SELECT time_bucket(INTERVAL 6 HOUR, Timestamp, TIMESTAMP '2024-01-01 00:00:00') AS window_start, ContainerId, {_SPAM_GRP} AS grp,
  min(ContainerName) AS container_name, count(*) AS cnt, round_even(count(*) / 21600.0::DOUBLE, 2) AS req_per_sec,
  count(*) FILTER (WHERE regexp_matches(lower(Body), '{fixed.FLOOD_WORDS}')) AS ddos_hits, max(Body) AS sample_msg
FROM logs WHERE ServiceName <> 'nginx' GROUP BY ALL HAVING count(*) >= 3 AND ddos_hits >= 0"""


def _spam(spark, sf):
    return detect.spam_groups(views.logs(spark, sf), "6 hours", rate=8.0, count=3, hits=0, seconds=21600)


@register("spam_groups", "DET-2", given("logs") + _SPAM)
def spam_groups(spark, sf):
    groups = detect.spam_samples(views.logs(spark, sf), _spam(spark, sf), "6 hours")
    return groups.select("window_start", "ContainerId", "grp", "container_name", "cnt", "req_per_sec", "ddos_hits", "sample_msg")


@register("spam_notifications", "DET-2", given("logs", s=_SPAM) + """
SELECT 'log_spam' AS type, 'critical' AS severity, ContainerId AS container_id, container_name,
  concat('Container ''', container_name, ''' is emitting abnormal volume: ', req_per_sec, ' req/sec (', cnt, '/min). ',
    CASE WHEN ddos_hits > 0 THEN 'Likely DDOS/flood pattern.' ELSE 'Repeated spam pattern.' END, ' Sample: ', substr(sample_msg, 1, 120), '...') AS message
FROM s""")
def spam_notifications(spark, sf):
    groups = detect.spam_samples(views.logs(spark, sf), _spam(spark, sf), "6 hours")
    return detect.spam_message(groups).select("type", "severity", "container_id", "container_name", "message")


@register("anomaly_episodes", "DET-3", given("logs", s=_SPAM) + """
, n AS (SELECT *, epoch(window_start) / 21600 - row_number() OVER (PARTITION BY ContainerId, grp ORDER BY window_start) AS run FROM s)
SELECT ContainerId, grp, min(window_start) AS alert_window, max(window_start) AS last_window, count(*) AS windows,
  CAST(sum(cnt) AS BIGINT) AS cnt, CAST(sum(ddos_hits) AS BIGINT) AS ddos_hits FROM n GROUP BY ContainerId, grp, run""")
def anomaly_episodes(spark, sf):
    return detect.anomaly_episodes(_spam(spark, sf), window_seconds=21600)


def _gaps(key: str, source: str, seconds: int) -> str:
    return f"""
SELECT {key}, Timestamp AS last_log, until, (epoch_us(coalesce(until, {AS_OF})) - epoch_us(Timestamp)) / 1000000.0::DOUBLE AS seconds
FROM (SELECT {key}, Timestamp, lead(Timestamp) OVER (PARTITION BY {key} ORDER BY Timestamp) AS until FROM {source} WHERE ServiceName <> 'nginx')
WHERE epoch_us(coalesce(until, {AS_OF})) - epoch_us(Timestamp) > {seconds}000000"""


@register("silences", "DET-4", given("logs") + _gaps("ContainerId", "logs", 18000))
def silences(spark, sf):
    return detect.silences(views.logs(spark, sf), gap=18000, as_of=views.AS_OF)


@register("confirmed_silences", "DET-4", given("logs", g=_gaps("ContainerId", "logs", 18000)) + """
SELECT * FROM g WHERE ContainerId IN (SELECT concat('cid-', CAST(p_partkey AS STRING)) FROM part WHERE p_size % 9 = 0)""")
def confirmed_silences(spark, sf):
    parts = views.table(spark, sf, "part")
    runtime = parts.select(F.concat(F.lit("cid-"), F.col("p_partkey").cast("string")).alias("ContainerId"),
                           F.when(F.col("p_size") % 9 == 0, "exited").otherwise("running").alias("state"))
    return detect.silences(views.logs(spark, sf), gap=18000, as_of=views.AS_OF, runtime=runtime)


@register("down_up_transitions", "DET-5", given("logs", g=_gaps("ContainerName", "logs", 7200)) + """
SELECT ContainerName, 'container_down' AS type, 'critical' AS severity, last_log + INTERVAL 2 HOUR AS at, last_log FROM g
UNION ALL SELECT ContainerName, 'container_recovered', 'info', until, last_log FROM g WHERE until IS NOT NULL""")
def down_up_transitions(spark, sf):
    return detect.down_up_transitions(views.logs(spark, sf), 7200, views.AS_OF, ["ContainerName"])


_SNAPS = """
SELECT concat('svc-', CAST(o_orderkey % 7 AS STRING)) AS ContainerName,
  TIMESTAMP '2024-01-01 00:00:00' + (o_orderkey * 2711) % 2592000 * INTERVAL '1' SECOND AS snapshot_ts,
  max(CASE WHEN o_orderstatus = 'F' THEN 'exited' ELSE 'running' END) AS state FROM orders GROUP BY ALL"""


@register("confirmed_transitions", "DET-5", given("logs", g=_gaps("ContainerName", "logs", 7200), snaps=_SNAPS) + """
, d AS (SELECT *, last_log + INTERVAL 2 HOUR AS down_at FROM g),
a AS (SELECT d.*, s.state FROM d ASOF LEFT JOIN snaps s ON d.ContainerName = s.ContainerName AND d.down_at >= s.snapshot_ts),
c AS (SELECT * EXCLUDE (state), down_at + INTERVAL 1 HOUR AS look_at FROM a WHERE coalesce(state, 'running') <> 'running'),
b AS (SELECT c.*, s.state FROM c ASOF LEFT JOIN snaps s ON c.ContainerName = s.ContainerName AND c.look_at >= s.snapshot_ts),
e AS (SELECT *, least(until, CASE WHEN state = 'running' THEN look_at END) AS back FROM b)
SELECT ContainerName, 'container_down' AS type, 'critical' AS severity, down_at AS at, last_log FROM e
UNION ALL SELECT ContainerName, 'container_recovered', 'info', back, last_log FROM e WHERE back IS NOT NULL""")
def confirmed_transitions(spark, sf):
    snaps = spark.sql(
        _SNAPS.replace("TIMESTAMP '2024-01-01 00:00:00'", views.T0_SPARK).replace("FROM orders", "FROM {given}"),
        given=views.table(spark, sf, "orders"))
    return detect.down_up_transitions(views.logs(spark, sf), 7200, views.AS_OF, ["ContainerName"], snaps, 3600)


# One step per moment of a container: the second look that has become due, then what the moment says.
_FOLDED = """
, known AS (SELECT * FROM snaps WHERE snapshot_ts <= TIMESTAMP '{as_of}'
  QUALIFY state IS DISTINCT FROM lag(state) OVER (PARTITION BY ContainerName ORDER BY snapshot_ts)),
moments AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY moment, kind) AS i FROM (
  SELECT ContainerName AS k, snapshot_ts AS moment, 0 AS kind, state = 'running' AS up, NULL::TIMESTAMP AS since FROM known
  UNION ALL SELECT ContainerName, until, 1, NULL, NULL FROM g WHERE until IS NOT NULL
  UNION ALL SELECT ContainerName, last_log + INTERVAL 2 HOUR, 2, NULL, last_log FROM g)),
folded AS (
  SELECT DISTINCT k, 0::BIGINT AS i, true AS running, false AS down, false AS silent, NULL::TIMESTAMP AS look, NULL::TIMESTAMP AS last,
    NULL::TIMESTAMP AS looked, NULL::TIMESTAMP AS looked_last, NULL::VARCHAR AS type, NULL::TIMESTAMP AS moment FROM moments
  UNION ALL
  SELECT k, i, running, CASE WHEN up THEN false WHEN fell THEN true ELSE still_down END, silent,
    CASE WHEN up THEN NULL WHEN fell THEN moment + INTERVAL 1 HOUR ELSE look END, last, looked, looked_last,
    CASE WHEN up THEN 'container_recovered' WHEN fell THEN 'container_down' END, moment
  FROM (SELECT *, still_down AND NOT silent AND running AS up, silent AND NOT running AND NOT still_down AS fell FROM (
    SELECT m.k, m.i, m.moment, CASE m.kind WHEN 0 THEN m.up ELSE f.running END AS running,
      CASE m.kind WHEN 1 THEN false WHEN 2 THEN true ELSE f.silent END AS silent, CASE m.kind WHEN 2 THEN m.since ELSE f.last END AS last,
      CASE WHEN f.look < m.moment AND f.down AND f.silent AND f.running THEN f.look END AS looked, f.last AS looked_last,
      f.down AND NOT coalesce(f.look < m.moment AND f.silent AND f.running, false) AS still_down, CASE WHEN f.look >= m.moment THEN f.look END AS look
    FROM folded f JOIN moments m ON m.k = f.k AND m.i = f.i + 1)))
SELECT k AS ContainerName, type, CASE type WHEN 'container_down' THEN 'critical' ELSE 'info' END AS severity, moment AS "at", last AS last_log FROM folded WHERE type IS NOT NULL
UNION ALL SELECT k, 'container_recovered', 'info', looked, looked_last FROM folded WHERE looked IS NOT NULL
UNION ALL SELECT k, 'container_recovered', 'info', look, last FROM folded
  WHERE down AND silent AND running AND look <= TIMESTAMP '{as_of}' AND (k, i) IN (SELECT k, max(i) FROM moments GROUP BY k)"""


def _order_snapshots(spark, sf):
    return spark.sql(
        _SNAPS.replace("TIMESTAMP '2024-01-01 00:00:00'", views.T0_SPARK).replace("FROM orders", "FROM {given}"),
        given=views.table(spark, sf, "orders"))


@register("state_transitions", "DET-5", given("logs", g=_gaps("ContainerName", "logs", 7200), snaps=_SNAPS).replace("WITH ", "WITH RECURSIVE ", 1)
          + _FOLDED.replace("{as_of}", views.AS_OF))
def state_transitions(spark, sf):
    return detect.state_transitions(views.logs(spark, sf), _order_snapshots(spark, sf), 7200, views.AS_OF, ["ContainerName"], 3600)


@register("service_silences", "DET-6", given("logs", keyed=_KEYED, k="SELECT *, concat(host_id, '/', compose_project, '/', compose_service) AS service_key FROM keyed")
          + _gaps("service_key", "k", 18000))
def service_silences(spark, sf):
    return detect.service_silences(views.logs(spark, sf), 18000, views.AS_OF)


@register("transition_notices", "DET-5", given("logs", g=_gaps("ContainerName", "logs", 7200)) + """
SELECT 'container_down' AS type, 'Container Down' AS title, ContainerName AS container_name, last_log + INTERVAL 2 HOUR AS created_at,
  concat('Container ''', ContainerName, ''' has stopped running. Last log: ', rtrim(strftime(last_log, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS message FROM g
UNION ALL SELECT 'container_recovered', 'Container Recovered', ContainerName, until,
  concat('Container ''', ContainerName, ''' is running again. Last log: ', rtrim(strftime(last_log, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') FROM g WHERE until IS NOT NULL""")
def transition_notices(spark, sf):
    changes = detect.down_up_transitions(views.logs(spark, sf), 7200, views.AS_OF, ["ContainerName"])
    return detect.transition_message(changes).select("type", "title", "container_name", "created_at", "message")


_FLOOD = """
SELECT date_trunc('minute', Timestamp) AS minute, remote_addr, count(*) AS requests,
  arg_max(path, (Timestamp, path)) AS latest_path FROM acc
GROUP BY ALL HAVING count(*) >= 2"""


@register("flood_minutes", "DET-7", given("acc") + _FLOOD)
def flood_minutes(spark, sf):
    return detect.request_floods(views.access(spark, sf), 2, None)


@register("request_floods", "DET-7", _throttled(_FLOOD, "remote_addr", "minute", 43200, "src.*", "acc"))
def request_floods(spark, sf):
    return detect.request_floods(views.access(spark, sf), 2, 43200)


@register("first_request_floods", "DET-7", given("acc", times="SELECT DISTINCT remote_addr, Timestamp FROM acc").replace("WITH ", "WITH RECURSIVE ", 1) + """
, following AS (SELECT remote_addr, Timestamp AS start, min(Timestamp) OVER (PARTITION BY remote_addr ORDER BY Timestamp
  RANGE BETWEEN INTERVAL 60 SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM times),
openers AS (SELECT remote_addr, min(Timestamp) AS start FROM acc GROUP BY remote_addr
  UNION ALL SELECT o.remote_addr, f.next FROM openers o JOIN following f ON o.remote_addr = f.remote_addr AND o.start = f.start WHERE f.next IS NOT NULL),
counted AS (SELECT o.start AS opened, a.remote_addr, a.Timestamp AS "at", a.path AS latest_path,
    row_number() OVER (PARTITION BY a.remote_addr, o.start ORDER BY a.Timestamp, a.path) AS requests
  FROM acc a ASOF JOIN openers o ON a.remote_addr = o.remote_addr AND a.Timestamp >= o.start)
SELECT * FROM counted WHERE requests >= 2 QUALIFY row_number() OVER (PARTITION BY remote_addr, "at", latest_path ORDER BY requests) = 1""")
def first_request_floods(spark, sf):
    return detect.first_request_floods(views.access(spark, sf), 2, None)


@register("flood_notifications", "DET-7", given("acc", f=_FLOOD) + """
SELECT 'log_spam' AS type, 'Request Spam Detected' AS title, minute AS created_at,
  concat('High request volume from IP ', remote_addr, ': ', requests, ' requests/min. Latest path: ', latest_path) AS message FROM f""")
def flood_notifications(spark, sf):
    floods = detect.request_floods(views.access(spark, sf), 2, None)
    return detect.flood_message(floods).select("type", "title", "created_at", "message")


@register("cooldown", "DET-8", _throttled(
    "SELECT LogId, ContainerName, Timestamp FROM logs WHERE SeverityText = 'ERROR'", "ContainerName", "Timestamp", 14400, "src.*", "logs"))
def cooldown_rows(spark, sf):
    errors = views.logs(spark, sf).filter(F.col("SeverityText") == "ERROR").select("LogId", "ContainerName", "Timestamp")
    return cooldown.throttle(errors, ["ContainerName"], "Timestamp", 14400, order=["LogId"])


@register("clean_notices", "DET-9", given("notif") + """
SELECT id, trim(concat('Notice ', regexp_extract(title, '[a-z]+ $'))) AS title, trim(message) AS message FROM notif""")
def clean_notices(spark, sf):
    return detect.cleaned(views.notifications(spark, sf)).select("id", "title", "message")


_FEED = """SELECT id, type, severity, trim(concat('Notice ', regexp_extract(title, '[a-z]+ $'))) AS title, trim(message) AS message,
  container_id, container_name, created_at, read_at IS NOT NULL AS read FROM notif"""


@register("notification_feed", "DET-10", given("notif") + _FEED + " ORDER BY created_at DESC, id DESC LIMIT 200")
def notification_feed(spark, sf):
    return detect.notifications(views.notifications(spark, sf))


@register("spam_feed_of_user", "DET-10", given("notif", "ownership") + _FEED + """
WHERE type = 'log_spam' AND container_name IN (SELECT container_id FROM ownership WHERE user_id = 3)
ORDER BY created_at DESC, id DESC LIMIT 50""")
def spam_feed_of_user(spark, sf):
    return detect.notifications(views.notifications(spark, sf), 50, "log_spam", views.ownership(spark, sf), 3, "developer")
