"""Streaming queries: the given tables are read as streams until all of them is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidelog.functions import fixed
from tidelog.operators import merge, rollups
from tidelog.plans import detect_queries, views  # noqa: F401 - the cooldown check is shared
from tidelog.plans.registry import AS_OF, REGISTRY, given, register
from tidelog.session import shared_dir
from tidelog.sources import schema, sinks
from tidelog.sources.tailing import tail_lines
from tidelog.streaming import stateful, tails

_EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
_LINEITEM = """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,
    l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"""


def _stream(spark, sf: str, name: str, columns: str, text: str) -> DataFrame:
    rows = spark.readStream.schema(columns).option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    body = text.format(T0=views.T0_SPARK).replace(f"FROM {name}", "FROM {given}")
    return spark.sql(body, given=rows)


def log_stream(spark, sf: str) -> DataFrame:
    rows = _stream(spark, sf, "events", _EVENTS, views.LOGS_SQL)
    return rows.withColumn("Timestamp", F.col("Timestamp").cast("timestamp"))


def access_stream(spark, sf: str) -> DataFrame:
    rows = _stream(spark, sf, "lineitem", _LINEITEM, views.ACCESS_SQL)
    fields = ["remote_addr", "method", "path", "referer", "status", "bytes_sent", "request_time"]
    return rows.select(F.col("Timestamp").cast("timestamp").alias("Timestamp"),
                       F.lit(fixed.GATEWAY_SERVICE).alias("ServiceName"),
                       F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))]).alias("LogAttributes"))


def _written(spark, rows: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all available input into a table of its own."""
    root = shared_dir(spark, name)
    query = (rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{root}/checkpoint")
             .trigger(availableNow=True).start(f"{root}/table"))
    query.awaitTermination()
    return _ntz(spark.read.schema(rows.schema).parquet(f"{root}/table"))


def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema
                           if f.dataType.typeName() == "timestamp"})


@register("log_tail", "ST-1", given("logs") + """
SELECT Timestamp, ContainerName, SeverityText, Body FROM logs WHERE ContainerName IN ('svc-1', 'svc-2', 'svc-3')
  AND SeverityText = 'ERROR' AND contains(lower(Body), 'req 1')""")
def log_tail(spark, sf):
    rows = tails.tail_logs(log_stream(spark, sf), ["svc-1", "svc-2", "svc-3"], level="ERROR", text="REQ 1")
    root = shared_dir(spark, "tail")
    deliver = lambda batch: batch.write.mode("append").parquet(f"{root}/table")
    tails.start_tail(rows, deliver, f"{root}/checkpoint", every=None).awaitTermination()
    return _ntz(spark.read.schema(rows.schema).parquet(f"{root}/table"))


@register("access_tail", "ST-2", given("acc") + """
SELECT Timestamp, remote_addr, method, referer, path, status, bytes_sent, request_time FROM acc
WHERE status = 404 AND method = 'GET' AND contains(path, '/part/1') AND Timestamp >= TIMESTAMP '2024-01-02 00:00:00'""")
def access_tail(spark, sf):
    rows = tails.tail_access(access_stream(spark, sf), 404, "GET", "/PART/1", "2024-01-02 00:00:00")
    return _written(spark, rows, "access-tail")


@register("notification_stream", "ST-3", given("notif") + "SELECT type, severity, container_name, count(*) AS n FROM notif GROUP BY ALL")
def notification_stream(spark, sf):
    root = shared_dir(spark, "notifications")
    sinks.write_notifications(views.notifications(spark, sf), f"{root}/feed")
    rows = _written(spark, tails.notification_stream(spark, f"{root}/feed"), "feed")
    return rows.groupBy("type", "severity", "container_name").agg(F.count(F.lit(1)).alias("n"))


@register("notification_stream_rows", "ST-3", given("notif") + "SELECT type, severity, trim(message) AS message, container_id, container_name, created_at FROM notif")
def notification_stream_rows(spark, sf):
    root = shared_dir(spark, "notifications")
    sinks.write_notifications(views.notifications(spark, sf), f"{root}/feed")
    return _written(spark, tails.notification_stream(spark, f"{root}/feed"), "feed").select(
        "type", "severity", "message", "container_id", "container_name", "created_at")


@register("ingested_stream", "ST-4", given("logs") + """
SELECT LogId, Timestamp, CASE WHEN SeverityText <> '' THEN SeverityText WHEN contains(lower(Body), 'error') THEN 'ERROR' ELSE 'INFO' END AS SeverityText,
  ContainerName, ContainerId, HostName, ComposeProject, CAST(Timestamp AS DATE) AS log_date
FROM logs WHERE SeverityText <> 'DEBUG' AND ContainerName <> 'svc-5'""")
def ingested_stream(spark, sf):
    root = shared_dir(spark, "ingest")
    entry = lambda key, c: (F.lit(key), F.col(c))
    resource = F.create_map(*entry(fixed.CONTAINER_NAME, "ContainerName"), *entry(fixed.CONTAINER_ID, "ContainerId"),
                            *entry(fixed.HOST_NAME, "HostName"), *entry(fixed.PROJECT_ATTR, "ComposeProject"))
    rows = log_stream(spark, sf).withColumn("ResourceAttributes", resource)
    tails.ingest_stream(rows, f"{root}/table", f"{root}/checkpoint", ["svc-5"], ["DEBUG"]).awaitTermination()
    return _ntz(spark.read.parquet(f"{root}/table").select(
        "LogId", "Timestamp", "SeverityText", "ContainerName", "ContainerId", "HostName", "ComposeProject", "log_date"))


# A window is out once the watermark (latest time less an hour, in milliseconds) has passed its end.
_CLOSED = "date_trunc('millisecond', (SELECT max(Timestamp) FROM logs)) - INTERVAL 1 HOUR"
_SPAM_GRP = "substr(regexp_replace(lower(Body), '[0-9:\\.\\+\\-]+', '', 'g'), 1, 60)"


def _spam_windows(slide: int) -> str:
    steps = ", ".join(str(-slide * i) for i in range(6 // slide))
    return f"""
SELECT w AS window_start, w + INTERVAL 6 HOUR AS window_end, ContainerId, grp, min(ContainerName) AS container_name,
  count(*) AS cnt, round_even(count(*) / 21600.0::DOUBLE, 2) AS req_per_sec,
  count(*) FILTER (WHERE regexp_matches(lower(Body), '{fixed.FLOOD_WORDS}')) AS ddos_hits
FROM (SELECT *, {_SPAM_GRP} AS grp,
  time_bucket(INTERVAL {slide} HOUR, Timestamp, TIMESTAMP '2024-01-01 00:00:00') + unnest([{steps}]) * INTERVAL 1 HOUR AS w FROM logs)
WHERE w + INTERVAL 6 HOUR <= {_CLOSED} GROUP BY ALL HAVING count(*) >= 3"""


@register("spam_stream", "ST-5", given("logs") + _spam_windows(3))
def spam_stream(spark, sf):
    rows = tails.spam_stream(log_stream(spark, sf), "6 hours", "3 hours", "1 hour", count=3, hits=0, seconds=21600)
    return _written(spark, rows, "spam")


@register("flood_stream", "ST-5", given("acc", f=detect_queries._FLOOD) + """
SELECT * FROM f WHERE minute + INTERVAL 1 MINUTE <= (SELECT max(Timestamp) FROM acc) - INTERVAL 1 MINUTE""")
def flood_stream(spark, sf):
    rows = access_stream(spark, sf).select("Timestamp", F.col("LogAttributes")["remote_addr"].alias("remote_addr"),
                                           F.col("LogAttributes")["path"].alias("path"))
    return _written(spark, tails.flood_stream(rows, 2, "1 minute"), "floods")


@register("idle_gap_stream", "ST-6", given("logs") + f"""
, marked AS (SELECT *, CASE WHEN Timestamp - lag(Timestamp) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens
  FROM logs WINDOW w AS (PARTITION BY ContainerName ORDER BY Timestamp, LogId)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY ContainerName ORDER BY Timestamp, LogId ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT ContainerName, min(Timestamp) AS session_start, count(*) AS lines, min(Timestamp) AS first_ts, max(Timestamp) AS last_ts
FROM numbered GROUP BY ContainerName, s HAVING max(Timestamp) + INTERVAL 1 HOUR <= {_CLOSED}""")
def idle_gap_stream(spark, sf):
    rows = merge.stream_idle_gap(log_stream(spark, sf), ["ContainerName"], "Timestamp", "1 hour", "1 hour")
    return _written(spark, rows, "sessions")


_NUMBERED = REGISTRY["idle_gap_stream"].oracle
_NUMBERED = _NUMBERED[:_NUMBERED.index("SELECT ContainerName, min(Timestamp)")]


@register("idle_merge_stateful", "ST-6", _NUMBERED + """
SELECT ContainerName, min(Timestamp) OVER e AS session_start, row_number() OVER (e ORDER BY Timestamp, LogId) AS line_no, Timestamp, Body
FROM numbered WINDOW e AS (PARTITION BY ContainerName, s)""")
def idle_merge_stateful(spark, sf):
    rows = stateful.stream_idle_lines(log_stream(spark, sf), "ContainerName", "Timestamp", "LogId", "Body", 3600,
                                      watermark="1 hour")
    return _written(spark, rows, "merged")


@register("cooldown_stream", "ST-7", REGISTRY["cooldown"].oracle)
def cooldown_stream(spark, sf):
    errors = log_stream(spark, sf).filter(F.col("SeverityText") == "ERROR").select("LogId", "ContainerName", "Timestamp")
    return _written(spark, stateful.stream_throttle(errors, "ContainerName", "Timestamp", 14400), "cooldown")


@register("episode_stream", "ST-7", given("logs", s=_spam_windows(6)) + """
SELECT * FROM s QUALIFY coalesce(window_start - lag(window_start) OVER (PARTITION BY ContainerId, grp ORDER BY window_start) > INTERVAL 6 HOUR, true)""")
def episode_stream(spark, sf):
    groups = tails.spam_stream(log_stream(spark, sf), "6 hours", None, "1 hour", count=3, hits=0, seconds=21600)
    return _written(spark, stateful.stream_episodes(groups, 21600), "episodes")


@register("down_up_stream", "ST-7", given("logs") + f"""
, seen AS (SELECT ContainerName, Timestamp FROM logs
  WHERE time_bucket(INTERVAL 10 MINUTE, Timestamp, TIMESTAMP '2024-01-01 00:00:00') + INTERVAL 10 MINUTE <= {_CLOSED}),
p AS (SELECT ContainerName, Timestamp AS last_log, lead(Timestamp) OVER (PARTITION BY ContainerName ORDER BY Timestamp) AS until FROM seen),
g AS (SELECT * FROM p WHERE until - last_log > INTERVAL 2 HOUR OR until IS NULL AND last_log + INTERVAL 2 HOUR < {_CLOSED})
SELECT ContainerName, 'container_down' AS type, 'critical' AS severity, last_log + INTERVAL 2 HOUR AS at, last_log FROM g
UNION ALL SELECT ContainerName, 'container_recovered', 'info', until, last_log FROM g WHERE until IS NOT NULL""")
def down_up_stream(spark, sf):
    rows = stateful.stream_down_up(log_stream(spark, sf), "ContainerName", 7200, "1 hour", "10 minutes")
    return _written(spark, rows, "down-up")


@register("deduplicated_stream", "ST-8", given("logs") + "SELECT LogId, Timestamp FROM logs")
def deduplicated_stream(spark, sf):
    rows = log_stream(spark, sf).select("LogId", "Timestamp")
    twice = rows.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    return _written(spark, tails.with_lateness(twice, "Timestamp", "1 hour", ["LogId"]), "dedup")


@register("tailed_lines", "SRC-3", "SELECT concat(event_id, ' ', event_type, ' of user ', user_id) AS value FROM events")
def tailed_lines(spark, sf):
    """Lines of log files that are there, and of files that come later, each read in a trigger of its own."""
    root = shared_dir(spark, "tailed")
    events = views.table(spark, sf, "events")
    line = F.concat(F.col("event_id").cast("string"), F.lit(" "), "event_type", F.lit(" of user "), F.col("user_id").cast("string")).alias("value")
    for half in (0, 1):
        events.filter(F.col("event_id") % 2 == half).select(line).write.mode("append").text(f"{root}/logs")
        (tail_lines(spark, f"{root}/logs/*.txt").select("value").writeStream.option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start(f"{root}/out").awaitTermination())
    return spark.read.parquet(f"{root}/out")


def _kept_parts(spark, sf: str) -> DataFrame:
    """The roll-up that a stream of about four micro-batches leaves. A large table's parts are files as they are: no task takes a fixed share."""
    root = shared_dir(spark, "rollup")
    given = views.access(spark, sf)
    (given if given.rdd.getNumPartitions() >= 4 else given.repartition(4)).write.parquet(f"{root}/access")
    stored = spark.read.parquet(f"{root}/access")
    batch = -(-len(stored.inputFiles()) // 4)
    rows = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", batch).parquet(f"{root}/access")
    tails.rollup_stream(rows, f"{root}/parts", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/parts")


@register("rollup_hours", "ST-5", given("acc") + """
SELECT date_trunc('hour', Timestamp) AS hour, count(*) AS total, count(*) FILTER (WHERE status >= 400) AS errors,
  count(*) FILTER (WHERE status >= 500) AS errors_5xx, CAST(sum(bytes_sent) AS BIGINT) AS total_bytes FROM acc GROUP BY 1""")
def rollup_hours(spark, sf):
    """Exact columns of the kept hours; the next query looks at the estimates."""
    return rollups.hours_of(_kept_parts(spark, sf)).drop("p95_time", "clients")


@register("rollup_overview", "ST-5", given("acc") + f"""
SELECT count(*) AS total_requests, CAST(sum(bytes_sent) AS BIGINT) AS total_bytes, count(*) FILTER (WHERE status >= 500) AS errors_5xx_exact,
  true AS p95_close, true AS clients_close FROM acc WHERE Timestamp >= {AS_OF} - INTERVAL 240 HOUR""")
def rollup_overview(spark, sf):
    """Ten days from the kept hours. Estimates are held against the requests: p95 by its rank, clients by their number."""
    kept = rollups.overview_of(_kept_parts(spark, sf), views.AS_OF, 240).first()
    p95 = kept["p95_response_time"]
    rows = views.access(spark, sf).filter(F.col("Timestamp") >= F.lit("2024-01-21 00:00:00").cast("timestamp_ntz"))
    held = rows.agg(F.avg((F.col("request_time") < p95 - 0.0001).cast("double")).alias("below"),
                    F.avg((F.col("request_time") <= p95 + 0.0001).cast("double")).alias("upto"),
                    F.count_distinct("remote_addr").alias("real"))
    return held.select(*[F.lit(kept[c]).alias(c) for c in ("total_requests", "total_bytes", "errors_5xx_exact")],
                       ((F.col("below") <= 0.97) & (F.col("upto") >= 0.93)).alias("p95_close"),
                       (F.abs(F.lit(kept["clients"]) - F.col("real")) <= 0.03 * F.col("real")).alias("clients_close"))
