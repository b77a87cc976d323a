"""Log, access and dimension tables derived from the given test tables.

`*_SQL` is the same text for Spark and for the checks; `{T0}` is the only difference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog.functions import fixed
from tidelog.operators.access import typed_requests

AS_OF = "2024-01-31 00:00:00"
HOURS = 744  # the 30 days of the tables and a day more
T0_SPARK = "timestamp_ntz'2024-01-01 00:00:00'"
T0_ORACLE = "timestamp '2024-01-01 00:00:00'"
REGISTRY = "registry.example.org:443"

LOGS_SQL = """
SELECT event_id AS LogId, ts AS Timestamp,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'DEBUG' ELSE '' END AS SeverityText,
  concat('svc-', CAST(user_id % 7 AS STRING)) AS ContainerName,
  concat('cid-', CAST(user_id AS STRING)) AS ContainerId,
  concat('svc-', CAST(user_id % 7 AS STRING)) AS ServiceName,
  CASE WHEN user_id % 5 = 0 THEN '' ELSE concat('host-', CAST(user_id % 3 AS STRING)) END AS HostName,
  CASE WHEN user_id % 4 = 0 THEN '' ELSE concat('stack-', CAST(user_id % 4 AS STRING)) END AS ComposeProject,
  CASE WHEN user_id % 6 = 0 THEN '' ELSE concat('app-', CAST(user_id % 6 AS STRING)) END AS ComposeService,
  concat('t', CAST(event_id % 500 AS STRING)) AS TraceId,
  concat(CASE WHEN event_id % 97 = 0 THEN 'Deadlock detected on' WHEN event_id % 89 = 0 THEN 'out of memory in'
              WHEN event_id % 83 = 0 THEN 'Rate limit exceeded for' ELSE event_type END,
         ' req ', CAST(event_id AS STRING), ' from 10.0.', CAST(user_id % 256 AS STRING), '.', CAST(event_id % 256 AS STRING),
         ' took ', CAST(event_id % 1000 AS STRING), 'ms') AS Body
FROM events
"""

ACCESS_SQL = """
SELECT {T0} + (l_orderkey*7919 + l_linenumber*613 + l_partkey*31) % 2592000 * INTERVAL '1' SECOND AS Timestamp,
  concat('10.1.0.', CAST(l_suppkey % 256 AS STRING)) AS remote_addr,
  CASE l_linenumber % 4 WHEN 0 THEN 'POST' WHEN 3 THEN 'PUT' ELSE 'GET' END AS method,
  CASE WHEN l_partkey % 53 = 0 THEN '/healthz' ELSE concat('/part/', CAST(l_partkey % 50 AS STRING)) END AS path,
  CASE WHEN l_returnflag = 'A' THEN '-' ELSE concat('https://site-', CAST(l_suppkey % 5 AS STRING), '.example') END AS referer,
  CASE WHEN l_orderkey % 41 = 0 THEN 'abc' WHEN l_orderkey % 13 = 0 THEN '502' WHEN l_orderkey % 7 = 0 THEN '404'
       WHEN l_orderkey % 11 = 0 THEN '302' ELSE '200' END AS status,
  CAST(CAST(l_quantity*1000 AS BIGINT) AS STRING) AS bytes_sent,
  CAST(l_discount*10 + l_tax AS STRING) AS request_time
FROM lineitem
"""

USERS_SQL = """
SELECT c_custkey AS id, concat(' User', CAST(c_custkey AS STRING), CASE WHEN c_custkey % 2 = 0 THEN '@Example.org' ELSE '' END) AS username,
  concat('user', CAST(c_custkey AS STRING), '@example.org') AS email,
  CASE c_nationkey % 5 WHEN 0 THEN 'admin' ELSE 'developer' END AS role
FROM customer
"""

OWNERSHIP_SQL = """
SELECT concat('svc-', CAST(s_suppkey % 7 AS STRING)) AS container_id, s_suppkey % 10 + 1 AS user_id,
  max(CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE '' END) AS custom_name
FROM supplier GROUP BY s_suppkey % 7, s_suppkey % 10
"""

# Runtime snapshots: one container per part, list fields and inspect fields side by side.
RUNTIME_SQL = """
SELECT concat('cid-', CAST(p_partkey AS STRING), '-0123456789ab') AS id,
  CASE WHEN p_partkey % 17 = 0 THEN '' ELSE concat('stack-', CAST(p_partkey % 4 AS STRING), '-app-', CAST(p_partkey % 6 AS STRING), '-', CAST(p_partkey AS STRING)) END AS raw_name,
  CASE WHEN p_partkey % 19 = 0 THEN '' ELSE p_type END AS raw_image,
  CASE WHEN p_size % 9 = 0 THEN 'exited' WHEN p_partkey % 23 = 0 THEN '' ELSE 'running' END AS raw_state,
  CASE p_size % 5 WHEN 0 THEN 'Up 2 minutes (healthy)' WHEN 1 THEN 'Up 3 hours (unhealthy)' WHEN 2 THEN '' ELSE 'Up 4 days' END AS raw_status,
  p_partkey % 8 <> 0 AS inspected,
  CASE WHEN p_partkey % 8 <> 0 AND p_partkey % 6 = 0 THEN CAST(p_size % 4 AS INT) ELSE 0 END AS restart_count,
  p_partkey % 8 <> 0 AND p_partkey % 37 = 0 AS oom_killed,
  CASE WHEN p_partkey % 8 <> 0 THEN CASE WHEN p_size % 9 = 0 THEN 137 ELSE 0 END END AS exit_code,
  CASE WHEN p_partkey % 8 <> 0 THEN '2024-01-30T12:00:00' END AS started_at,
  CASE WHEN p_partkey % 8 <> 0 AND p_size % 9 = 0 THEN '2024-01-30T18:30:00' END AS finished_at
FROM part
"""

NOTIFICATIONS_SQL = """
SELECT CAST(event_id AS STRING) AS id,
  CASE event_type WHEN 'error' THEN 'log_spam' WHEN 'signup' THEN 'container_down' WHEN 'click' THEN 'warning' ELSE 'deadlock' END AS type,
  CASE WHEN event_type = 'error' THEN 'critical' ELSE 'info' END AS severity,
  concat(CASE event_id % 4 WHEN 0 THEN '???? ' WHEN 1 THEN '?????? ' WHEN 2 THEN '??? ' ELSE '' END, 'Notice ', event_type, ' ') AS title,
  concat(' event ', CAST(event_id AS STRING), ' of user ', CAST(user_id AS STRING)) AS message,
  concat('cid-', CAST(user_id AS STRING)) AS container_id,
  concat(CASE WHEN user_id % 4 = 0 THEN '' ELSE concat('stack-', CAST(user_id % 4 AS STRING), '-app-', CAST(user_id % 6 AS STRING), '-') END, 'svc-', CAST(user_id % 7 AS STRING)) AS container_name,
  ts AS created_at, CASE WHEN event_id % 3 = 0 THEN ts END AS read_at
FROM events
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derive(spark: SparkSession, sf_dir: str, source: str, text: str) -> DataFrame:
    body = text.format(T0=T0_SPARK).replace(f"FROM {source}", "FROM {given}")
    return spark.sql(body, given=table(spark, sf_dir, source))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, "events", LOGS_SQL)


def raw_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, "lineitem", ACCESS_SQL)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, "customer", USERS_SQL)


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, "supplier", OWNERSHIP_SQL)


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, "events", NOTIFICATIONS_SQL)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _derive(spark, sf_dir, "part", RUNTIME_SQL)
    names = F.when(F.col("raw_name") == "", F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("/"), "raw_name")))
    return rows.withColumn("names", names).withColumnRenamed("raw_image", "image").drop("raw_name")


def access_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access rows as stored log records: every field is text in the attribute map."""
    fields = ["remote_addr", "method", "path", "referer", "status", "bytes_sent", "request_time"]
    pairs = [x for f in fields for x in (F.lit(f), F.col(f))]
    return raw_access(spark, sf_dir).select(
        "Timestamp", F.lit(fixed.GATEWAY_SERVICE).alias("ServiceName"), F.create_map(*pairs).alias("LogAttributes"))


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_requests(raw_access(spark, sf_dir))


def container_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log rows as collected container events with labels; empty labels are absent."""
    rows = logs(spark, sf_dir)
    label = lambda key, c: F.when(F.col(c) != "", F.struct(F.lit(key).alias("key"), F.col(c).alias("value")))
    labels = F.map_from_entries(F.array_compact(F.array(
        label(fixed.PROJECT_LABEL, "ComposeProject"), label(fixed.SERVICE_LABEL, "ComposeService"))))
    return rows.select(
        F.col("LogId").alias("event_id"), F.col("Timestamp").alias("timestamp"),
        F.col("ContainerId").alias("container_id"), F.col("ContainerName").alias("container_name"),
        F.concat(F.lit("image:"), "ContainerName").alias("image"),
        F.when(F.col("SeverityText") == "ERROR", "stderr").otherwise("stdout").alias("stream"),
        F.col("Body").alias("message"), F.col("HostName").alias("host"), labels.alias("label"))


def ingress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log rows as ingress rows: attributes in maps, empty ones absent."""
    rows = logs(spark, sf_dir)
    entry = lambda key, c: F.when(F.col(c) != "", F.struct(F.lit(key).alias("key"), F.col(c).alias("value")))
    resource = F.map_from_entries(F.array_compact(F.array(
        entry(fixed.CONTAINER_NAME, "ContainerName"), entry(fixed.CONTAINER_ID, "ContainerId"),
        entry(fixed.HOST_NAME, "HostName"), entry(fixed.PROJECT_ATTR, "ComposeProject"),
        entry(fixed.SERVICE_ATTR, "ComposeService"))))
    return rows.select("LogId", "Timestamp", "TraceId", F.lit("").alias("SpanId"), "SeverityText",
                       F.lit(0).alias("SeverityNumber"), "ServiceName", "Body",
                       resource.alias("ResourceAttributes"),
                       F.create_map(F.lit("log.iostream"), F.lit("stdout")).alias("LogAttributes"))


def stored_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log rows with their day, as the log table holds them."""
    return logs(spark, sf_dir).withColumn("log_date", F.to_date("Timestamp"))


def image_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows with an image path `registry/user/project`; a few come from elsewhere."""
    user = F.regexp_extract("ContainerId", "([0-9]+)", 1).cast("bigint")
    image = (F.when(user % 6 == 0, F.concat(F.lit("docker.example.com/User"), user.cast("string"), F.lit("/web")))
             .when(user % 6 == 1, F.lit(f"{REGISTRY}/base"))
             .otherwise(F.concat(F.lit(f"{REGISTRY}/USER"), user.cast("string"), F.lit("/web:latest"))))
    return logs(spark, sf_dir).withColumn("ContainerImage", image)
