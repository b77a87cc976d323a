"""Readers: files and JSON payloads to rows. The parse functions also serve readStream."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidelog.functions.values import attr
from tidelog.sources import schema
from tidelog.sources.tailing import tail_lines


def parse_container_lines(lines: DataFrame, value: str = "value", received: str | None = None) -> DataFrame:
    """Container JSON log lines; a line that is no JSON stays as the body.

    A line without a time of its own takes the column `received`, so that searches and retention see it.
    """
    parsed = lines.withColumn("_line", F.from_json(value, schema.CONTAINER_LINE))
    ok = F.col("_line.log").isNotNull()
    stamp = F.col("_line.time")
    arrived = F.col(received).cast("timestamp") if received else F.lit(None).cast("timestamp")
    return (parsed
            .withColumn("Timestamp", F.coalesce(F.try_to_timestamp(stamp), arrived))
            .withColumn("ts_nanos", F.coalesce(_nanos_of_text(stamp), F.unix_micros(arrived) * 1000))
            .withColumn("Body", F.when(ok, F.col("_line.log")).otherwise(F.col(value)))
            .withColumn("level", F.col("_line.level"))
            .withColumn("attrs", F.col("_line.attrs"))
            .withColumn("LogAttributes", F.when(
                F.col("_line.stream").isNotNull(),
                F.create_map(F.lit("log.iostream"), F.col("_line.stream")))
                .otherwise(F.create_map().cast("map<string,string>")))
            .withColumn("parsed", ok)
            .drop("_line"))


def _nanos_of_text(stamp: Column) -> Column:
    """Whole nanoseconds of an ISO time; the timestamp type itself stops at microseconds."""
    fraction = F.rpad(F.regexp_extract(stamp, r"\.([0-9]{1,9})", 1), 9, "0").cast("bigint")
    return F.unix_seconds(F.try_to_timestamp(stamp)) * 1_000_000_000 + fraction


def read_container_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files; one without a time has that of its file's last change."""
    lines = spark.read.text(path, recursiveFileLookup=True)
    named = lines.withColumns({"log_file": F.col("_metadata.file_path"), "_file_time": F.col("_metadata.file_modification_time")})
    return parse_container_lines(named, received="_file_time").drop("_file_time")


def stream_container_logs(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.readStream.text(path).withColumn("_file_time", F.col("_metadata.file_modification_time"))
    return parse_container_lines(lines, received="_file_time").drop("_file_time")


def tail_container_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files that grow, from their beginning, as they are appended; one without a time has that of its arrival."""
    lines = tail_lines(spark, path).select("value", F.col("path").alias("log_file"), F.current_timestamp().alias("_arrived"))
    return parse_container_lines(lines, received="_arrived").drop("_arrived")


def read_container_events(spark: SparkSession, path: str, exclude: Sequence[str] = ()) -> DataFrame:
    events = spark.read.schema(schema.CONTAINER_EVENT).json(path)
    return drop_containers(events, exclude)


def drop_containers(events: DataFrame, exclude: Sequence[str], name: str = "container_name") -> DataFrame:
    if not exclude:
        return events
    return events.filter(~F.coalesce(F.col(name), F.lit("")).isin(*exclude))


def read_access_lines(spark: SparkSession, path: str, max_age: timedelta | None = timedelta(hours=24),
                      as_of: datetime | None = None) -> DataFrame:
    """Lines of access logs, without files older than `max_age`."""
    reader = spark.read
    if max_age is not None:
        oldest = (as_of or datetime.now(timezone.utc)) - max_age
        reader = reader.option("modifiedAfter", oldest.strftime("%Y-%m-%dT%H:%M:%S")).option("timeZone", "UTC")
    return reader.text(path).withColumnRenamed("value", "message")


def stream_access_lines(spark: SparkSession, path: str, max_age: str = "24h") -> DataFrame:
    return (spark.readStream.option("maxFileAge", max_age).option("latestFirst", "false")
            .text(path).withColumnRenamed("value", "message"))


def tail_access_lines(spark: SparkSession, path: str, max_age: timedelta | None = timedelta(hours=24), start_at_end: bool = True) -> DataFrame:
    """Lines appended to access logs since the stream first started, of files that were changed within `max_age`."""
    seconds = max_age.total_seconds() if max_age else None
    return tail_lines(spark, path, start_at_end, seconds).select(F.col("value").alias("message"))


def _attribute_map(attributes: Column) -> Column:
    """Attributes as a map: of a repeated key the last value counts, one without a key is left out."""
    named = F.filter(attributes, lambda a: a["key"].isNotNull())
    keys = F.array_distinct(F.transform(named, lambda a: a["key"]))
    last = lambda k: F.element_at(F.filter(named, lambda a: a["key"] == k), -1)["value"]
    pairs = F.transform(keys, lambda k: F.struct(k.alias("key"), F.coalesce(_any_value(last(k), "bytesValue"), F.lit("")).alias("value")))
    return F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<string,string>"))


def _any_value(value: Column, *more: str) -> Column:
    """The text of a wire value of any kind; lists and nested ones keep their JSON."""
    return F.coalesce(*(value[kind] for kind in ("stringValue", "intValue", "doubleValue", "boolValue", "arrayValue", "kvlistValue", *more)))


def flatten_otlp(payloads: DataFrame, value: str = "value", received: str | None = None) -> DataFrame:
    """Envelope resourceLogs -> scopeLogs -> logRecords, one row per log record.

    A record whose time is missing, zero or no number takes its observed time, or else the column `received`; the
    record is kept in any case.
    """
    text = F.lit("")
    nanos = lambda c: F.nullif(F.col(c).try_cast("bigint"), F.lit(0).cast("bigint"))
    arrived = F.unix_micros(F.col("_received")) * 1000
    return (payloads
            .select(F.from_json(value, schema.OTLP).alias("_otlp"),
                    (F.col(received).cast("timestamp") if received else F.lit(None).cast("timestamp")).alias("_received"))
            .select("_received", F.explode("_otlp.resourceLogs").alias("r"))
            .select("_received", "r", F.explode("r.scopeLogs").alias("s"))
            .select("_received", "r", "s", F.explode("s.logRecords").alias("l"))
            .withColumn("_nanos", F.coalesce(nanos("l.timeUnixNano"), nanos("l.observedTimeUnixNano"), arrived))
            .select(
                F.timestamp_micros(F.floor(F.col("_nanos") / 1000).cast("bigint")).alias("Timestamp"),
                F.col("_nanos").alias("ts_nanos"),
                F.coalesce("l.traceId", text).alias("TraceId"),
                F.coalesce("l.spanId", text).alias("SpanId"),
                F.coalesce("l.flags", F.lit(0).cast("bigint")).alias("TraceFlags"),
                F.coalesce("l.severityText", text).alias("SeverityText"),
                F.coalesce("l.severityNumber", F.lit(0)).alias("SeverityNumber"),
                F.coalesce(_any_value(F.col("l.body")), text).alias("Body"),
                F.coalesce("r.schemaUrl", text).alias("ResourceSchemaUrl"),
                _attribute_map(F.col("r.resource.attributes")).alias("ResourceAttributes"),
                F.coalesce("s.schemaUrl", text).alias("ScopeSchemaUrl"),
                F.coalesce("s.scope.name", text).alias("ScopeName"),
                F.coalesce("s.scope.version", text).alias("ScopeVersion"),
                _attribute_map(F.col("s.scope.attributes")).alias("ScopeAttributes"),
                _attribute_map(F.col("l.attributes")).alias("LogAttributes"))
            .withColumn("ServiceName", attr("ResourceAttributes", "service.name")))


def flatten_alert_payloads(payloads: DataFrame, value: str = "value", received: str | None = None) -> DataFrame:
    """Alert webhook payloads to notification rows."""
    labels, notes = F.col("a.labels"), F.col("a.annotations")
    severity = F.coalesce(labels["severity"], F.lit("warning"))
    name = F.coalesce(labels["alertname"], F.lit("Unknown Alert"))
    tag = F.when(F.col("a.status") == "resolved", "[RESOLVED]").otherwise("[ALERT]")
    keep = [received] if received else []
    return (payloads
            .select(*keep, F.from_json(value, schema.ALERTS).alias("_p"))
            .select(*keep, F.explode("_p.alerts").alias("a"))
            .select(
                *keep,
                F.when(severity == "critical", "critical").otherwise("warning").alias("type"),
                severity.alias("severity"),
                F.concat_ws(" ", tag, name).alias("title"),
                F.coalesce(notes["summary"], name).alias("message"),
                F.nullif(F.coalesce(labels["name"], labels["container"], F.lit("")), F.lit("")).alias("container_name")))


def parse_runtime_snapshots(listed: DataFrame, inspected: DataFrame, value: str = "value",
                            keys: Sequence[str] = ()) -> DataFrame:
    """Container list entries with their inspect record, as JSON text, joined by snapshot and id."""
    keys = list(keys)
    rows = (listed.select(*keys, F.from_json(value, schema.CONTAINER_LIST).alias("c"))
            .select(*keys, F.coalesce("c.Id", F.lit("")).alias("id"), F.col("c.Names").alias("names"),
                    F.col("c.Image").alias("image"), F.col("c.State").alias("raw_state"),
                    F.col("c.Status").alias("raw_status")))
    detail = (inspected.select(*keys, F.from_json(value, schema.CONTAINER_INSPECT).alias("i"))
              .select(*keys, F.col("i.Id").alias("id"), F.lit(True).alias("inspected"),
                      F.coalesce("i.RestartCount", F.lit(0)).alias("restart_count"),
                      F.coalesce("i.State.OOMKilled", F.lit(False)).alias("oom_killed"),
                      F.col("i.State.ExitCode").alias("exit_code"),
                      F.nullif("i.State.StartedAt", F.lit("")).alias("started_at"),
                      F.nullif("i.State.FinishedAt", F.lit("")).alias("finished_at")))
    return (rows.join(detail, [*keys, "id"], "left")
            .withColumn("inspected", F.coalesce("inspected", F.lit(False)))
            .withColumn("restart_count", F.coalesce("restart_count", F.lit(0)))
            .withColumn("oom_killed", F.coalesce("oom_killed", F.lit(False))))


def read_runtime_snapshots(spark: SparkSession, list_path: str, inspect_path: str) -> DataFrame:
    return parse_runtime_snapshots(spark.read.text(list_path), spark.read.text(inspect_path))


def load_dims(spark: SparkSession, users: str, ownership: str,
              jdbc: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """User and ownership tables from Parquet paths, or from JDBC tables of those names."""
    if jdbc:
        load = lambda table: spark.read.format("jdbc").options(dbtable=table, **jdbc).load()
    else:
        load = spark.read.parquet
    return load(users), load(ownership)
