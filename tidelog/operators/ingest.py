"""Ingest transforms: DataFrame in, DataFrame out, for batch and readStream alike."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.functions import fixed
from tidelog.functions.values import attr, first_filled
from tidelog.sources.schema import LOG_TABLE


def to_log_record(events: DataFrame) -> DataFrame:
    """Container events to ingress rows with resource attributes."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    service = F.coalesce(F.col("label")[fixed.SERVICE_LABEL], text("container_name"))
    pairs = [(fixed.CONTAINER_NAME, service), (fixed.CONTAINER_ID, text("container_id")),
             (fixed.CONTAINER_IMAGE, text("image")), (fixed.SERVICE_NAME, service),
             (fixed.HOST_NAME, text("host")), (fixed.PROJECT_ATTR, attr("label", fixed.PROJECT_LABEL)),
             (fixed.SERVICE_ATTR, service)]
    return (events
            .withColumn("ResourceAttributes", F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]))
            .withColumn("LogAttributes", F.create_map(
                F.lit("log.iostream"), F.coalesce(F.col("stream"), F.lit("stdout"))))
            .withColumn("ServiceName", service)
            .withColumn("Body", text("message"))
            .withColumn("Timestamp", F.col("timestamp"))
            .withColumn("SeverityText", F.lit("")))


def enrich_edge(events: DataFrame, host_id: str | Column, site: str = "default", env: str = "dev") -> DataFrame:
    """Edge identity columns; the service key only where project and service are both known."""
    host = host_id if isinstance(host_id, Column) else F.lit(host_id)
    project, service = F.col("label")[fixed.PROJECT_LABEL], F.col("label")[fixed.SERVICE_LABEL]
    return events.withColumns({
        "edge_host_id": host,
        "edge_site": F.lit(site),
        "edge_env": F.lit(env),
        "compose_project": project,
        "compose_service": service,
        "instance_key": F.col("container_id"),
        "service_key": F.when(project.isNotNull() & service.isNotNull(),
                              F.concat_ws("/", host, project, service)),
    })


def drop_blank(df: DataFrame, body: str = "Body") -> DataFrame:
    return df.filter(~F.coalesce(F.col(body), F.lit("")).rlike(r"^\s*$"))


def infer_severity(df: DataFrame, severity: str = "SeverityText", body: str = "Body") -> DataFrame:
    """Severity by keywords of the body, only where it is empty."""
    current = F.coalesce(F.col(severity), F.lit(""))
    chain = F.when(current != "", current)
    for name, pattern in fixed.SEVERITY_WORDS:
        chain = chain.when(F.col(body).rlike(pattern), name)
    return df.withColumn(severity, chain.otherwise("INFO"))


def promote_attrs(df: DataFrame, attrs: str = "attrs") -> DataFrame:
    """Container name and project from the log driver's labels; service name defaults to the container."""
    resource = F.col("ResourceAttributes")
    labels = F.col(attrs)
    service, project = labels[fixed.SERVICE_LABEL], labels[fixed.PROJECT_LABEL]
    entries = F.array_compact(F.array(
        F.when(service.isNotNull(), F.struct(F.lit(fixed.CONTAINER_NAME).alias("key"), service.alias("value"))),
        F.when(project.isNotNull(), F.struct(F.lit(fixed.PROJECT_ATTR).alias("key"), project.alias("value")))))
    promoted = F.map_from_entries(entries)
    merged = F.when(labels.isNull(), resource).otherwise(F.map_concat(
        F.map_filter(resource, lambda k, _: ~F.map_contains_key(promoted, k)), promoted))
    out = df.withColumn("ResourceAttributes", merged)
    container = attr("ResourceAttributes", fixed.CONTAINER_NAME)
    named = attr("ResourceAttributes", fixed.SERVICE_NAME)
    with_service = F.when(named == "", F.map_concat(
        F.map_filter("ResourceAttributes", lambda k, _: k != fixed.SERVICE_NAME),
        F.create_map(F.lit(fixed.SERVICE_NAME), container))).otherwise(F.col("ResourceAttributes"))
    return (out.withColumn("ResourceAttributes", with_service)
            .withColumn("ServiceName", attr("ResourceAttributes", fixed.SERVICE_NAME))
            .drop(attrs))


def drop_severity(df: DataFrame, names: Sequence[str] = ("DEBUG",), severity: str = "SeverityText") -> DataFrame:
    return df.filter(~F.coalesce(F.col(severity), F.lit("")).isin(*names))


def exclude_containers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drops rows of the collector's own containers, by resource attribute."""
    return df.filter(~attr("ResourceAttributes", fixed.CONTAINER_NAME).isin(*names))


def parse_level(df: DataFrame, level: str = "level") -> DataFrame:
    """Severity text and number from a `level` attribute, where there is a known one."""
    name = F.lower(F.trim(F.col(level)))
    text, number = F.coalesce(F.col("SeverityText"), F.lit("")), F.lit(0)
    for severity, value, aliases in fixed.LEVEL_NAMES:
        text = F.when(name.isin(*aliases), severity).otherwise(text)
        number = F.when(name.isin(*aliases), value).otherwise(number)
    return df.withColumn("SeverityText", text).withColumn("SeverityNumber", number)


def materialize(df: DataFrame, env_default: str = "") -> DataFrame:
    """Hot attributes as columns, and the day partition.

    A missing environment stays empty by default, as in the stored table;
    `env_default='production'` gives the evident intent.
    """
    env = attr("ResourceAttributes", fixed.ENVIRONMENT)
    return with_log_id(df).withColumns({
        "ContainerName": attr("ResourceAttributes", fixed.CONTAINER_NAME),
        "ContainerImage": attr("ResourceAttributes", fixed.CONTAINER_IMAGE),
        "ContainerId": attr("ResourceAttributes", fixed.CONTAINER_ID),
        "HostName": attr("ResourceAttributes", fixed.HOST_NAME),
        "Environment": F.when(env == "", env_default).otherwise(env) if env_default else env,
        "ComposeProject": attr("ResourceAttributes", fixed.PROJECT_ATTR),
        "log_date": F.to_date("Timestamp"),
    })


def with_log_id(df: DataFrame) -> DataFrame:
    """A row id for tie-breaks that a repeated run gives again; rows that differ in nothing share it."""
    if "LogId" in df.columns:
        return df
    parts = [c for c in ("ts_nanos", "TraceId", "SpanId", "ServiceName", "SeverityText", "Body") if c in df.columns]
    resource = [attr("ResourceAttributes", key) for key in (fixed.HOST_NAME, fixed.CONTAINER_ID, fixed.CONTAINER_NAME)]
    attributes = [F.map_values("LogAttributes")] if "LogAttributes" in df.columns else []
    return df.withColumn("LogId", F.xxhash64(F.unix_micros(F.col("Timestamp").cast("timestamp")), *parts, *resource, *attributes))


def service_identity(df: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Stable service key, instance key and how sure the identity is."""
    part = {}
    for field, aliases in fixed.IDENTITY_ALIASES.items():
        default = "unknown-host" if field == "host_id" else ""
        part[field] = first_filled([F.col(attributes)[a] for a in aliases], default)
    composed = (part["compose_project"] != "") & (part["compose_service"] != "")
    fallback = F.coalesce(F.nullif(part["container_name"], F.lit("")),
                          F.nullif(part["container_id"], F.lit("")), F.lit("unknown-container"))
    return df.withColumns({
        "service_key": F.when(composed, F.concat_ws(
            "/", part["host_id"], part["compose_project"], part["compose_service"]))
            .otherwise(F.concat_ws("/", part["host_id"], F.lit("standalone"), fallback)),
        "instance_key": F.nullif(part["container_id"], F.lit("")),
        "identity_confidence": F.when(composed, "high").otherwise("fallback"),
    })


def stored_columns(df: DataFrame) -> DataFrame:
    """Columns of the log table; what else the wire format carries is not stored."""
    stored = [field.strip().split()[0] for field in re.sub(r"<[^>]*>", "", LOG_TABLE).split(",")]
    return df.select(*[c for c in stored if c in df.columns])


def ingest_logs(ingress: DataFrame, self_names: Sequence[str] = (), dropped: Sequence[str] = (),
                env_default: str = "") -> DataFrame:
    """The whole path from ingress rows to rows of the log table."""
    rows = drop_blank(ingress)
    if "level" in rows.columns:
        rows = parse_level(rows)
    rows = infer_severity(rows)
    if "attrs" in rows.columns:
        rows = promote_attrs(rows)
    if dropped:
        rows = drop_severity(rows, dropped)
    if self_names:
        rows = exclude_containers(rows, self_names)
    return stored_columns(materialize(rows, env_default))
