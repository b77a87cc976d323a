"""Service roll-ups: containers, services, overview."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.functions.text import severity_is
from tidelog.functions.values import at, before, micros, or_default, time_bounded
from tidelog.operators.scope import service_name
from tidelog.operators.search import not_gateway


def with_service_key(df: DataFrame) -> DataFrame:
    host = or_default("HostName", "unknown-host")
    project = or_default("ComposeProject", "standalone")
    service = service_name(df)
    return df.withColumns({"host_id": host, "compose_project": project, "compose_service": service,
                           "service_key": F.concat_ws("/", host, project, service)})


def service_summary(df: DataFrame, as_of: str | Column, hours: float = 24, host: str | None = None,
                    containers: Sequence[str] | None = None, limit: int | None = 500) -> DataFrame:
    """Instances, logs and errors per service, newest first; without a limit all services, for further steps.

    One hash aggregation over the rows, per container instance and with numbers only;
    distinct instances and the sample name come from that small table.
    """
    rows = time_bounded(df, before(as_of, hours, "HOUR"))
    if host:
        rows = rows.filter(F.col("HostName") == host)
    if containers is not None:
        rows = rows.filter(F.col("ContainerName").isin(*containers)) if containers else rows.filter(F.lit(False))
    key = ["service_key", "host_id", "compose_project", "compose_service"]
    instances = (with_service_key(rows)
                 .groupBy(*key[1:], "ContainerId", "ContainerName")
                 .agg(F.max("Timestamp").alias("seen"), F.count(F.lit(1)).alias("logs"),
                      F.count_if(severity_is("error", "fatal")).alias("errors"))
                 .withColumn("service_key", F.concat_ws("/", *key[1:])))
    active = F.when(F.col("seen") >= before(as_of, 5, "MINUTE"), F.col("ContainerId"))
    summary = instances.groupBy(*key).agg(
        F.max("seen").alias("last_seen"),
        F.count_distinct("ContainerId").alias("instance_count"),
        F.count_distinct(active).alias("active_instance_count"),
        F.sum("logs").alias("log_count"),
        F.sum("errors").alias("error_count"),
        F.max_by("ContainerName", F.struct("seen", "ContainerName")).alias("sample_container_name"))
    if limit is None:
        return summary
    return summary.orderBy(F.col("last_seen").desc(), "service_key").limit(limit)


def overview(services: DataFrame) -> DataFrame:
    """One row of totals and the overall health."""
    number = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).cast("bigint")
    erring = F.coalesce(F.col("error_count"), F.lit(0)) > 0
    inactive = (F.coalesce(F.col("instance_count"), F.lit(0)) > 0) & (
        F.coalesce(F.col("active_instance_count"), F.lit(0)) == 0)
    rows = services.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_distinct(or_default("host_id", "unknown")).alias("hosts"),
        F.count_distinct(F.nullif("service_key", F.lit(""))).alias("services"),
        number("instance_count").alias("instances"),
        number("active_instance_count").alias("active_instances"),
        number("log_count").alias("logs"), number("error_count").alias("errors"),
        F.count_if(erring).alias("services_with_errors"), F.count_if(inactive).alias("inactive_services"))
    status = (F.when(F.col("_rows") == 0, "quiet")
              .when((F.col("services_with_errors") > 0) | (F.col("inactive_services") > 0), "warning")
              .otherwise("healthy"))
    return rows.withColumn("status", status).drop("_rows")


def top_services(services: DataFrame, n: int | None = None, by: str = "errors") -> DataFrame:
    """By (errors, logs) among services with errors, or by logs among all."""
    if by == "errors":
        return (services.filter(F.col("error_count") > 0)
                .orderBy(F.col("error_count").desc(), F.col("log_count").desc(), "service_key").limit(n or 5))
    return services.orderBy(F.col("log_count").desc(), "service_key").limit(n or 8)


def focus_service(services: DataFrame) -> DataFrame:
    return services.orderBy(F.col("error_count").desc(), F.col("log_count").desc(), "service_key").limit(1)


def container_list(df: DataFrame, as_of: str | Column, hours: float = 24, limit: int | None = 100) -> DataFrame:
    """Containers by project, the latest first: the list as displayed. Without a limit all, for further steps."""
    rows = time_bounded(not_gateway(df), before(as_of, hours, "HOUR"), open_start=True)
    found = (rows.groupBy("ContainerName", or_default("ComposeProject", "Other").alias("compose_project"))
             .agg(F.max("Timestamp").alias("last_seen"), F.count(F.lit(1)).alias("log_count"),
                  F.count_if(severity_is("error")).alias("error_count")))
    if limit is None:
        return found
    return found.orderBy("compose_project", F.col("last_seen").desc(), "ContainerName").limit(limit)


def activity(df: DataFrame, as_of: str | Column, green: float = 60, amber: float = 300,
             last_seen: str = "last_seen") -> DataFrame:
    """Adds the age in seconds and its colour; never seen is red."""
    age = (micros(at(as_of)) - micros(last_seen)) / 1_000_000
    return (df.withColumn("age_seconds", age)
            .withColumn("dot", F.when(F.col("age_seconds") < green, "green")
                        .when(F.col("age_seconds") < amber, "amber").otherwise("red")))
