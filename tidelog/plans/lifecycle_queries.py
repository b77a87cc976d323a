"""Queries of the data lifecycle: each works on a written copy of the log table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import fixed
from tidelog.operators import lifecycle
from tidelog.plans import views
from tidelog.plans.registry import AS_OF, given, register
from tidelog.session import shared_dir
from tidelog.sources.sinks import write_logs

_DAYS = "SELECT CAST(Timestamp AS DATE) AS log_date, count(*) AS rows FROM logs"


def _table(spark, sf) -> str:
    path = f"{shared_dir(spark, 'lifecycle')}/logs"
    write_logs(views.stored_logs(spark, sf), path)
    return path


@register("retention", "LC-1", given("logs") + _DAYS + f" WHERE CAST(Timestamp AS DATE) + 14 > CAST({AS_OF} AS DATE) GROUP BY 1")
def retention(spark, sf):
    path = _table(spark, sf)
    lifecycle.apply_retention(spark, path, views.AS_OF, 14)
    return lifecycle.day_counts(spark.read.parquet(path))


# The same runs once more, with every row that is left.
_ROWS = "SELECT LogId, Timestamp, SeverityText, ContainerName, ContainerId, ComposeProject, TraceId, Body FROM logs"


def _left(spark, path: str):
    return spark.read.parquet(path).select(
        "LogId", "Timestamp", "SeverityText", "ContainerName", "ContainerId", "ComposeProject", "TraceId", "Body")


@register("retained_rows", "LC-1", given("logs") + _ROWS + f" WHERE CAST(Timestamp AS DATE) + 14 > CAST({AS_OF} AS DATE)")
def retained_rows(spark, sf):
    path = _table(spark, sf)
    lifecycle.apply_retention(spark, path, views.AS_OF, 14)
    return _left(spark, path)


@register("purged_container_rows", "LC-2", given("logs") + _ROWS + " WHERE ContainerName <> 'svc-3'")
def purged_container_rows(spark, sf):
    path = _table(spark, sf)
    lifecycle.purge(spark, path, "container", "svc-3")
    return _left(spark, path)


@register("purged_stack_rows", "LC-2", given("logs") + _ROWS + " WHERE ComposeProject <> 'stack-2'")
def purged_stack_rows(spark, sf):
    path = _table(spark, sf)
    lifecycle.purge(spark, path, "stack", "stack-2")
    return _left(spark, path)


@register("cleared_rows", "LC-3", given("logs") + _ROWS + f" WHERE Timestamp >= {AS_OF} - INTERVAL 7 DAY")
def cleared_rows(spark, sf):
    path = _table(spark, sf)
    lifecycle.clear_older(spark, path, 7, views.AS_OF)
    return _left(spark, path)


@register("archived_rows", "LC-4", given("logs") + _ROWS)
def archived_rows(spark, sf):
    path = _table(spark, sf)
    lifecycle.archive_and_clear(spark, path, f"{path}-archive")
    return _left(spark, f"{path}-archive")


@register("restored_rows", "LC-5", given("logs") + _ROWS)
def restored_rows(spark, sf):
    path = _table(spark, sf)
    lifecycle.archive_and_clear(spark, path, f"{path}-archive")
    lifecycle.restore(spark, f"{path}-archive", path)
    return _left(spark, path)


@register("purged_container", "LC-2", given("logs") + _DAYS + " WHERE ContainerName <> 'svc-3' GROUP BY 1")
def purged_container(spark, sf):
    path = _table(spark, sf)
    lifecycle.purge(spark, path, "container", "svc-3")
    return lifecycle.day_counts(spark.read.parquet(path))


@register("purged_stack", "LC-2", given("logs") + _DAYS + " WHERE ComposeProject <> 'stack-2' GROUP BY 1")
def purged_stack(spark, sf):
    path = _table(spark, sf)
    lifecycle.purge(spark, path, "stack", "stack-2")
    return lifecycle.day_counts(spark.read.parquet(path))


@register("cleared_older", "LC-3", given("logs") + _DAYS + f" WHERE Timestamp >= {AS_OF} - INTERVAL 7 DAY GROUP BY 1")
def cleared_older(spark, sf):
    path = _table(spark, sf)
    lifecycle.clear_older(spark, path, 7, views.AS_OF)
    return lifecycle.day_counts(spark.read.parquet(path))


@register("archived", "LC-4", given("logs") + "SELECT count(*) AS cleared_rows, CAST(count(*) AS BIGINT) AS archived_rows FROM logs")
def archived(spark, sf):
    path = _table(spark, sf)
    archive = f"{path}-archive"
    cleared = lifecycle.archive_and_clear(spark, path, archive)
    return spark.read.parquet(archive).agg(F.lit(cleared).cast("bigint").alias("cleared_rows"),
                                           F.count(F.lit(1)).alias("archived_rows"))


@register("restored", "LC-5", given("logs") + "SELECT count(*) AS rows, min(Timestamp) AS min_ts, max(Timestamp) AS max_ts FROM logs")
def restored(spark, sf):
    path = _table(spark, sf)
    return lifecycle.restore(spark, path, f"{path}-restored")


def _backfilled(spark, sf) -> str:
    path = f"{shared_dir(spark, 'backfill')}/logs"
    rows = views.stored_logs(spark, sf)
    attributes = F.when(F.col("ComposeProject") != "", F.create_map(F.lit(fixed.PROJECT_ATTR), F.col("ComposeProject")))
    # As before the column existed: the project is in the attributes only.
    write_logs(rows.withColumn("ResourceAttributes", attributes).withColumn("ComposeProject", F.lit("")), path)
    lifecycle.backfill_project(spark, path)
    return path


@register("backfilled_rows", "LC-6", given("logs") + _ROWS)
def backfilled_rows(spark, sf):
    return _left(spark, _backfilled(spark, sf))


@register("backfilled_project", "LC-6", given("logs") + "SELECT ComposeProject, count(*) AS rows FROM logs GROUP BY 1")
def backfilled_project(spark, sf):
    path = _backfilled(spark, sf)
    return spark.read.parquet(path).groupBy("ComposeProject").agg(F.count(F.lit(1)).alias("rows"))
