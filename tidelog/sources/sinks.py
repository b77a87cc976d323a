"""Writers of the log table, exports and notifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidelog.functions.text import clean_text
from tidelog.functions.values import time_bounded
from tidelog.operators.search import not_gateway
from tidelog.session import cut_lineage

SORT_KEY = ["ServiceName", "SeverityText", "Timestamp"]
EXPORT_COLUMNS = ["Timestamp", "ContainerId", "ContainerName", "ContainerImage", "SeverityText", "HostName", "Body"]


def by_day(df: DataFrame) -> DataFrame:
    """Rows gathered by day and sorted: few files per day, narrow value ranges per row group.

    The rebalance is one pass over the rows; at run time a busy day is split into tasks of
    the advisory size and small days are put together.
    """
    return df.hint("rebalance", F.col("log_date")).sortWithinPartitions("log_date", *SORT_KEY)


def write_logs(df: DataFrame, path: str, mode: str = "append") -> None:
    """Day partitions, each file sorted by service, severity and time."""
    (by_day(df).write.mode(mode)
     .option("compression", "zstd")
     .option("parquet.bloom.filter.enabled#TraceId", "true")
     .option("parquet.bloom.filter.enabled#ContainerName", "true")
     .partitionBy("log_date").parquet(path))


def export_rows(df: DataFrame, containers: Sequence[str] | None = None,
                from_ts: str | None = None, to_ts: str | None = None) -> DataFrame:
    rows = not_gateway(time_bounded(df, from_ts, to_ts))
    if containers:
        rows = rows.filter(F.col("ContainerName").isin(*containers))
    return rows.select(*EXPORT_COLUMNS)


def export_logs(df: DataFrame, path: str, containers: Sequence[str] | None = None,
                from_ts: str | None = None, to_ts: str | None = None) -> None:
    """One JSON object per line, ascending in time over the sequence of files."""
    (export_rows(df, containers, from_ts, to_ts)
     .orderBy("Timestamp", "ContainerId", "Body")
     .write.mode("errorifexists").option("ignoreNullFields", "false").json(path))


def notification_rows(events: DataFrame, created_at: str = "created_at") -> DataFrame:
    """Cleaned notification rows with an id that repeats on a retry."""
    identity = F.concat_ws("\u001f", F.col("type"), F.col("title"), F.col("message"),
                           F.coalesce("container_id", F.lit("")), F.coalesce("container_name", F.lit("")),
                           F.coalesce(F.col(created_at).cast("string"), F.lit("")))
    return events.select(
        F.sha2(identity, 256).alias("id"), "type", "severity",
        clean_text("title").alias("title"), clean_text("message").alias("message"),
        "container_id", "container_name",
        F.col(created_at).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("read_at"))


def write_notifications(events: DataFrame, path: str, created_at: str = "created_at") -> None:
    """Append one detector run; rows already written are not repeated."""
    rows = cut_lineage(notification_rows(events, created_at).dropDuplicates(["id"]))
    run = rows.agg(F.min("created_at").alias("oldest"), F.count(F.lit(1)).alias("rows"),
                   F.count("created_at").alias("timed")).first()
    if not run["rows"]:
        return
    spark = rows.sparkSession
    if _exists(spark, path):
        # Only what is as new as this run, or has no time either, can repeat it: older row groups are skipped.
        new = F.lit(False) if run["oldest"] is None else F.col("created_at") >= F.lit(run["oldest"])
        if run["timed"] < run["rows"]:
            new |= F.col("created_at").isNull()
        written = spark.read.parquet(path).filter(new).select("id")
        rows = rows.join(written, "id", "left_anti")
    rows.sortWithinPartitions("created_at").write.mode("append").parquet(path)


def stream_notifications(events: DataFrame, path: str, checkpoint: str, created_at: str = "created_at"):
    """Append each micro-batch of a detector; a repeated batch writes nothing twice."""
    return (events.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, _: write_notifications(batch, path, created_at)))


def _exists(spark, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(target) and any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(target))
