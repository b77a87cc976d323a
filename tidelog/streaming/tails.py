"""Live tails, incremental ingest and windowed detectors on streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog.functions import fixed
from tidelog.functions.text import spam_group, text_match
from tidelog.functions.values import half_even
from tidelog.operators.access import access_logs
from tidelog.operators.ingest import ingest_logs
from tidelog.operators.rollups import hourly_parts
from tidelog.operators.search import not_gateway
from tidelog.sources import schema
from tidelog.sources.sinks import write_logs

TAIL_COLUMNS = ["Timestamp", "ContainerName", "SeverityText", "Body"]


def with_lateness(df: DataFrame, ts: str = "Timestamp", delay: str = "2 minutes",
                  unique: Sequence[str] = ()) -> DataFrame:
    """Watermark on event time; with `unique`, repeated deliveries within the delay are dropped."""
    marked = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return marked.dropDuplicatesWithinWatermark(list(unique)) if unique else marked


def tail_logs(df: DataFrame, containers: Sequence[str] = (), project: str = "", level: str = "",
              text: str = "") -> DataFrame:
    """New log rows that meet the filters."""
    rows = not_gateway(df)
    if containers:
        rows = rows.filter(F.col("ContainerName").isin(*containers))
    if project:
        rows = rows.filter(F.col("ComposeProject") == project)
    if level:
        rows = rows.filter(F.col("SeverityText") == level)
    if text:
        rows = rows.filter(text_match("Body", text))
    return rows.select(*TAIL_COLUMNS)


def tail_access(df: DataFrame, status: int | None = None, method: str = "", path: str = "",
                from_ts: str | None = None, to_ts: str | None = None) -> DataFrame:
    """New requests that meet the filters; `path` is a substring in any case."""
    rows = access_logs(df)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if method:
        rows = rows.filter(F.col("method") == method)
    if path:
        rows = rows.filter(text_match("path", path))
    if from_ts:
        rows = rows.filter(F.col("Timestamp") >= F.lit(from_ts).cast("timestamp"))
    if to_ts:
        rows = rows.filter(F.col("Timestamp") <= F.lit(to_ts).cast("timestamp"))
    return rows


def start_tail(rows: DataFrame, deliver: Callable[[DataFrame], None], checkpoint: str, every: str | None = "1 second",
               ts: str = "Timestamp"):
    """Delivers each micro-batch in time order.

    The checkpoint is the cursor: rows that tie or come late are delivered like all others.
    A source limit (files or offsets per trigger) bounds a batch; nothing is cut off.
    Without `every`, what is there is delivered and the query ends.
    """
    writer = (rows.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda batch, _: deliver(batch.orderBy(ts))))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def notification_stream(spark: SparkSession, path: str, containers: Sequence[str] = ()) -> DataFrame:
    """Rows appended to the notification table."""
    rows = spark.readStream.schema(schema.NOTIFICATIONS).parquet(path)
    return rows.filter(F.col("container_name").isin(*containers)) if containers else rows


def ingest_stream(ingress: DataFrame, path: str, checkpoint: str, self_names: Sequence[str] = (),
                  dropped: Sequence[str] = (), every: str | None = None):
    """The batch ingest on arrival, appended to the day-partitioned log table in the layout of `sinks.write_logs`.

    Any number of streams may append to one table. A stream that starts with a new checkpoint is a new one: what it
    reads is added to what is there.
    """
    writer = (ingest_logs(ingress, self_names, dropped).writeStream.outputMode("append")
              .option("checkpointLocation", checkpoint)
              .foreachBatch(lambda batch, number: append_batch(batch, number, path, stream_id(batch.sparkSession, checkpoint))))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The lasting id of the stream that keeps this checkpoint: the same after a restart, another one in a new checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def append_batch(batch: DataFrame, number: int, path: str, stream: str = "batches") -> None:
    """Appends a micro-batch: gathered by day, sorted, in files named after the stream and the batch.

    Files are written aside and then moved. A batch that broke off and is repeated replaces the files it has left before; one that
    was taken over is on record and does nothing, so rows that were purged or rewritten since don't come back. Files
    of other streams are never touched. A stream's batches must come in the order of their numbers.
    """
    spark = batch.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    record, aside = hadoop.Path(f"{path}/_batches/{stream}/{number}.done"), f"{path}/_batches/{stream}/{number}"
    fs = record.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(record):
        return
    write_logs(batch, aside, mode="overwrite")
    for left in fs.globStatus(hadoop.Path(f"{path}/log_date=*/batch-{stream}-{number}-*.parquet")) or []:
        fs.delete(left.getPath(), False)
    for i, file in enumerate(fs.globStatus(hadoop.Path(f"{aside}/log_date=*/*.parquet")) or []):
        day = hadoop.Path(f"{path}/{file.getPath().getParent().getName()}")
        fs.mkdirs(day)
        if not fs.rename(file.getPath(), hadoop.Path(day, f"batch-{stream}-{number}-{i:05d}.parquet")):
            raise IOError(f"cannot move {file.getPath()}")
    fs.create(record, True).close()
    fs.delete(hadoop.Path(aside), True)
    fs.delete(hadoop.Path(f"{path}/_batches/{stream}/{number - 2}.done"), False)  # a stream repeats its last batch only


def rollup_stream(acc: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Keeps the hourly roll-up of a stream of requests: `rollups` reads the table of parts that it leaves.

    Each micro-batch adds its own parts, a row per hour, in a folder named after the stream and the batch. A batch that is
    repeated replaces that folder, so nothing counts twice; late requests are one more part of their hour. Hours are combined
    by many tasks and then gathered by month: a task writes the rows of whole months, whatever the size of the batch.
    """
    def add(batch: DataFrame, number: int) -> None:
        stream = stream_id(batch.sparkSession, checkpoint)
        parts = hourly_parts(batch).repartition(F.trunc("hour", "MONTH"))
        parts.write.mode("overwrite").parquet(f"{path}/stream={stream}/batch={number}")

    writer = acc.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def spam_stream(df: DataFrame, window: str = "1 minute", slide: str | None = "30 seconds",
                watermark: str = "1 minute", rate: float = fixed.SPAM_RATE_PER_SECOND,
                count: int = fixed.SPAM_COUNT, hits: int = fixed.SPAM_FLOOD_HITS, seconds: float = 60.0) -> DataFrame:
    """Spam groups per sliding or tumbling window, emitted when the watermark closes the window."""
    w = F.window("Timestamp", window, slide) if slide else F.window("Timestamp", window)
    flood = F.lower("Body").rlike(fixed.FLOOD_WORDS)
    groups = (with_lateness(not_gateway(df), "Timestamp", watermark)
              .groupBy(w.alias("w"), "ContainerId", spam_group("Body").alias("grp"))
              .agg(F.min("ContainerName").alias("container_name"), F.count(F.lit(1)).alias("cnt"),
                   F.count_if(flood).alias("ddos_hits"))
              .withColumn("req_per_sec", half_even(F.col("cnt") / seconds, 2)))
    return (groups.filter((F.col("req_per_sec") >= rate) | ((F.col("cnt") >= count) & (F.col("ddos_hits") >= hits)))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "ContainerId", "grp",
                    "container_name", "cnt", "req_per_sec", "ddos_hits"))


def flood_stream(acc: DataFrame, per_minute: int = fixed.FLOOD_REQUESTS_PER_MINUTE, watermark: str = "1 minute") -> DataFrame:
    """Clients with too many requests in a minute, emitted when the watermark closes it: `detect.request_floods` on arrival.

    For one alert per pause, `stateful.stream_throttle` takes these rows, by client.
    """
    return (with_lateness(acc, "Timestamp", watermark)
            .groupBy(F.window("Timestamp", "1 minute").alias("w"), "remote_addr")
            .agg(F.count(F.lit(1)).alias("requests"), F.max_by("path", F.struct("Timestamp", "path")).alias("latest_path"))
            .filter(F.col("requests") >= per_minute)
            .select(F.col("w.start").alias("minute"), "remote_addr", "requests", "latest_path"))
