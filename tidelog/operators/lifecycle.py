"""Retention, purge, archive, restore and backfill of the day-partitioned log table."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidelog.functions import fixed
from tidelog.functions.values import at, attr, before
from tidelog.sources.sinks import write_logs


def expired(days: int, as_of: str | Column) -> Column:
    """Rows whose day has passed the retention; at least one day is kept."""
    return F.date_add(F.col("log_date"), max(1, int(days))) <= F.to_date(at(as_of))


def purge_condition(kind: str, name: str) -> Column:
    column = {"container": "ContainerName", "stack": "ComposeProject"}.get(kind)
    if column is None:
        raise ValueError("kind must be container or stack")
    return F.col(column) == name


def clear_condition(days: int | None, as_of: str | Column) -> Column:
    """Rows older than `days` except the gateway's; every row without days."""
    if days is None:
        return F.lit(True)
    return (F.col("Timestamp") < before(as_of, days, "DAY")) & ~F.col("ServiceName").eqNullSafe(fixed.GATEWAY_SERVICE)


def backfilled(df: DataFrame) -> DataFrame:
    """Compose project from the attributes where the column is empty."""
    current = F.coalesce(F.col("ComposeProject"), F.lit(""))
    return df.withColumn("ComposeProject", F.when(current == "", attr("ResourceAttributes", fixed.PROJECT_ATTR))
                         .otherwise(current))


def day_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("log_date").agg(F.count(F.lit(1)).alias("rows"))


def verify(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min("Timestamp").alias("min_ts"), F.max("Timestamp").alias("max_ts"))


NULL_DAY = "__HIVE_DEFAULT_PARTITION__"


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _folder(day) -> str:
    return f"log_date={NULL_DAY if day is None else day}"


def _files(df: DataFrame) -> dict[str, list[str]]:
    """The data files a table reads now, by partition folder: what is added later is not among them."""
    found: dict[str, list[str]] = {}
    for name in df.inputFiles():
        found.setdefault(name.rsplit("/", 2)[1], []).append(name)
    return found


def _day_of(folder: str):
    text = folder.removeprefix("log_date=")
    return None if text == NULL_DAY else date.fromisoformat(text)


def _drop_files(spark: SparkSession, names: list[str]) -> None:
    """Removes these files, and their folders where nothing else is left in them."""
    for name in names:
        fs, target = _fs(spark, name)
        if fs.exists(target) and not fs.delete(target, False):
            raise IOError(f"cannot remove {target}")
    for folder in {name.rsplit("/", 1)[0] for name in names}:
        fs, target = _fs(spark, folder)
        if fs.exists(target) and not [s for s in fs.listStatus(target) if not s.getPath().getName().startswith(("_", "."))]:
            fs.delete(target, True)


def drop_days(spark: SparkSession, path: str, days) -> int:
    """Removes whole day partitions; None stands for the rows without a time."""
    for day in days:
        fs, target = _fs(spark, f"{path}/{_folder(day)}")
        if fs.exists(target) and not fs.delete(target, True):
            raise IOError(f"cannot remove {target}")
    return len(days)


def _replace(spark: SparkSession, path: str, days, change) -> None:
    """Writes change(rows) of the days' files beside them, and then removes exactly those files.

    The table is listed once: a file that is appended meanwhile is neither read nor removed. Readers between the two
    steps may see rows of a day twice, never too few.
    """
    files = _files(spark.read.parquet(path))
    old = [name for folder, names in files.items() if _day_of(folder) in set(days) for name in names]
    if not old:
        return
    rows = spark.read.schema(spark.read.parquet(path).schema).option("basePath", path).parquet(*old)
    write_logs(change(rows), path)
    _drop_files(spark, old)
    spark.catalog.refreshByPath(path)


def _rewrite(spark: SparkSession, path: str, doomed: Column) -> int:
    """Deletes rows: only days that have some are rewritten. Returns the number of deleted rows."""
    table = spark.read.parquet(path)
    gone = F.coalesce(doomed, F.lit(False))
    counts = {row[0]: row[1] for row in table.filter(gone).groupBy("log_date").count().collect()}
    _replace(spark, path, list(counts), lambda rows: rows.filter(~gone))
    return sum(counts.values())


def apply_retention(spark: SparkSession, path: str, as_of: str, days: int = fixed.RETENTION_DAYS) -> int:
    """Drops day partitions past the retention: folders are listed, no row is read or rewritten.

    Rows without a time have no age and stay, until `clear_older` without days or an archive takes them.
    """
    kept = max(1, int(days))
    now = date.fromisoformat(str(spark.range(1).select(F.to_date(at(as_of)).cast("string")).first()[0]))
    fs, target = _fs(spark, path)
    found = [_day_of(s.getPath().getName()) for s in fs.listStatus(target) if s.getPath().getName().startswith("log_date=")]
    old = sorted(day for day in found if day is not None and day + timedelta(days=kept) <= now)
    drop_days(spark, path, old)
    spark.catalog.refreshByPath(path)
    return len(old)


def purge(spark: SparkSession, path: str, kind: str, name: str) -> int:
    return _rewrite(spark, path, purge_condition(kind, name))


def clear_older(spark: SparkSession, path: str, days: int | None, as_of: str) -> int:
    if days is None:
        table = spark.read.parquet(path)
        rows, files = table.count(), _files(table)
        _drop_files(spark, [name for names in files.values() for name in names])
        spark.catalog.refreshByPath(path)
        return rows
    return _rewrite(spark, path, clear_condition(days, as_of))


def archive_and_clear(spark: SparkSession, path: str, destination: str) -> int:
    """Copies the table, compares the rows per day, and clears the files that were copied.

    Raises where the archive differs; the table then stays as it is. Rows that are appended meanwhile are in files that
    were not copied, and stay.
    """
    table = spark.read.parquet(path)
    files = _files(table)
    table.write.mode("errorifexists").option("compression", "zstd").partitionBy("log_date").parquet(destination)
    copied = spark.read.parquet(destination)
    rows = {r[0]: r[1] for r in day_counts(table).collect()}
    saved = {r[0]: r[1] for r in day_counts(copied).collect()}
    if rows != saved:
        raise RuntimeError("archive is incomplete; nothing was cleared")
    _drop_files(spark, [name for names in files.values() for name in names])
    spark.catalog.refreshByPath(path)
    return sum(rows.values())


def archive_notice(spark: SparkSession, cleared: int | None, as_of: str, error: str = "") -> DataFrame:
    """The outcome of an archive run as a notification row: rows cleared, or what went wrong (cleared None)."""
    done = cleared is not None
    message = f"{cleared} rows archived and cleared." if done else f"Archive failed, table not cleared: {error}"
    return spark.createDataFrame([(
        "backup_success" if done else "backup_fail", "info" if done else "critical",
        "Backup Completed" if done else "Backup Failed", message, "backend", "backend", as_of)],
        "type string, severity string, title string, message string, container_id string, container_name string, created_at string")


def restore(spark: SparkSession, archive: str, path: str) -> DataFrame:
    """Writes the archive back as the table; returns its row count, first and last time.

    The copy is made beside the table and compared per day with the archive; only then do the table's files go.
    """
    saved = spark.read.parquet(archive)
    fs, pattern = _fs(spark, f"{path}/log_date=*/*.parquet")
    old = _files(spark.read.parquet(path)) if fs.globStatus(pattern) else {}
    copy = f"{path}.restoring"
    write_logs(saved, copy, mode="overwrite")
    count = lambda df: {r[0]: r[1] for r in day_counts(df).collect()}
    if count(spark.read.parquet(copy)) != count(saved):
        raise RuntimeError("the restored copy is incomplete; the table was not touched")
    write_logs(spark.read.parquet(copy), path)
    _drop_files(spark, [name for names in old.values() for name in names])
    side, made = _fs(spark, copy)
    side.delete(made, True)
    spark.catalog.refreshByPath(path)
    return verify(spark.read.parquet(path))


def backfill_project(spark: SparkSession, path: str) -> int:
    """Fills the project column; only days with a row to change are rewritten."""
    table = spark.read.parquet(path)
    empty = F.coalesce(F.col("ComposeProject"), F.lit("")) == ""
    changes = empty & (attr("ResourceAttributes", fixed.PROJECT_ATTR) != "")
    days = {r[0]: r[1] for r in table.filter(changes).groupBy("log_date").count().collect()}
    _replace(spark, path, list(days), backfilled)
    return sum(days.values())
