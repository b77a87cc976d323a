"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidelog.session import shared_dir


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BROADCAST_ROWS = 500_000


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. `lower` does just that for a text of ASCII alone, and is faster."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase)))


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table below the cluster's checkpoint folder: computed once, no lineage before it.

    Lost executors cost only what they were writing; every later job reads the same rows.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted_side(df: DataFrame) -> DataFrame:
    """A written table of a few numbers a row as one side of a join: broadcast if its rows, counted, are few, else merged.

    Spark takes the rows of an exploded table to be as many as there were before, and may broadcast the other side.
    """
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def drop_written(df: DataFrame) -> None:
    """Deletes a table of `written` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let_shuffles_go(spark: SparkSession) -> None:
    """Asks the driver to collect garbage: Spark's cleaner deletes the shuffle files of frames that are gone only after that."""
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus. Its rows are texts: where the session leaves that open, fewer of them go to Python at once."""
    if spark.conf.get(BATCH) == "10000":  # the default
        spark.conf.set(BATCH, "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most `rows` rows, taken by a hash of the key columns: the same ones every time.

    The share that is needed is cut out where rows are read, so hardly more than `rows` rows leave the tasks.
    """
    order = F.xxhash64(*key)
    share = min(1.0, (1.2 * rows + 100) / max(1, df.count()))
    return df.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(order, *key).limit(rows)


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that what is built per batch stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def same(left: str, right: str, *columns: str) -> Column:
    """Join condition of two aliased frames: equal in these columns, where null equals null."""
    condition = F.lit(True)
    for name in columns:
        condition &= F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return condition


def numbered(df: DataFrame, group: str, *order: str) -> DataFrame:
    """The rows with `number`: their place in their group, from 0, in ascending order. Written, so numbers are fixed.

    Rows are dealt by range and sorted in place; only the first row and the count of each part and group are looked at
    to tell where a part goes on. So a group of any size is spread over many tasks. Nulls come first.
    """
    given = written(df, "unnumbered")  # dealing by range looks at the rows twice
    laid = written(given.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                   .withColumn("at", F.monotonically_increasing_id()), "numbered")
    drop_written(given)
    laid = laid.withColumn("part", F.shiftright("at", 33))
    parts = laid.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(group, "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("move"))
    return (laid.alias("l").join(starts.alias("s"), same("l", "s", group, "part"))
            .select(*(F.col(f"l.{name}") for name in df.columns), (F.col("l.at") + F.col("s.move")).alias("number")))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of one's own that no column of df has."""
    taken = {name.lower() for name in df.columns}
    prefix = "own_"
    while any((prefix + name).lower() in taken for name in names):
        prefix += "_"
    return [prefix + name for name in names]
