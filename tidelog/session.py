"""Session settings the operators are written for."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    STATE_STORE: ROCKSDB,
}


def local_session(cpus: int | str = 8, app: str = "tidelog", **extra: str) -> SparkSession:
    """A single-JVM session for tests and the bench; a cluster brings its own."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.driver.memory", "8g")
               .config("spark.driver.host", "127.0.0.1")
               .config("spark.driver.bindAddress", "127.0.0.1")
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(cpus)))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's `spark.checkpoint.dir`.

    A session of one process (tests, one machine) may lack that setting and gets a temporary folder. On a cluster
    that folder would be another one on each machine, so the setting is required there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        return tempfile.mkdtemp(prefix=f"tidelog-{purpose}-")
    token = spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()
    return f"{root.rstrip('/')}/tidelog-{purpose}-{token}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's checkpoint folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoint"))
    return df.checkpoint()


def with_state_store(df: DataFrame) -> DataFrame:
    """Keyed state needs the RocksDB store: sets it for queries started later in the session."""
    if df.sparkSession.conf.get(STATE_STORE, "") != ROCKSDB:
        df.sparkSession.conf.set(STATE_STORE, ROCKSDB)
    return df
