"""Container runtime snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidelog.functions.values import or_default


def runtime_rows(snapshots: DataFrame) -> DataFrame:
    """Snapshot entries (raw list fields) with name, state and health."""
    name = F.coalesce(F.ltrim(F.get("names", F.lit(0)), F.lit("/")), F.substring("id", 1, 12))
    state = or_default("raw_state", "unknown")
    status = or_default("raw_status", F.col("state"))
    lowered = F.lower(F.col("status"))
    return (snapshots
            .withColumns({"name": name, "short_id": F.substring("id", 1, 12),
                          "image": or_default("image", "unknown"), "state": state})
            .withColumn("status", status)
            .withColumn("health", F.when(F.contains(lowered, F.lit("(healthy)")), "healthy")
                        .when(F.contains(lowered, F.lit("(unhealthy)")), "unhealthy")
                        .otherwise(F.col("state")))
            .drop("names", "raw_state", "raw_status"))


def runtime_summary(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "running").alias("running"),
        F.count_if(F.col("health") == "healthy").alias("healthy"),
        F.count_if(F.col("health") == "unhealthy").alias("unhealthy"))


def runtime_diagnose(rows: DataFrame) -> DataFrame:
    """One diagnostic per container by priority, and the state to display."""
    stopped = F.col("state") != "running"
    diagnostic = (F.when(~F.col("inspected"), "runtime snapshot only")
                  .when(F.col("oom_killed"), "OOM killed")
                  .when(F.col("restart_count") > 0,
                        F.concat(F.lit("restarted "), F.col("restart_count").cast("string"), F.lit(" times")))
                  .when(stopped, F.concat(F.lit("exited with code "), F.coalesce(F.col("exit_code").cast("string"), F.lit("None"))))
                  .when(F.col("health") == "unhealthy", "health check failing")
                  .otherwise("no restart or OOM signal"))
    display = (F.when(F.col("oom_killed"), "oom").when(stopped, "stopped")
               .when(F.col("restart_count") > 0, "restarted")
               .when(F.col("health") == "unhealthy", "unhealthy").otherwise("running"))
    return rows.withColumns({"diagnostic": diagnostic, "display_state": display})


def is_signal():
    return (F.col("oom_killed") | (F.col("restart_count") > 0) | (F.col("state") != "running")
            | (F.col("health") == "unhealthy"))


def runtime_counts(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("restart_count") > 0).alias("restarted"), F.count_if("oom_killed").alias("oom_killed"),
        F.count_if(F.col("state") != "running").alias("exited"),
        F.count_if(F.col("health") == "unhealthy").alias("unhealthy"))


def runtime_signals(rows: DataFrame, n: int = 12) -> DataFrame:
    """Containers that need a look, by name."""
    return rows.filter(is_signal()).orderBy("name", "id").limit(n)
