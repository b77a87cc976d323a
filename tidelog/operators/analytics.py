"""Log aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.functions import fixed
from tidelog.functions.text import body_error, body_warn, message_pattern, severity_is
from tidelog.functions.values import before, bucket, time_bounded
from tidelog.operators.search import not_gateway


def recent(df: DataFrame, as_of: str | Column, hours: float) -> DataFrame:
    return time_bounded(not_gateway(df), before(as_of, hours, "HOUR"), open_start=True)


def headline(df: DataFrame, as_of: str | Column, hours: float = 24, exact: bool = True) -> DataFrame:
    """Total, errors, warnings (body-aware) and distinct containers.

    The exact distinct count is taken over one pre-aggregated row per container.
    """
    error = severity_is("error") | body_error()
    warn = (severity_is("warn", "warning") | body_warn()) & ~body_error()
    counts = [F.count(F.lit(1)).alias("total"), F.count_if(error).alias("errors"), F.count_if(warn).alias("warnings")]
    rows = recent(df, as_of, hours)
    if not exact:
        return rows.agg(*counts, F.approx_count_distinct("ContainerName").alias("containers"))
    return rows.groupBy("ContainerName").agg(*counts).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("total", "errors", "warnings")],
        F.count("ContainerName").alias("containers"))


def _chosen(rows: DataFrame, containers: Sequence[str], project: str) -> DataFrame:
    if containers:
        rows = rows.filter(F.col("ContainerName").isin(*containers))
    return rows.filter(F.col("ComposeProject") == project) if project else rows


def volume(df: DataFrame, as_of: str | Column, hours: float = 24, tz: str = "UTC",
           containers: Sequence[str] = (), project: str = "") -> DataFrame:
    """Total, errors and warnings per hour, per day from a week on."""
    unit = "DAY" if hours >= 168 else "HOUR"
    return (_chosen(recent(df, as_of, hours), containers, project)
            .groupBy(bucket("Timestamp", unit, tz).alias("t"))
            .agg(F.count(F.lit(1)).alias("total"), F.count_if(severity_is("error")).alias("errors"),
                 F.count_if(severity_is("warn", "warning")).alias("warnings")))


def severity_dist(df: DataFrame, from_ts: str | Column, to_ts: str | Column | None = None,
                  containers: Sequence[str] = (), project: str = "") -> DataFrame:
    """Rows per lower-cased severity: after `from_ts`, or in [from_ts, to_ts)."""
    rows = time_bounded(not_gateway(df), from_ts, to_ts, open_start=to_ts is None, open_end=True)
    level = F.when(F.col("SeverityText") == "", "unknown").otherwise(F.lower("SeverityText"))
    return (_chosen(rows, containers, project).groupBy(level.alias("lvl")).agg(F.count(F.lit(1)).alias("c"))
            .orderBy(F.col("c").desc(), "lvl"))


def histogram(search_rows: DataFrame, tz: str = "UTC") -> DataFrame:
    return search_rows.groupBy(bucket("Timestamp", "HOUR", tz).alias("h")).agg(F.count(F.lit(1)).alias("cnt"))


def patterns(df: DataFrame, as_of: str | Column, minutes: float = 60, container: str = "",
             literal: bool = False, limit: int = 50) -> DataFrame:
    """Most frequent message patterns.

    Severity is a grouping key of the first aggregation, so no text is aggregated over rows.
    """
    counted = _pattern_counts(_pattern_rows(df, as_of, minutes, container, literal))
    return counted.orderBy(F.col("frequency").desc(), "pattern").limit(limit)


def _pattern_rows(df: DataFrame, as_of: str | Column, minutes: float, container: str, literal: bool) -> DataFrame:
    rows = time_bounded(not_gateway(df), before(as_of, minutes, "MINUTE"), open_start=True)
    rows = rows.filter(F.col("SeverityText") != "DEBUG")
    if container:
        rows = rows.filter(F.col("ContainerName") == container)
    return rows.select(message_pattern("Body", literal).alias("pattern"), "SeverityText", "Timestamp")


def _pattern_counts(rows: DataFrame, *also: str) -> DataFrame:
    return (rows.groupBy("pattern", "SeverityText", *also)
            .agg(F.count(F.lit(1)).alias("n"), F.min("Timestamp").alias("a"), F.max("Timestamp").alias("b"))
            .groupBy("pattern", *also)
            .agg(F.sum("n").alias("frequency"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen"),
                 F.min("SeverityText").alias("severity")))


SKETCH_GROUPS = 64  # sketches of the scan's tasks are merged in so many groups, then these
PER_MILLE = 1000


def heavy_patterns(df: DataFrame, as_of: str | Column, minutes: float = 60, container: str = "",
                   literal: bool = False, limit: int = 50, tracked: int = 10_000) -> DataFrame:
    """`patterns` with a state that doesn't grow with the number of patterns, and `certain` beside each.

    A first pass keeps a frequent-items sketch of `tracked` pattern hashes per task. Sketches merge, and their estimate is off by at
    most 3.5 / size of its map, which is at least tracked / 0.75. So every pattern in more than 5.25 / tracked of the rows is
    among the candidates. A second pass counts the candidates' rows exactly, by their text: frequencies are never estimates.
    `certain` tells whether a pattern lies above that share; if all rows listed do, the list is that of `patterns`. Otherwise
    a rarer pattern may be missing: track more, or take `patterns`.
    The candidates, at most `tracked` pairs of numbers, are broadcast.
    """
    if not 0 < limit <= tracked:
        raise ValueError("tracked must be at least limit")
    rows = _pattern_rows(df, as_of, minutes, container, literal)
    hashes = rows.select(F.xxhash64("pattern").alias("item"), F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("part"))
    sketch = (hashes.groupBy("part")
              .agg(F.expr(f"approx_top_k_accumulate(item, {tracked})").alias("s"), F.count(F.lit(1)).alias("n"))
              .groupBy(F.lit(0).alias("all"))  # no rows, no group: there is no sketch of nothing
              .agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"), F.sum("n").alias("_total")))
    candidates = (sketch.select("_total", F.inline(F.expr(f"approx_top_k_estimate(s, {tracked})")))
                  .select("item", "_total"))
    found = rows.join(F.broadcast(candidates), F.xxhash64("pattern") == F.col("item"))
    share = F.col("frequency") * tracked * PER_MILLE > F.col("_total") * int(5.25 * PER_MILLE)
    return (_pattern_counts(found, "_total").withColumn("certain", share).drop("_total")
            .orderBy(F.col("frequency").desc(), "pattern").limit(limit))


def pattern_terms(df: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Adds the literal words of a pattern as search terms."""
    words = F.filter(F.split(F.col(pattern), r"[\s?]+"), lambda t: t.rlike("[a-zA-Z]") & (F.length(t) >= 2))
    return df.withColumn("terms", F.trim(F.array_join(F.slice(words, 1, 4), " ")))


def layer_status(runtime: DataFrame, gateway: DataFrame, checks: DataFrame, unread: DataFrame) -> DataFrame:
    """Status per layer from one-row tables.

    runtime (total, running, unhealthy), gateway (total_requests, error_rate, p95_response_time),
    checks (layer in pipeline/uptime, status per check), unread (unread). An empty table is a missing layer.
    """
    number = lambda c: F.format_string("%d", F.col(c).cast("bigint"))
    # Totals reduce to one row with a row counter, so an absent source still yields its layer.
    one = lambda df, *cols: df.agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in cols])
    gone = F.col("n") == 0
    container = one(runtime, "total", "running", "unhealthy").select(
        F.lit("container").alias("layer"),
        F.when(gone, "missing").when(F.col("unhealthy") > 0, "danger").otherwise("ok").alias("status"),
        F.when(gone, "Runtime missing").otherwise(
            F.concat(number("running"), F.lit("/"), number("total"), F.lit(" running"))).alias("value"))
    rate, p95 = F.col("error_rate"), F.col("p95_response_time")
    gate = one(gateway, "total_requests", "error_rate", "p95_response_time").select(
        F.lit("gateway").alias("layer"),
        F.when(gone, "missing")
        .when((rate >= fixed.ERROR_RATE_DANGER) | (p95 >= fixed.P95_DANGER), "danger")
        .when((rate >= fixed.ERROR_RATE_WARN) | (p95 >= fixed.P95_WARN), "warn").otherwise("ok").alias("status"),
        F.when(gone, "No access").when(F.col("total_requests") > 0, F.concat(number("total_requests"), F.lit(" req")))
        .otherwise("No traffic").alias("value"))

    def checked(layer: str, good: str, bad: str, missing: str) -> DataFrame:
        rows = checks.filter(F.col("layer") == layer).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "ok").alias("failed"))
        return rows.select(F.lit(layer).alias("layer"),
                           F.when(gone, "missing").when(F.col("failed") > 0, "warn").otherwise("ok").alias("status"),
                           F.when(gone, missing).when(F.col("failed") > 0, bad).otherwise(good).alias("value"))

    alerts = unread.agg(F.coalesce(F.max("unread"), F.lit(0)).alias("unread")).select(
        F.lit("alerts").alias("layer"),
        F.when(F.col("unread") > 0, "warn").otherwise("missing").alias("status"),
        F.when(F.col("unread") > 0, F.concat(number("unread"), F.lit(" unread"))).otherwise("Rules pending").alias("value"))
    parts = [gate, checked("pipeline", "Healthy", "Degraded", "Health missing"),
             checked("uptime", "Surfaces up", "Degraded", "Probe missing"), alerts]
    for part in parts:
        container = container.unionByName(part)
    return container
