"""Incident evidence: correlation, timeline and bundle of one service and time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.functions import fixed
from tidelog.functions.text import clean_text
from tidelog.functions.values import at, before, contains_ci, half_even, micros, time_bounded
from tidelog.operators.access import overview_with_worst_paths
from tidelog.operators.runtime import is_signal
from tidelog.operators.scope import service_scope, split_service_key
from tidelog.operators.search import around, not_gateway
from tidelog.session import cut_lineage

EVENT = ["timestamp", "source", "severity", "title", "detail", "action", "level", "badge"]


def window_minutes(hours: float) -> int:
    return max(3, min(1440, int(hours * 60)))


def _one_row(*parts: DataFrame) -> DataFrame:
    """One row out of one-row tables with different columns."""
    names = [c for p in parts for c in p.columns]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in names])


def app_errors(df: DataFrame, as_of: str | Column, minutes: float) -> DataFrame:
    error = F.col("SeverityText").isin("ERROR", "FATAL") | contains_ci("Body", "error")
    rows = time_bounded(not_gateway(df), before(as_of, minutes, "MINUTE"))
    return rows.agg(F.count_if(error).alias("app_errors"),
                    F.max(F.when(error, F.col("Timestamp"))).alias("latest_error_ts"))


def correlate(overview: DataFrame, path_errors: DataFrame, app: DataFrame, exact: bool = False) -> DataFrame:
    """One row of figures from overview, the top paths' `errors` and app errors.

    Server errors are estimated from the rounded rate and client errors from the top paths,
    unless `exact`, where the counts `errors_5xx_exact` and `errors_4xx_exact` are given.
    """
    paths = path_errors.agg(F.coalesce(F.sum("errors"), F.lit(0)).cast("bigint").alias("path_errors"))
    return _figures(_one_row(overview, paths, app), exact)


def _figures(row: DataFrame, exact: bool) -> DataFrame:
    if exact:
        e5, e4 = F.col("errors_5xx_exact"), F.col("errors_4xx_exact")
    else:
        e5 = half_even(F.col("total_requests") * F.col("error_rate") / 100, 0).cast("bigint")
        e4 = F.greatest(F.lit(0).cast("bigint"), F.col("path_errors") - F.col("errors_5xx"))
    p95 = F.col("p95_response_time")
    row = (row.withColumn("errors_5xx", e5).withColumn("errors_4xx", e4)
           .withColumn("app_errors", F.coalesce("app_errors", F.lit(0)).cast("bigint")))
    danger = (F.col("errors_5xx") > 0) | (p95 >= fixed.P95_DANGER)
    warn = (F.col("errors_4xx") > 0) | (p95 >= fixed.P95_WARN) | (F.col("app_errors") > 0)
    return (row.withColumn("status", F.when(danger, "danger").when(warn, "warn").otherwise("quiet"))
            .select("status", "total_requests", "errors_4xx", "errors_5xx", "p95_response_time",
                    "app_errors", "latest_error_ts"))


def gateway_correlation(df: DataFrame, acc: DataFrame, as_of: str | Column, hours: float = 1,
                        exact: bool = False) -> DataFrame:
    """Gateway symptoms and app errors of one window, and the status they add up to. Each log is scanned once."""
    overview = overview_with_worst_paths(acc, as_of, hours, 5)
    return _figures(_one_row(overview, app_errors(df, as_of, window_minutes(hours))), exact)


def correlation_signals(correlation: DataFrame) -> DataFrame:
    """The correlation's signals, in order of display."""
    p95 = F.col("p95_response_time")
    p95_text = F.concat(F.format_string("%.3f", p95), F.lit("s p95 latency"))
    count = lambda c, text: F.concat(F.col(c).cast("string"), F.lit(text))
    signal = lambda rank, name, severity, label, detail, action: F.struct(
        F.lit(rank).alias("rank"), F.lit(name).alias("id"), F.lit(severity).alias("severity"),
        F.lit(label).alias("label"), detail.alias("detail"), F.lit(action).alias("action"))
    candidates = F.array_compact(F.array(
        F.when(F.col("errors_5xx") > 0, signal(1, "gateway_5xx", "danger", "Gateway 5xx",
                                               count("errors_5xx", " server errors in window"), "network-errors")),
        F.when(F.col("errors_4xx") > 0, signal(2, "gateway_4xx", "warn", "Gateway 4xx",
                                               count("errors_4xx", " client errors in window"), "network-4xx")),
        F.when(p95 >= fixed.P95_DANGER, signal(3, "gateway_slow", "danger", "Slow gateway path", p95_text, "network-paths"))
        .when(p95 >= fixed.P95_WARN, signal(3, "gateway_slow", "warn", "Gateway latency", p95_text, "network-paths")),
        F.when(F.col("app_errors") > 0, signal(4, "app_errors", "warn", "App logs in same window",
                                               count("app_errors", " app error logs nearby"), "app-errors"))))
    return correlation.select("latest_error_ts", F.inline(candidates))


def _error_text() -> Column:
    return contains_ci("Body", "error") | contains_ci("Body", "exception") | contains_ci("Body", "timeout")


def _service_rows(df: DataFrame, key: str, as_of: str | Column, minutes: float) -> DataFrame:
    return time_bounded(service_scope(df, key), before(as_of, minutes, "MINUTE"))


def incident_summary(df: DataFrame, key: str, as_of: str | Column, minutes: float) -> DataFrame:
    """Totals of a service; names come from one pre-aggregated row per container."""
    return (_service_rows(df, key, as_of, minutes).groupBy("ContainerName")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count_if(F.col("SeverityText").isin("ERROR", "FATAL") | _error_text()).alias("e"),
                 F.count_if(F.col("SeverityText").isin("WARN", "WARNING")).alias("w"),
                 F.max("Timestamp").alias("seen"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_logs"),
                 F.coalesce(F.sum("e"), F.lit(0)).cast("bigint").alias("error_logs"),
                 F.coalesce(F.sum("w"), F.lit(0)).cast("bigint").alias("warning_logs"),
                 F.max("seen").alias("latest_log_ts"),
                 F.max_by("ContainerName", F.struct("seen", "ContainerName")).alias("sample_container_name")))


def incident_events(df: DataFrame, key: str, as_of: str | Column, minutes: float, n: int = 12) -> DataFrame:
    """Newest error and warning rows of a service."""
    severity = F.upper(F.when(F.col("SeverityText") == "", "info").otherwise(F.col("SeverityText")))
    danger = severity.isin("ERROR", "FATAL") | contains_ci("Body", "error") | contains_ci("Body", "exception")
    rows = _service_rows(df, key, as_of, minutes).filter(
        F.col("SeverityText").isin("ERROR", "FATAL", "WARN", "WARNING") | _error_text())
    return (rows.orderBy(F.col("Timestamp").desc(), F.col("LogId").desc()).limit(n)
            .select("Timestamp", "LogId", "ContainerName", severity.alias("SeverityText"),
                    F.when(danger, "danger").otherwise("warn").alias("severity"),
                    F.substring("Body", 1, 220).alias("detail")))


def of_service(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows whose container matches the one service: a filter, where `match_containers` joins many."""
    _, project, service = split_service_key(key)
    both = contains_ci(name, project) & contains_ci(name, service)
    return rows.filter(both | (F.lower(name) == service.lower()))


def _stamp(c: Column) -> Column:
    """Event time; text that is no time sorts as the epoch."""
    return F.coalesce(F.try_to_timestamp(c.cast("string")), F.lit("1970-01-01 00:00:00").cast("timestamp"))


def _first(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def incident_timeline(df: DataFrame, acc: DataFrame, runtime: DataFrame, feed: DataFrame, key: str,
                      as_of: str | Column, hours: float = 1, correlation: DataFrame | None = None) -> DataFrame:
    """Gateway, log, runtime and notification evidence of a service in one shape, newest first.

    `correlation` is the row of `gateway_correlation`, where it is known already.
    """
    if correlation is None:
        correlation = gateway_correlation(df, acc, as_of, hours)
    minutes = window_minutes(hours)
    now = at(as_of).cast("timestamp")
    service = F.lit(split_service_key(key)[2])
    shape = lambda rows, **c: rows.select(*[c.get(n, F.lit("")).alias(n) for n in EVENT])

    signals = _first(correlation_signals(correlation), 3, F.col("rank"))
    gateway = shape(signals, timestamp=F.coalesce(F.col("latest_error_ts").cast("timestamp"), now),
                    source=F.lit("gateway"), severity=F.col("severity"), title=clean_text("label"),
                    detail=clean_text("detail"), action=F.col("action"), badge=F.lit("gateway"))
    events = _first(incident_events(df, key, as_of, minutes), 8, F.col("Timestamp").desc(), F.col("LogId").desc())
    name = F.coalesce(F.nullif("ContainerName", F.lit("")), service)
    logs = shape(events, timestamp=F.col("Timestamp").cast("timestamp"), source=F.lit("application_log"),
                 severity=F.col("severity"), title=clean_text(F.concat_ws(" in ", F.col("SeverityText"), name)),
                 detail=clean_text("detail"), action=F.lit("logs"),
                 level=F.when(F.col("severity") == "danger", "ERROR").otherwise(""), badge=name)
    bad = _first(of_service(runtime, key, "name").filter(is_signal()), 6, F.col("name"), F.col("id"))
    worse = F.col("oom_killed") | (F.col("health") == "unhealthy") | (F.col("state") != "running")
    states = shape(bad, timestamp=_stamp(F.coalesce("finished_at", "started_at", now.cast("string"))),
                   source=F.lit("runtime"), severity=F.when(worse, "danger").otherwise("warn"),
                   title=clean_text("name"), detail=clean_text("diagnostic"), action=F.lit("runtime"),
                   badge=F.lit("runtime"))
    recent = _service_notifications(feed, key, as_of, minutes)
    notes = shape(_first(recent, 6, F.col("created_at").desc(), F.col("id").desc()),
                  timestamp=F.col("created_at").cast("timestamp"), source=F.lit("notification"),
                  severity=F.when(F.col("severity") == "critical", "danger").otherwise("warn"),
                  title=clean_text("title"), detail=clean_text("message"), action=F.lit("alerts"), badge=F.col("type"))
    return (gateway.unionByName(logs).unionByName(states).unionByName(notes)
            .withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
            .orderBy(F.col("timestamp").desc(), "source", "title", "detail").limit(18))


def _service_notifications(feed: DataFrame, key: str, as_of: str | Column, minutes: float) -> DataFrame:
    """All recent notices of the service: other services' notices never displace them."""
    named = feed.withColumn("_name", F.coalesce(F.nullif("container_name", F.lit("")), "container_id"))
    recent = named.filter(micros("created_at") >= micros(before(as_of, minutes, "MINUTE")))
    return of_service(recent, key, "_name")


def incident_status(df: DataFrame, acc: DataFrame, runtime: DataFrame, feed: DataFrame, key: str,
                    as_of: str | Column, hours: float = 1, correlation: DataFrame | None = None) -> DataFrame:
    """Summary counts of an incident and its status: danger, warn or quiet."""
    if correlation is None:
        correlation = gateway_correlation(df, acc, as_of, hours)
    minutes = window_minutes(hours)
    logs = incident_summary(df, key, as_of, minutes).select("total_logs", "error_logs", "warning_logs")
    states = of_service(runtime, key, "name").agg(F.count_if(is_signal()).alias("runtime_signals"))
    notes = _service_notifications(feed, key, as_of, minutes).agg(
        F.count(F.lit(1)).alias("notifications"), F.count_if(F.col("severity") == "critical").alias("critical"))
    gateway = correlation.select(
        F.col("errors_5xx").alias("gateway_5xx"), F.col("p95_response_time").alias("gateway_p95"))
    row = _one_row(logs, states, notes, gateway)
    return _status(row).drop("critical")


def _status(row: DataFrame) -> DataFrame:
    some = lambda *columns: F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in columns]) > 0
    return row.withColumn("status", F.when(some("error_logs", "runtime_signals", "gateway_5xx", "critical"), "danger")
                          .when(some("warning_logs", "notifications"), "warn").otherwise("quiet"))


def evidence_bundle(df: DataFrame, acc: DataFrame, runtime: DataFrame, feed: DataFrame, key: str,
                    as_of: str | Column, hours: float = 1) -> DataFrame:
    """Scope, summary and the timeline's at most 18 events as one JSON document.

    The correlation, one row, is computed once and handed to both.
    """
    correlation = cut_lineage(gateway_correlation(df, acc, as_of, hours))
    host, project, service = split_service_key(key)
    scope = F.struct(F.lit(key).alias("service_key"), F.lit(host).alias("host_id"),
                     F.lit(project).alias("compose_project"), F.lit(service).alias("compose_service"),
                     F.lit(float(hours)).alias("hours"), F.lit(window_minutes(hours)).alias("window_minutes"))
    summary = incident_status(df, acc, runtime, feed, key, as_of, hours, correlation)
    packed = summary.select(F.struct(*[c for c in summary.columns if c != "status"]).alias("summary"), "status")
    events = incident_timeline(df, acc, runtime, feed, key, as_of, hours, correlation)
    timeline = events.agg(F.sort_array(F.collect_list(F.struct(*EVENT)), asc=False).alias("timeline"))
    row = packed.unionByName(timeline, allowMissingColumns=True).agg(
        F.max("status").alias("status"), F.max("summary").alias("summary"), F.max("timeline").alias("timeline"))
    return row.select("status", F.to_json(F.struct(
        F.date_format(at(as_of), "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"), scope.alias("scope"),
        "summary", "timeline")).alias("bundle"))


def drill_window(events: DataFrame, df: DataFrame, minutes: float = 5) -> DataFrame:
    """Log rows within `minutes` of each event (event_id, ContainerName, anchor_ts)."""
    return around(df, events, int(minutes * 60))
