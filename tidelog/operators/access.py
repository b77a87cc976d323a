"""Access-log analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelog.functions import fixed
from tidelog.functions.values import (attr, before, bucket, float_or_zero, half_even, percent, time_bounded,
                                      uint16_or_zero, uint_or_zero)

COLUMNS = ["Timestamp", "remote_addr", "method", "referer", "path", "status", "bytes_sent", "request_time"]


def access_logs(df: DataFrame, attributes: str = "LogAttributes") -> DataFrame:
    """Typed request rows of the gateway's log records."""
    rows = df.filter(F.col("ServiceName") == fixed.GATEWAY_SERVICE)
    keep = ["log_date"] if "log_date" in df.columns else []
    return typed_requests(rows.select(*keep, "Timestamp", *[attr(attributes, c).alias(c) for c in COLUMNS[1:]]))


def typed_requests(df: DataFrame) -> DataFrame:
    """Request fields given as text, with numbers; a bad number is 0."""
    keep = ["log_date"] if "log_date" in df.columns else []
    return df.select(*COLUMNS[:5], uint16_or_zero("status").alias("status"),
                     uint_or_zero("bytes_sent").alias("bytes_sent"),
                     float_or_zero("request_time").alias("request_time"), *keep)


def window_of(acc: DataFrame, as_of: str | Column, hours: float) -> DataFrame:
    return time_bounded(acc, before(as_of, int(hours * 60), "MINUTE"))


def _time_us() -> Column:
    """Request time in whole microseconds: integer sums do not depend on the order of the rows."""
    return F.round(F.col("request_time") * 1_000_000).cast("bigint")


def _mean_seconds(total_us: str, count: str) -> Column:
    return F.coalesce(F.try_divide(F.col(total_us).cast("double"), F.col(count).cast("double")), F.lit(0.0)) / 1_000_000


HISTOGRAM_SUMS = ("n", "n400", "n500", "bytes", "time_us")


def latency_histogram(acc: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per key and distinct request time: map tasks combine a busy key's rows."""
    return (acc.groupBy(*keys, "request_time")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count_if(F.col("status") >= 400).alias("n400"), F.count_if(F.col("status") >= 500).alias("n500"),
                 F.sum(F.col("bytes_sent")).alias("bytes"))
            .withColumn("time_us", _time_us() * F.col("n")))


def _with_p95(acc: DataFrame, keys: Sequence[str], approx: bool) -> DataFrame:
    """Per key: total, errors from 400 and from 500, bytes, summed time and p95 of the request time.

    Exact form: the percentile weighs the histogram's distinct request times (the gateway
    writes milliseconds), so its state grows with their number and not with the rows.
    The approximate form has a fixed-size state for sources with finer times.
    """
    keys = list(keys)
    names = HISTOGRAM_SUMS
    if approx:
        rows = acc.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= 400).alias("n400"),
            F.count_if(F.col("status") >= 500).alias("n500"), F.sum("bytes_sent").alias("bytes"),
            F.sum(_time_us()).alias("time_us"), F.percentile_approx("request_time", 0.95, 10_000).alias("quantile"))
        return rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in names}).withColumn(
            "quantile", F.coalesce("quantile", F.lit(0.0)))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in names]
    quantile = F.coalesce(F.expr("percentile(request_time, 0.95, n)"), F.lit(0.0))
    return latency_histogram(acc, keys).groupBy(*keys).agg(*sums, quantile.alias("quantile"))


def access_overview(acc: DataFrame, as_of: str | Column, hours: float = 24, approx: bool = False) -> DataFrame:
    return _with_p95(window_of(acc, as_of, hours), [], approx).select(*_overview_columns())


def _overview_columns() -> list[Column]:
    return [F.col("n").alias("total_requests"),
            half_even(percent(F.col("n500"), F.col("n")), 2).alias("error_rate"),
            half_even(_mean_seconds("time_us", "n"), 4).alias("avg_response_time"),
            half_even(F.col("quantile"), 4).alias("p95_response_time"),
            F.col("bytes").alias("total_bytes"),
            F.col("n500").alias("errors_5xx_exact")]


def overview_with_worst_paths(acc: DataFrame, as_of: str | Column, hours: float = 24, worst: int = 5) -> DataFrame:
    """The overview, all client errors (`errors_4xx_exact`) and the errors of the first `top_paths` (`path_errors`).

    One scan: the histogram by path gives both the paths and, as its grand total, the overview.
    """
    paths = (latency_histogram(window_of(acc, as_of, hours), ["referer", "path"])
             .groupingSets([["referer", "path"], []], "referer", "path")
             .agg((F.grouping_id() > 0).alias("_total"), *[F.sum(c).alias(c) for c in HISTOGRAM_SUMS],
                  F.expr("percentile(request_time, 0.95, n)").alias("quantile")))
    first = (paths.filter(F.col("_total") | (F.col("path") != ""))
             .orderBy(F.col("_total").desc(), F.col("n400").desc(), half_even(F.col("quantile"), 4).desc(), F.col("n").desc(),
                      "referer", "path").limit(worst + 1))
    total = lambda c, default: F.coalesce(F.max(F.when(F.col("_total"), F.col(c))), F.lit(default)).alias(c)
    return (first.agg(*[total(c, 0) for c in HISTOGRAM_SUMS], total("quantile", 0.0),
                      F.coalesce(F.sum(F.when(~F.col("_total"), F.col("n400"))), F.lit(0)).alias("path_errors"))
            .select(*_overview_columns(), (F.col("n400") - F.col("n500")).alias("errors_4xx_exact"), "path_errors"))


def traffic(acc: DataFrame, as_of: str | Column, hours: float = 6) -> DataFrame:
    return (window_of(acc, as_of, hours).groupBy(bucket("Timestamp", "MINUTE").alias("minute"), "status")
            .agg(F.count(F.lit(1)).alias("count")))


def traffic_classes(traffic_rows: DataFrame) -> DataFrame:
    """Per minute: ok (below 400, also 0), client errors, server errors."""
    status, n = F.col("status"), F.col("count")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("bigint")
    return traffic_rows.groupBy("minute").agg(
        total(status < 400).alias("ok"), total((status >= 400) & (status < 500)).alias("warn"),
        total(status >= 500).alias("err"))


def top_paths(acc: DataFrame, as_of: str | Column, hours: float = 24, limit: int | None = 20,
              approx: bool = False) -> DataFrame:
    """Paths by errors and p95, the worst first; all of them, in no order, without a limit."""
    rows = _with_p95(window_of(acc, as_of, hours).filter(F.col("path") != ""), ["referer", "path"], approx)
    paths = rows.select("referer", "path", F.col("n").alias("total"), F.col("n400").alias("errors"),
                        half_even(_mean_seconds("time_us", "n"), 4).alias("avg_time"),
                        half_even(F.col("quantile"), 4).alias("p95_time"))
    if limit is None:
        return paths
    return paths.orderBy(F.col("errors").desc(), F.col("p95_time").desc(), F.col("total").desc(), "referer", "path").limit(limit)


def top_ips(acc: DataFrame, as_of: str | Column, hours: float = 24, limit: int = 20) -> DataFrame:
    """Busiest clients, with the share of the busiest one and the error percentage."""
    top = (window_of(acc, as_of, hours).groupBy("remote_addr")
           .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") >= 400).alias("errors"),
                F.sum(_time_us()).alias("_us"), F.max("Timestamp").alias("last_seen"))
           .withColumn("avg_time", _mean_seconds("_us", "total")).drop("_us")
           .orderBy(F.col("total").desc(), "remote_addr").limit(limit))
    # The window runs over the limited rows only.
    most = F.max("total").over(Window.partitionBy(F.lit(1)))
    return (top.withColumn("share_pct", F.round(F.col("total") / F.greatest(most, F.lit(1)) * 100).cast("bigint"))
            .withColumn("error_pct", F.round(F.col("errors") / F.greatest("total", F.lit(1)) * 100).cast("bigint")))


def access_hourly(acc: DataFrame, as_of: str | Column, days: int = 7, tz: str = "UTC") -> DataFrame:
    status = F.col("status")
    return (time_bounded(acc, before(as_of, days, "DAY"))
            .groupBy(bucket("Timestamp", "HOUR", tz).alias("hour"))
            .agg(F.count(F.lit(1)).alias("total"), F.count_if(status >= 500).alias("errors"),
                 F.count_if((status >= 400) & (status < 500)).alias("client_err"),
                 F.sum("bytes_sent").cast("bigint").alias("bytes_total"), F.sum(_time_us()).alias("_us"))
            .withColumn("avg_time", _mean_seconds("_us", "total")).drop("_us"))


def local_time_text(tz: str = fixed.DISPLAY_TIMEZONE) -> Column:
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col("Timestamp").cast("timestamp_ntz"))
    return F.date_format(local, "yyyy-MM-dd HH:mm:ss")


def access_search(acc: DataFrame, as_of: str | Column, hours: float = 24, status: int | None = None,
                  min_status: int | None = None, method: str = "", remote_addr: str = "", path: str = "",
                  min_request_time: float | None = None, text: str = "", case_sensitive: bool = True,
                  from_local: str | None = None, to_local: str | None = None,
                  tz: str = fixed.DISPLAY_TIMEZONE) -> DataFrame:
    """Rows that meet all given conditions; `text` is a literal over six fields."""
    rows = window_of(acc, as_of, hours)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    if min_status is not None:
        rows = rows.filter(F.col("status") >= min_status)
    if method:
        rows = rows.filter(F.col("method") == method.upper())
    if remote_addr:
        rows = rows.filter(F.col("remote_addr") == remote_addr)
    if path:
        rows = rows.filter(F.col("path") == path)
    if min_request_time is not None:
        rows = rows.filter(F.col("request_time") >= min_request_time)
    utc = lambda local: F.convert_timezone(F.lit(tz), F.lit("UTC"), F.lit(local).cast("timestamp_ntz"))
    rows = time_bounded(rows, utc(from_local) if from_local else None, utc(to_local) if to_local else None)
    if text:
        fields = ["path", "remote_addr", "method", "referer"]
        texts = [F.col(c) for c in fields] + [F.col("status").cast("string"), local_time_text(tz)]
        fold = (lambda c: c) if case_sensitive else F.lower
        needle = F.lit(text if case_sensitive else text.lower())
        hit = F.lit(False)
        for c in texts:
            hit = hit | F.contains(fold(c), needle)
        rows = rows.filter(hit)
    return rows


def access_page(rows: DataFrame, number: int = 1, size: int = 50, descending: bool = True) -> DataFrame:
    """Page `number` (from 1). Requests have no unique key, so all columns order them."""
    first = F.col("Timestamp").desc() if descending else F.col("Timestamp").asc()
    return (rows.select(*COLUMNS).orderBy(first, *COLUMNS[1:])
            .offset((number - 1) * size).limit(size))


def access_page_count(rows: DataFrame, size: int = 50) -> DataFrame:
    total = F.count(F.lit(1))
    return rows.agg(total.alias("total"), F.ceil(total / size).cast("bigint").alias("pages"))


def access_drill(acc: DataFrame, as_of: str | Column, mode: str, hours: float = 24, minute: str | None = None,
                 status_class: str = "", remote_addr: str = "", path: str = "",
                 tz: str = fixed.DISPLAY_TIMEZONE) -> DataFrame:
    """Rows behind a chart element: a minute (and status class), a client, a path or all errors."""
    if mode == "time":
        low = {"4xx": 400, "5xx": 500}.get(status_class)
        rows = access_search(acc, as_of, hours, min_status=low, from_local=minute, tz=tz)
        end = F.convert_timezone(F.lit(tz), F.lit("UTC"), F.lit(minute).cast("timestamp_ntz"))
        return time_bounded(rows, None, before(end, -60))
    if mode == "ip":
        return access_search(acc, as_of, hours, remote_addr=remote_addr)
    if mode == "path":
        return access_search(acc, as_of, hours, path=path)
    if mode == "errors":
        return access_search(acc, as_of, hours, min_status=400)
    raise ValueError(f"unknown drill mode: {mode}")


def _summary(acc: DataFrame, by: str, sample: str, samples: str, n: int, salts: int = 64) -> DataFrame:
    """Totals per `by` and the first n distinct values of `sample`, from one scan.

    Rows are first combined per pair. The pairs of a busy key are spread over salts; each
    salt keeps its totals and first n values, and the key's result comes from its salts.
    """
    pairs = (acc.groupBy(by, sample)
             .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") >= 400).alias("errors"),
                  F.min("Timestamp").alias("first_seen"), F.max("Timestamp").alias("last_seen"))
             .withColumn("_salt", F.pmod(F.hash(sample), F.lit(salts))))
    rank = F.row_number().over(Window.partitionBy(by, "_salt").orderBy(sample))
    sums = [F.sum("total").alias("total"), F.sum("errors").alias("errors"),
            F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")]
    salted = (pairs.withColumn("_rank", rank).groupBy(by, "_salt")
              .agg(*sums, F.collect_list(F.when(F.col("_rank") <= n, F.col(sample))).alias("_first")))
    first = F.slice(F.array_sort(F.flatten(F.collect_list("_first"))), 1, n)
    return salted.groupBy(by).agg(*sums, first.alias(samples)).select(
        by, "total", "errors", half_even(percent(F.col("errors"), F.col("total")), 1).alias("error_rate"),
        "first_seen", "last_seen", samples)


def ip_summary(acc: DataFrame, as_of: str | Column, hours: float = 24, remote_addr: str | None = None) -> DataFrame:
    """Summary of one client, or of every client where none is named."""
    rows = window_of(acc, as_of, hours)
    if remote_addr is not None:
        rows = rows.filter(F.col("remote_addr") == remote_addr)
    return _summary(rows, "remote_addr", "path", "sample_paths", 3)


def path_summary(acc: DataFrame, as_of: str | Column, hours: float = 24, path: str | None = None) -> DataFrame:
    rows = window_of(acc, as_of, hours)
    if path is not None:
        rows = rows.filter(F.col("path") == path)
    return _summary(rows, "path", "remote_addr", "sample_ips", 3)


def path_classes(paths: DataFrame) -> DataFrame:
    """Top paths with their display class."""
    worst = (F.col("errors") > 0) | (F.col("p95_time") >= fixed.P95_DANGER)
    return paths.withColumn("path_class", F.when(worst, "danger")
                            .when(F.col("p95_time") >= fixed.P95_WARN, "warn").otherwise(""))


def gateway_cards(overview: DataFrame, hours: float = 24) -> DataFrame:
    """Rate, estimated and exact server errors and the threshold classes."""
    level = lambda c, danger, warn: (F.when(F.col(c) >= danger, "danger").when(F.col(c) >= warn, "warn").otherwise(""))
    estimate = F.floor(F.col("total_requests") * F.col("error_rate") / 100 + 0.5).cast("bigint")
    return overview.filter(F.col("total_requests") > 0).select(
        "total_requests", "error_rate", "p95_response_time",
        (F.col("total_requests") / (hours * 60)).alias("requests_per_minute"),
        estimate.alias("errors_5xx"), "errors_5xx_exact",
        level("error_rate", fixed.ERROR_RATE_DANGER, fixed.ERROR_RATE_WARN).alias("error_class"),
        level("p95_response_time", fixed.P95_DANGER, fixed.P95_WARN).alias("p95_class"),
        F.when(estimate > 0, "danger").otherwise("").alias("errors_class"))
