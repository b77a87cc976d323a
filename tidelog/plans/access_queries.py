"""Queries of access-log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import access
from tidelog.plans import views
from tidelog.plans.registry import AS_OF, SINCE, given, register

_US = "CAST(round(request_time * 1000000) AS BIGINT)"
_MEAN = f"CAST(sum({_US}) AS DOUBLE) / count(*) / 1000000"
# In units of the last place, where a tie is exact.
_ROUND_MEAN = f"round_even(CAST(sum({_US}) AS DOUBLE) / count(*) / 100, 0) / 10000"
_P95 = "round_even(quantile_cont(request_time, 0.95), 4)"
_W = f"WHERE Timestamp >= {SINCE}"
_COLS = "Timestamp, remote_addr, method, referer, path, status, bytes_sent, request_time"
_OVERVIEW = f"""
SELECT count(*) AS total_requests, round_even(CAST(count(*) FILTER (WHERE status >= 500) AS DOUBLE) / count(*) * 100, 2) AS error_rate,
  {_ROUND_MEAN} AS avg_response_time, {_P95} AS p95_response_time, CAST(sum(bytes_sent) AS BIGINT) AS total_bytes,
  count(*) FILTER (WHERE status >= 500) AS errors_5xx_exact
FROM acc {_W}"""


@register("access_rows", "AC-1", given("acc") + f"SELECT {_COLS} FROM acc")
def access_rows(spark, sf):
    return access.access_logs(views.access_records(spark, sf))


@register("access_overview", "AC-2", given("acc") + _OVERVIEW)
def access_overview(spark, sf):
    return access.access_overview(views.access(spark, sf), views.AS_OF, views.HOURS)


_TRAFFIC = f"SELECT date_trunc('minute', Timestamp) AS minute, status, count(*) AS count FROM acc {_W} GROUP BY 1, 2"


@register("traffic", "AC-3", given("acc") + _TRAFFIC)
def traffic(spark, sf):
    return access.traffic(views.access(spark, sf), views.AS_OF, views.HOURS)


@register("traffic_classes", "AC-4", given("acc", t=_TRAFFIC) + """
SELECT minute, CAST(coalesce(sum(count) FILTER (WHERE status < 400), 0) AS BIGINT) AS ok,
  CAST(coalesce(sum(count) FILTER (WHERE status BETWEEN 400 AND 499), 0) AS BIGINT) AS warn,
  CAST(coalesce(sum(count) FILTER (WHERE status >= 500), 0) AS BIGINT) AS err FROM t GROUP BY minute""")
def traffic_classes(spark, sf):
    return access.traffic_classes(access.traffic(views.access(spark, sf), views.AS_OF, views.HOURS))


_PATHS = f"""
SELECT referer, path, count(*) AS total, count(*) FILTER (WHERE status >= 400) AS errors,
  {_ROUND_MEAN} AS avg_time, {_P95} AS p95_time
FROM acc {_W} AND path <> '' GROUP BY referer, path
ORDER BY errors DESC, p95_time DESC, total DESC, referer, path"""


@register("top_paths", "AC-5", given("acc") + _PATHS + " LIMIT 20")
def top_paths(spark, sf):
    return access.top_paths(views.access(spark, sf), views.AS_OF, views.HOURS)


@register("path_latency", "AC-5", given("acc") + _PATHS)
def path_latency(spark, sf):
    return access.top_paths(views.access(spark, sf), views.AS_OF, views.HOURS, limit=None)


@register("top_clients", "AC-6", given("acc") + f"""
, t AS (SELECT remote_addr, count(*) AS total, count(*) FILTER (WHERE status >= 400) AS errors, {_MEAN} AS avg_time,
  max(Timestamp) AS last_seen FROM acc {_W} GROUP BY remote_addr ORDER BY total DESC, remote_addr LIMIT 20)
SELECT *, CAST(round(total / greatest(max(total) OVER (), 1) * 100) AS BIGINT) AS share_pct,
  CAST(round(errors / greatest(total, 1) * 100) AS BIGINT) AS error_pct FROM t""")
def top_clients(spark, sf):
    return access.top_ips(views.access(spark, sf), views.AS_OF, views.HOURS)


@register("access_hourly", "AC-7", given("acc") + f"""
SELECT date_trunc('hour', Timestamp) AS hour, count(*) AS total, count(*) FILTER (WHERE status >= 500) AS errors,
  count(*) FILTER (WHERE status BETWEEN 400 AND 499) AS client_err, CAST(sum(bytes_sent) AS BIGINT) AS bytes_total,
  {_MEAN} AS avg_time FROM acc WHERE Timestamp >= {AS_OF} - INTERVAL 30 DAY GROUP BY 1""")
def access_hourly(spark, sf):
    return access.access_hourly(views.access(spark, sf), views.AS_OF, 30)


_FOUND = f"""
SELECT {_COLS} FROM acc {_W} AND status >= 400 AND method = 'GET' AND request_time >= 0.2
  AND Timestamp >= TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 7 HOUR AND Timestamp <= TIMESTAMP '2024-01-30 23:59:59' - INTERVAL 7 HOUR
  AND (contains(path, '/1') OR contains(remote_addr, '/1') OR contains(method, '/1') OR contains(referer, '/1')
    OR contains(CAST(status AS STRING), '/1') OR contains(strftime(Timestamp + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S'), '/1'))"""


def _found(spark, sf):
    return access.access_search(views.access(spark, sf), views.AS_OF, views.HOURS, min_status=400, method="get",
                                min_request_time=0.2, text="/1", from_local="2024-01-02 00:00:00",
                                to_local="2024-01-30 23:59:59")


@register("access_search", "AC-8", given("acc") + _FOUND)
def access_search(spark, sf):
    return _found(spark, sf)


@register("access_search_by_time_text", "AC-8", given("acc") + f"""
SELECT {_COLS} FROM acc {_W} AND contains(lower(concat_ws('|', path, remote_addr, method, referer, status, strftime(Timestamp + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S'))), '2024-01-17 1')""")
def access_search_by_time_text(spark, sf):
    return access.access_search(views.access(spark, sf), views.AS_OF, views.HOURS, text="2024-01-17 1", case_sensitive=False)


@register("access_page", "AC-8", given("acc", f=_FOUND) + f"""
SELECT * FROM f ORDER BY Timestamp DESC, remote_addr, method, referer, path, status, bytes_sent, request_time LIMIT 50 OFFSET 50""")
def access_page(spark, sf):
    return access.access_page(_found(spark, sf), 2, 50)


@register("access_page_count", "AC-8", given("acc", f=_FOUND) + """
SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM f""")
def access_page_count(spark, sf):
    return access.access_page_count(_found(spark, sf), 50)


def _summary_sql(by: str, sample: str, samples: str) -> str:
    return given("acc") + f"""
SELECT {by}, count(*) AS total, count(*) FILTER (WHERE status >= 400) AS errors,
  round_even(CAST(count(*) FILTER (WHERE status >= 400) AS DOUBLE) / count(*) * 100, 1) AS error_rate,
  min(Timestamp) AS first_seen, max(Timestamp) AS last_seen,
  list_slice(list_sort(list(DISTINCT {sample})), 1, 3) AS {samples}
FROM acc {_W} GROUP BY {by}"""


@register("client_summaries", "AC-9", _summary_sql("remote_addr", "path", "sample_paths"))
def client_summaries(spark, sf):
    return access.ip_summary(views.access(spark, sf), views.AS_OF, views.HOURS)


@register("path_summaries", "AC-10", _summary_sql("path", "remote_addr", "sample_ips"))
def path_summaries(spark, sf):
    return access.path_summary(views.access(spark, sf), views.AS_OF, views.HOURS)


@register("gateway_cards", "AC-11", given("acc", o=_OVERVIEW) + f"""
SELECT total_requests, error_rate, p95_response_time, total_requests / ({views.HOURS} * 60.0::DOUBLE) AS requests_per_minute,
  CAST(floor(total_requests * error_rate / 100 + 0.5) AS BIGINT) AS errors_5xx, errors_5xx_exact,
  CASE WHEN error_rate >= 5 THEN 'danger' WHEN error_rate >= 1 THEN 'warn' ELSE '' END AS error_class,
  CASE WHEN p95_response_time >= 1 THEN 'danger' WHEN p95_response_time >= 0.3 THEN 'warn' ELSE '' END AS p95_class,
  CASE WHEN floor(total_requests * error_rate / 100 + 0.5) > 0 THEN 'danger' ELSE '' END AS errors_class FROM o""")
def gateway_cards(spark, sf):
    overview = access.access_overview(views.access(spark, sf), views.AS_OF, views.HOURS)
    return access.gateway_cards(overview, views.HOURS)


@register("path_classes", "AC-11", given("acc", p=_PATHS) + """
SELECT referer, path, CASE WHEN errors > 0 OR p95_time >= 1 THEN 'danger' WHEN p95_time >= 0.3 THEN 'warn' ELSE '' END AS path_class FROM p""")
def path_classes(spark, sf):
    paths = access.top_paths(views.access(spark, sf), views.AS_OF, views.HOURS, limit=None)
    return access.path_classes(paths).select("referer", "path", "path_class")


@register("drill_minute", "AC-12", given("acc") + f"""
SELECT {_COLS} FROM acc {_W} AND status >= 400 AND Timestamp >= TIMESTAMP '2024-01-01 09:12:00' AND Timestamp <= TIMESTAMP '2024-01-01 09:13:00'""")
def drill_minute(spark, sf):
    return access.access_drill(views.access(spark, sf), views.AS_OF, "time", views.HOURS, "2024-01-01 16:12:00", "4xx")


@register("drill_client", "AC-12", given("acc") + f"SELECT {_COLS} FROM acc {_W} AND remote_addr = '10.1.0.7'")
def drill_client(spark, sf):
    return access.access_drill(views.access(spark, sf), views.AS_OF, "ip", views.HOURS, remote_addr="10.1.0.7")


@register("drill_path", "AC-12", given("acc") + f"SELECT {_COLS} FROM acc {_W} AND path = '/part/7'")
def drill_path(spark, sf):
    return access.access_drill(views.access(spark, sf), views.AS_OF, "path", views.HOURS, path="/part/7")


@register("drill_errors", "AC-12", given("acc") + f"SELECT {_COLS} FROM acc {_W} AND status >= 400")
def drill_errors(spark, sf):
    return access.access_drill(views.access(spark, sf), views.AS_OF, "errors", views.HOURS)
