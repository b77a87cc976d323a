"""Access log lines to typed request rows and to log records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.functions import fixed

# client, user, time, request, status, size, referer, agent
COMBINED = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "([^"]*)" ([0-9]+) ([0-9]+|-) "([^"]*)" "([^"]*)"'
# client, user, time, request, status, size
SHORT = r'([0-9.]+) - (\S+) \[([^\]]+)\] "([^"]+)" ([0-9]+) ([0-9]+)'
JSON_FIELDS = ["remote_addr", "client", "user", "time", "request", "uri", "method", "path", "status", "size",
               "referer", "http_referer", "agent", "user_agent", "request_time"]
PARSED = ["remote_addr", "user", "time", "request", "status", "size", "http_referer", "user_agent",
          "method", "path", "request_time"]
_MARK = "\u0001"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


def _groups(line: Column, pattern: str, count: int) -> Column:
    """All groups of a pattern from one match; another number of items where it does not match."""
    whole = "(?s)^.*?" + pattern + ".*$" if not pattern.startswith("^") else "(?s)" + pattern + ".*$"
    return F.split(F.regexp_replace(line, whole, _MARK.join(f"${i}" for i in range(1, count + 1))), _MARK)


def _record(**fields: Column) -> Column:
    return F.struct(*[fields.get(name, F.lit(None)).cast("string").alias(name) for name in PARSED])


def parse_access(lines: DataFrame, message: str = "message") -> DataFrame:
    """JSON, combined format or the short form, in this order; other lines are dropped.

    Each form is matched once per line, and only where the forms before it failed.
    """
    line = F.col(message)
    schema = ", ".join(f"{name} STRING" for name in [*JSON_FIELDS, "_broken"])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}

    def from_json(j: Column) -> Column:
        first = lambda *names: F.coalesce(*[F.nullif(j[n], F.lit("")) for n in names])
        return F.when(j["_broken"].isNull(), _record(
            remote_addr=first("client", "remote_addr"), user=j["user"], time=j["time"],
            request=first("request", "uri"), status=j["status"], size=j["size"],
            http_referer=first("referer", "http_referer"), user_agent=first("agent", "user_agent"),
            method=j["method"], path=j["path"], request_time=j["request_time"])).otherwise(plain())

    def plain() -> Column:
        # The combined form always has the two quotes between referer and agent.
        return F.when(F.contains(line, F.lit('" "')), _let(_groups(line, COMBINED, 8), from_combined)).otherwise(
            _let(_groups(line, SHORT, 6), from_short))

    def from_combined(g: Column) -> Column:
        given = lambda i: F.nullif(g[i], F.lit("-"))
        return F.when(F.size(g) == 8, _record(
            remote_addr=given(0), user=given(1), time=given(2), request=given(3), status=given(4), size=given(5),
            http_referer=given(6), user_agent=given(7))).otherwise(_let(_groups(line, SHORT, 6), from_short))

    def from_short(g: Column) -> Column:
        return F.when(F.size(g) == 6, _record(
            remote_addr=g[0], user=g[1], time=g[2], request=g[3], status=g[4], size=g[5]))

    # Only an object counts as JSON: bare numbers or text are lines for the other forms.
    parsed = F.when(F.startswith(F.ltrim(line), F.lit("{")), _let(F.from_json(line, schema, options), from_json)
                    ).otherwise(plain())
    rest = [c for c in lines.columns if c != message]
    return lines.select(*rest, F.inline(F.filter(F.array(parsed), lambda r: r.isNotNull())))


def normalize_access(df: DataFrame, now: Column | None = None, host: str = "") -> DataFrame:
    """Method and path from the request, time parsed, numbers defaulted, query string cut."""
    now = F.current_timestamp() if now is None else now
    request = F.coalesce(F.col("request"), F.lit(""))
    parts = F.split(request, " ")
    method = F.when(request != "", F.coalesce(F.nullif(F.try_element_at(parts, F.lit(1)), F.lit("")), F.lit("GET")))
    path = F.when(request != "", F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("/")))
    full_path = F.coalesce(path, F.col("path"), F.lit(""))
    stamp = F.try_to_timestamp("time", F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    return df.withColumns({
        "timestamp": F.coalesce(stamp, now.cast("timestamp")),
        "method": F.coalesce(method, F.col("method")),
        "path": F.substring_index(full_path, "?", 1),
        "status": F.coalesce(F.col("status").try_cast("int"), F.lit(0)),
        "bytes_sent": F.coalesce(F.col("size").try_cast("bigint"), F.lit(0)),
        "request_time": F.coalesce(F.col("request_time").try_cast("double"), F.lit(0.0)),
        "source_host": F.lit(host),
    }).drop("request", "time", "size")


def drop_probe_paths(df: DataFrame, paths: Sequence[str] = tuple(fixed.PROBE_PATHS)) -> DataFrame:
    return df.filter(~F.coalesce(F.col("path"), F.lit("")).isin(*paths))


def access_to_log(df: DataFrame, keep_latency: bool = True) -> DataFrame:
    """Request rows to log records of the gateway service.

    `keep_latency=False` writes the request time as 0, which empties all latency figures.
    """
    text = lambda c, d="": F.coalesce(F.col(c).cast("string"), F.lit(d))
    method, path, status = text("method", "GET"), text("path", "/"), text("status", "0")
    latency = text("request_time", "0") if keep_latency else F.lit("0")
    resource = [(fixed.SERVICE_NAME, F.lit(fixed.GATEWAY_SERVICE)), (fixed.ENVIRONMENT, F.lit("production")),
                ("log.type", F.lit("nginx_access")), (fixed.HOST_NAME, text("source_host"))]
    log = [("method", method), ("path", path), ("status", status), ("bytes_sent", text("bytes_sent", "0")),
           ("user_agent", text("user_agent")), ("remote_addr", text("remote_addr")),
           ("referer", text("http_referer", "-")), ("request_time", latency)]
    as_map = lambda pairs: F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])
    return df.select(
        F.col("timestamp").alias("Timestamp"),
        F.lit(fixed.GATEWAY_SERVICE).alias("ServiceName"),
        F.lit("").alias("SeverityText"), F.lit(0).alias("SeverityNumber"),
        F.concat_ws(" ", method, path, status).alias("Body"),
        F.lit("").alias("TraceId"), F.lit("").alias("SpanId"),
        as_map(resource).alias("ResourceAttributes"), as_map(log).alias("LogAttributes"))
