"""Hourly roll-ups of the access log that are kept up to date: dashboards read hours, not requests.

A part has exact counts beside mergeable sketches. Parts of any batches add up to the same counts; sketches are merged, so
quantiles and distinct numbers of any window come from a few binary values per hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.functions.values import before, bucket
from tidelog.operators.access import HISTOGRAM_SUMS, _overview_columns, _time_us

QUANTILE_K = 800  # rank error of about half a percent
CLIENTS_LG_K = 14  # relative error of about 0.8 % (one standard deviation)


def hourly_parts(acc: DataFrame) -> DataFrame:
    """One row per hour of these requests; hour is null for requests without a time. No rows give no parts."""
    status = F.col("status")
    return acc.groupBy(bucket("Timestamp", "HOUR").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(status >= 400).alias("n400"), F.count_if(status >= 500).alias("n500"),
        F.sum("bytes_sent").alias("bytes"), F.sum(_time_us()).alias("time_us"),
        F.kll_sketch_agg_double("request_time", QUANTILE_K).alias("time_sketch"),
        F.hll_sketch_agg("remote_addr", CLIENTS_LG_K).alias("client_sketch"))


def merged(parts: DataFrame, *by: str) -> DataFrame:
    """Parts as one row per `by`: counts are added, sketches merged. Merging what is merged gives the same counts."""
    return parts.groupBy(*by).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in HISTOGRAM_SUMS],
        F.kll_merge_agg_double("time_sketch", QUANTILE_K).alias("time_sketch"), F.hll_union_agg("client_sketch").alias("client_sketch"))


def _quantile(rank: float) -> Column:
    known = F.kll_sketch_get_n_double("time_sketch") > 0
    return F.when(known, F.kll_sketch_get_quantile_double("time_sketch", F.lit(rank))).otherwise(0.0)


def hours_of(parts: DataFrame) -> DataFrame:
    """Requests, error counts, bytes, p95 and distinct clients per hour."""
    return merged(parts, "hour").select(
        "hour", F.col("n").alias("total"), F.col("n400").alias("errors"), F.col("n500").alias("errors_5xx"), F.col("bytes").alias("total_bytes"),
        _quantile(0.95).alias("p95_time"), F.hll_sketch_estimate("client_sketch").alias("clients"))


def overview_of(parts: DataFrame, as_of: str | Column, hours: float = 24) -> DataFrame:
    """`access.access_overview` and the distinct clients, out of parts, from the hour in which the window begins.

    p95 and clients are estimates within the sketches' bounds, all else is exact. An empty window is a row of zeros.
    """
    start = F.date_trunc("HOUR", before(as_of, int(hours * 60), "MINUTE"))
    rows = merged(parts.filter(F.col("hour") >= start)).withColumn("quantile", _quantile(0.95))
    return rows.select(*_overview_columns(), F.hll_sketch_estimate("client_sketch").alias("clients"))
