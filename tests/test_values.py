"""Missing values, numbers and time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelog.functions.values import (attr, before, bucket, float_or_zero, half_even, percent, time_bounded,
                                      uint16_or_zero, uint_or_zero)


@pytest.mark.parametrize("text, expected", [
    ("200", 200), (" 200 ", 0), ("+5", 0), ("-1", 0), ("", 0), (None, 0), ("65535", 65535), ("65536", 0),
    ("99999", 0), ("000404", 404), ("12.5", 0), ("abc", 0)])
def test_uint16(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(uint16_or_zero("t")).first()[0] == expected


@pytest.mark.parametrize("text, expected", [
    ("9223372036854775807", 9223372036854775807), ("9223372036854775808", 0), ("1e3", 0), (None, 0), ("7", 7)])
def test_uint(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(uint_or_zero("t")).first()[0] == expected


@pytest.mark.parametrize("text, expected", [("0.25", 0.25), (".5", 0.5), ("1e-3", 0.001), ("x", 0.0), ("", 0.0), (None, 0.0)])
def test_float(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(float_or_zero("t")).first()[0] == expected


def test_missing_attribute_is_empty(spark):
    df = spark.createDataFrame([({"a": "1"},), (None,)], "m map<string,string>")
    assert [tuple(r) for r in df.select(attr("m", "a"), attr("m", "b")).collect()] == [("1", ""), ("", "")]


def test_rounding_and_percent(spark):
    row = spark.range(1).select(half_even(F.lit(0.125), 2), half_even(F.lit(0.375), 2), percent(F.lit(1), F.lit(0))).first()
    assert tuple(row) == (0.12, 0.38, 0.0)


def test_buckets_at_midnight_elsewhere(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 16, 59, 59),), (dt.datetime(2024, 1, 1, 17, 0, 0),)], "t timestamp_ntz")
    days = [r[0] for r in df.select(bucket("t", "DAY", "Asia/Bangkok")).collect()]
    assert days == [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)]


def test_time_bound_prunes_day_partitions(spark, tmp_path):
    rows = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(id) AS Timestamp FROM range(10)")
    rows.withColumn("log_date", F.to_date("Timestamp")).write.partitionBy("log_date").parquet(str(tmp_path / "t"))
    found = time_bounded(spark.read.parquet(str(tmp_path / "t")), before("2024-01-06 00:00:00", 2, "DAY"), "2024-01-05 12:00:00")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "log_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "Timestamp" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert found.count() == 2
