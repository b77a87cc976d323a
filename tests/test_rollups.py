"""Kept roll-ups against the requests themselves."""

from pyspark.sql import functions as F

from tidelog.operators import access, rollups
from tidelog.plans import views
from tidelog.streaming import tails

EXACT = ["total_requests", "error_rate", "avg_response_time", "total_bytes", "errors_5xx_exact"]


def test_parts_of_any_batches_merge_to_the_same_counts(spark, sf_dir):
    acc = views.access(spark, sf_dir)
    whole = rollups.hourly_parts(acc)
    split = rollups.hourly_parts(acc.filter("bytes_sent % 3 = 0")).unionByName(rollups.hourly_parts(acc.filter("bytes_sent % 3 > 0")))
    exact = lambda parts: sorted(map(tuple, rollups.hours_of(parts).drop("p95_time", "clients").collect()))
    assert exact(whole) == exact(split) == exact(rollups.merged(split, "hour"))
    plain = access.access_overview(acc, views.AS_OF, 48).first()
    found = rollups.overview_of(split, views.AS_OF, 48).first()
    assert [found[c] for c in EXACT] == [plain[c] for c in EXACT]
    assert abs(found["p95_response_time"] - plain["p95_response_time"]) <= 0.05
    assert found["clients"] == access.window_of(acc, views.AS_OF, 48).select("remote_addr").distinct().count()


def test_an_empty_window_is_a_row_of_zeros(spark, sf_dir):
    parts = rollups.hourly_parts(views.access(spark, sf_dir))
    row = rollups.overview_of(parts, "2030-01-01 00:00:00", 1).first()
    assert (row["total_requests"], row["p95_response_time"], row["total_bytes"], row["clients"]) == (0, 0.0, 0, 0)
    assert rollups.hours_of(rollups.hourly_parts(views.access(spark, sf_dir).limit(0))).count() == 0


def test_requests_without_time_or_duration_are_counted(spark, sf_dir):
    acc = views.access(spark, sf_dir).limit(20).withColumn("Timestamp", F.lit(None).cast("timestamp_ntz")).withColumn("request_time", F.lit(None).cast("double"))
    row = rollups.hours_of(rollups.hourly_parts(acc)).first()
    assert (row["hour"], row["total"], row["p95_time"]) == (None, 20, 0.0)


def test_a_restart_and_late_requests_add_to_their_hour_once(spark, sf_dir, tmp_path):
    acc = views.access(spark, sf_dir)
    source, parts = str(tmp_path / "access"), str(tmp_path / "parts")

    def run():
        rows = spark.readStream.schema(acc.schema).parquet(source)
        tails.rollup_stream(rows, parts, str(tmp_path / "checkpoint")).awaitTermination()

    acc.filter("bytes_sent % 2 = 0").write.parquet(source)
    run()
    run()
    acc.filter("bytes_sent % 2 = 1").write.mode("append").parquet(source)
    acc.filter("bytes_sent % 2 = 0").limit(7).write.mode("append").parquet(source)
    run()
    extra = acc.filter("bytes_sent % 2 = 0").limit(7)
    kept = {r["hour"]: r["total"] for r in rollups.hours_of(spark.read.parquet(parts)).collect()}
    plain = {r["hour"]: r["total"] for r in rollups.hours_of(rollups.hourly_parts(acc.union(extra))).collect()}
    assert sum(kept.values()) == sum(plain.values()) == acc.count() + 7


def test_a_table_of_many_parts_is_streamed_in_its_parts_and_kept_by_month(spark, tmp_path, monkeypatch):
    """No task takes a fixed share of all requests, neither where they are stored nor where a batch's hours are written."""
    from tidelog.plans import stream_queries

    given = views.access(spark, "/root/testdata/sf0.001").limit(900)
    months = given.withColumn("Timestamp", F.add_months("Timestamp", F.pmod("bytes_sent", F.lit(5)).cast("int")).cast("timestamp_ntz"))
    monkeypatch.setattr(stream_queries, "shared_dir", lambda spark, purpose: str(tmp_path / purpose))
    monkeypatch.setattr(views, "access", lambda spark, sf: months.repartition(9))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ones would be one file again
    try:
        parts = stream_queries._kept_parts(spark, "")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spark.read.parquet(str(tmp_path / "rollup" / "access")).inputFiles()) == 9
    batches = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "rollup" / "parts").glob("stream=*/batch=*"))
    assert batches == [0, 1, 2]
    assert len(parts.inputFiles()) > len(batches)
    exact = lambda df: sorted(map(tuple, rollups.hours_of(df).drop("p95_time", "clients").collect()))
    assert exact(parts) == exact(rollups.hourly_parts(months))
