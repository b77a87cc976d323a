"""Cases that a judge reproduced: bad records, appends during deletes, timeless rows, scopes, cuts, ties."""

import json

import pytest
from pyspark.sql import functions as F

from tidelog.functions import fixed
from tidelog.operators import cooldown, detect, incident, lifecycle, scope, search, services
from tidelog.sources import readers, sinks
from tidelog.plans import views
from tidelog.streaming import tails


def test_bad_wire_records_do_not_end_the_ingest(spark):
    def record(**fields):
        return json.dumps({"resourceLogs": [{"resource": {"attributes": [
            {"key": "a", "value": {"stringValue": "1"}}, {"key": "a", "value": {"stringValue": "2"}}, {"value": {"stringValue": "x"}},
            {"key": "l", "value": {"arrayValue": {"values": [{"intValue": "5"}]}}}]},
            "scopeLogs": [{"logRecords": [{"body": {"stringValue": "t"}, **fields}]}]}]})

    rows = [(record(timeUnixNano="1700000000000000000"),), (record(timeUnixNano=""),), (record(timeUnixNano="soon"),),
            (record(timeUnixNano="", observedTimeUnixNano="1700000001000000000"),), ("{broken",), (None,)]
    payloads = spark.createDataFrame(rows, "value string").withColumn("got", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    found = readers.flatten_otlp(payloads, received="got").collect()
    assert len(found) == 4 and all(r.Timestamp is not None for r in found)
    assert sorted(r.ts_nanos for r in found) == sorted([1700000000000000000, 1704067200000000000, 1704067200000000000, 1700000001000000000])
    assert found[0].ResourceAttributes["a"] == "2"
    assert "intValue" in found[0].ResourceAttributes["l"]


def test_lines_without_a_time_have_that_of_their_file(spark, tmp_path):
    (tmp_path / "a.log").write_text('no json\n{"log": "x", "time": "2024-01-01T00:00:00Z"}\n')
    assert readers.read_container_logs(spark, str(tmp_path)).filter("Timestamp is null").count() == 0


@pytest.fixture
def log_table(spark, sf_dir, tmp_path):
    path = str(tmp_path / "logs")
    rows = views.stored_logs(spark, sf_dir)
    timeless = rows.limit(3).withColumn("Timestamp", F.lit(None).cast("timestamp")).withColumn("log_date", F.lit(None).cast("date"))
    sinks.write_logs(rows.unionByName(timeless.select(rows.columns)), path)
    return path, rows


def ids(spark, path):
    return sorted(r.LogId for r in spark.read.parquet(path).select("LogId").collect())


def test_clear_and_archive_take_rows_without_a_time(spark, log_table, tmp_path):
    path, rows = log_table
    before = ids(spark, path)
    assert lifecycle.archive_and_clear(spark, path, str(tmp_path / "saved")) == len(before)
    assert ids(spark, str(tmp_path / "saved")) == before
    assert not any((tmp_path / "logs").glob("log_date=*/*.parquet"))
    restored = lifecycle.restore(spark, str(tmp_path / "saved"), path).first()
    assert restored["rows"] == len(before) and ids(spark, path) == before
    assert lifecycle.clear_older(spark, path, None, "2024-01-31 00:00:00") == len(before)


@pytest.mark.parametrize("step", ["archive", "purge", "clear"])
def test_rows_appended_meanwhile_stay(spark, log_table, tmp_path, monkeypatch, step):
    path, rows = log_table
    late = rows.limit(5).withColumn("LogId", F.col("LogId") + 1_000_000_000)
    drop = lifecycle._drop_files

    def append_first(*args):
        monkeypatch.setattr(lifecycle, "_drop_files", drop)
        sinks.write_logs(late, path)
        return drop(*args)

    monkeypatch.setattr(lifecycle, "_drop_files", append_first)
    before = ids(spark, path)
    new = sorted(r.LogId for r in late.select("LogId").collect())
    kept = spark.read.parquet(path)
    if step == "archive":
        lifecycle.archive_and_clear(spark, path, str(tmp_path / "saved"))
        assert ids(spark, path) == new and ids(spark, str(tmp_path / "saved")) == before
    elif step == "purge":
        left = sorted(r.LogId for r in kept.where("ContainerName <> 'svc-1' OR ContainerName IS NULL").select("LogId").collect())
        assert lifecycle.purge(spark, path, "container", "svc-1") == len(before) - len(left)
        assert ids(spark, path) == sorted(left + new)
    else:
        lifecycle.clear_older(spark, path, None, "2024-01-31 00:00:00")
        assert ids(spark, path) == new


def test_notices_without_times_are_written_once(spark, tmp_path):
    events = spark.createDataFrame([("a", "info", "t", "m", "c", "c", None)], "type string, severity string, title string, message string, container_id string, container_name string, created_at timestamp")
    for _ in range(2):
        sinks.write_notifications(events, str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).count() == 1


def test_archive_outcome_is_a_notice(spark):
    rows = [sinks.notification_rows(lifecycle.archive_notice(spark, n, "2024-01-31 00:00:00", "disk")).first() for n in (5, None)]
    assert [r.type for r in rows] == ["backup_success", "backup_fail"] and "not cleared" in rows[1].message


@pytest.mark.parametrize("sql", [
    "SELECT count(*) FROM parquet.`{table}`", "WITH a AS (SELECT 1) INSERT INTO logs SELECT 2", "CREATE TABLE x AS SELECT * FROM logs",
    "SELECT reflect('java.lang.System', 'currentTimeMillis')", "SELECT * FROM others", "SELECT * FROM logs WHERE LogId IN (SELECT LogId FROM others)",
    "SELECT (SELECT max(LogId) FROM parquet.`{table}`)", "DROP VIEW logs", "SELECT * FROM range(9)", "SHOW TABLES", "SET a = 1",
    "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'getProperty', 'user.home') FROM logs", "SELECT IDENTIFIER('java_method')('java.lang.System', 'exit', 3) FROM logs",
    "SELECT 1 FROM logs WHERE IDENTIFIER('try_' || 'reflect')('java.lang.System', 'getProperty', 'user.home') = 'x'",
    "SELECT (SELECT max(IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home')) FROM logs)", "SELECT IDENTIFIER('LogId') FROM logs",
    "WITH c AS (SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home') AS x FROM logs) SELECT x FROM c", "SELECT * FROM IDENTIFIER('oth' || 'ers')",
    "SELECT `reflect`('java.lang.System', 'currentTimeMillis')", "SELECT system.builtin.reflect('java.lang.System', 'currentTimeMillis')",
    "SELECT input_file_name() FROM logs", "SELECT current_user FROM logs", "SELECT session_user() FROM logs", "SELECT current_database()", "SELECT up(LogId) FROM logs",
    "WITH b AS (SELECT * FROM others) SELECT * FROM b", "SELECT * FROM default.logs", "INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT 1"])
def test_statements_that_leave_the_scope_are_refused(spark, sf_dir, sql):
    spark.range(3).selectExpr("id AS LogId").createOrReplaceTempView("others")
    spark.udf.register("up", lambda x: str(x))
    with pytest.raises(ValueError):
        search.query(spark, sql.replace("{table}", f"{sf_dir}/events.parquet"), spark.range(1).selectExpr("id AS LogId"))


@pytest.mark.parametrize("sql", [
    "SELECT LogId + 1 AS a, -LogId AS b, LogId % 2 = 0 AND NOT LogId IN (1, 2) AS c, upper('x') || 'y' AS d FROM logs WHERE LogId BETWEEN 0 AND 5",
    "SELECT CASE WHEN LogId > 1 THEN 'a' ELSE 'b' END AS k, count(*) FILTER (WHERE LogId > 0) AS n FROM logs GROUP BY ALL HAVING count(*) > 0 ORDER BY 1 LIMIT 3",
    "SELECT row_number() OVER (PARTITION BY LogId % 2 ORDER BY LogId DESC NULLS LAST) AS n, sum(LogId) OVER (ORDER BY LogId ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM logs",
    "SELECT l.LogId FROM logs l JOIN logs m ON l.LogId = m.LogId WHERE EXISTS (SELECT 1 FROM logs o WHERE o.LogId = l.LogId) UNION ALL SELECT max(LogId) FROM logs",
    "SELECT x FROM logs LATERAL VIEW explode(array(LogId, 1)) t AS x WHERE CAST(LogId AS STRING) LIKE '%1%' OR CAST(LogId AS STRING) RLIKE '[0-9]'",
    "SELECT transform(array(LogId), x -> x + 1)[0] AS a, struct(LogId).LogId AS b, date_trunc('hour', TIMESTAMP '2024-01-01 10:20:00') - INTERVAL 1 HOUR AS c FROM logs",
    "WITH a AS (SELECT LogId, LogId::string AS s FROM logs) SELECT * EXCEPT (s), any_value(s) OVER w AS t FROM a WINDOW w AS (PARTITION BY LogId)",
    "SELECT LogId % 2 AS k, LogId % 3 AS j, count(*) AS n FROM logs GROUP BY CUBE (LogId % 2, LogId % 3)", "SELECT 1 AS one, current_timestamp() AS now"])
def test_queries_of_many_kinds_are_allowed(spark, sql):
    rows = spark.range(6).selectExpr("id AS LogId")
    rows.createOrReplaceTempView("logs")
    expected = spark.sql(sql).drop("now").collect()
    spark.catalog.dropTempView("logs")
    assert sorted(map(str, search.query(spark, sql, rows).drop("now").collect())) == sorted(map(str, expected))


def test_two_callers_in_one_session(spark):
    few, many = (spark.range(n).selectExpr("id AS LogId", "id % 2 AS k") for n in (2, 5))
    sql = "WITH a AS (SELECT k, count(*) AS n FROM logs GROUP BY k HAVING count(*) > 0) SELECT sum(n) AS n FROM a WHERE k IN (SELECT k FROM logs)"
    first, second = search.query(spark, sql, few), search.query(spark, sql, many)
    assert (first.first().n, second.first().n) == (2, 5)
    assert not spark.catalog.tableExists("logs")


def test_rollups_see_all_services(spark):
    rows = spark.range(600).selectExpr(
        "id AS LogId", "timestamp_micros(1706600000000000 - id * 1000000) AS Timestamp", "concat('c', id) AS ContainerId", "concat('c', id) AS ContainerName",
        "'h' AS HostName", "'p' AS ComposeProject", "concat('s', id) AS ComposeService", "'s' AS ServiceName", "if(id = 599, 'ERROR', 'INFO') AS SeverityText")
    every = services.service_summary(rows, "2024-01-31 00:00:00", 720, limit=None)
    total = services.overview(every).first()
    assert (total.services, total.logs, total.errors) == (600, 600, 1)
    assert services.top_services(every).first().compose_service == "s599"


def test_other_services_notices_displace_none(spark):
    feed = spark.range(101).selectExpr("cast(id AS string) AS id", "'a' AS type", "'critical' AS severity", "'t' AS title", "'m' AS message", "'x' AS container_id",
                                       "if(id = 0, 'stack-1-app-1', 'other') AS container_name", "timestamp_micros(1706659200000000 - 60000000 + id * 1000) AS created_at")
    assert incident._service_notifications(feed, "host-1/stack-1/app-1", "2024-01-31 00:00:00", 60).count() == 1


def test_one_of_several_events_at_a_time_passes(spark):
    df = spark.createDataFrame([("k", 0, 1), ("k", 0, 2), ("k", 0, 1), ("k", 0, 1)], "k string, us long, i int").withColumn("ts", F.timestamp_micros("us"))
    assert [r.i for r in cooldown.throttle(df, ["k"], "ts", 60, order=["i"]).collect()] == [1]
    with pytest.raises(ValueError):
        cooldown.throttle(df, ["k"], "ts", 60, order=[])


def test_critical_alerts_need_no_unique_id(spark):
    rows = [(1, 0, "error: rate limit exceeded"), (1, 90, "error: deadlock detected")]
    df = spark.createDataFrame(rows, "LogId long, s long, Body string").selectExpr(
        "LogId", "timestamp_seconds(s) AS Timestamp", "Body", "'s' AS ServiceName", "'ERROR' AS SeverityText", "'c' AS ContainerId", "'c' AS ContainerName")
    assert detect.critical_alerts(df).count() == 2


def test_flagged_group_without_a_container_has_a_sample(spark):
    df = spark.range(400).selectExpr("id AS LogId", "timestamp_micros(1704067200000000 + id * 1000) AS Timestamp", "cast(null AS string) AS ContainerId",
                                     "cast(null AS string) AS ContainerName", "cast(null AS string) AS ServiceName", "'flood of requests' AS Body", "'' AS SeverityText")
    groups = detect.spam_groups(df, rate=1.0)
    assert groups.count() == 1
    assert detect.spam_samples(df, groups).first().sample_msg == "flood of requests"


def test_long_names_meet_services_quickly(spark):
    import time

    names = spark.range(2000).selectExpr("concat(repeat('x', 200), '-stack-1-', id, if(id = 7, '-app-1', '')) AS name")
    wanted = spark.createDataFrame([("h/stack-1/app-1", "Stack-1", "App-1"), ("h//web", "", "web")], "service_key string, compose_project string, compose_service string")
    started = time.time()
    found = scope.match_containers(wanted, names.union(spark.createDataFrame([("WEB",), (None,), ("",)], "name string"))).collect()
    assert sorted((r.service_key, r.container_name[-6:]) for r in found) == [("h//web", "WEB"), ("h/stack-1/app-1", "-app-1")]
    assert time.time() - started < 30


@pytest.mark.parametrize("cap", [1, 3, 7, 2000])
def test_context_of_many_anchors_equals_one_by_one(spark, cap):
    rows = spark.range(400).selectExpr("id AS LogId", "timestamp_micros(1704067200000000 + id * id * 700 + (id % 3)) AS Timestamp", "concat('c', id % 2) AS ContainerName", "'b' AS Body")
    anchors = rows.where("LogId % 37 = 0").selectExpr("ContainerName", "Timestamp AS anchor_ts")
    got = {(r.ContainerName, r.anchor_ts, r.LogId) for r in search.context_bulk(rows, anchors, 2, cap).collect()}
    want = set()
    for a in anchors.collect():
        near = [r for r in rows.collect() if r.ContainerName == a.ContainerName and abs((r.Timestamp - a.anchor_ts).total_seconds()) <= 2]
        want |= {(a.ContainerName, a.anchor_ts, r.LogId) for r in sorted(near, key=lambda r: (r.Timestamp, r.LogId))[:cap]}
    assert got == want


MINUTE = 60


@pytest.mark.parametrize("logs, states, expected", [
    ([0, 120], [(5, 1), (20, 0)], [("container_down", 20), ]),  # stops at minute 20; logs at 120 while not running: still down
    ([0, 120], [(5, 1), (20, 0), (119, 1)], [("container_down", 20), ("container_recovered", 120)]),
    ([0, 120], [(2, 0)], [("container_down", 5)]),  # logs resume, but it does not run
    ([0, 120, 121, 122], [(2, 0), (121, 1)], [("container_down", 5), ("container_recovered", 121)]),
    ([0, 120], [(2, 0), (8, 1)], [("container_down", 5), ("container_recovered", 10)]),  # second look
    ([0, 120], [(2, 0), (8, 1), (30, 0), (34, 1)], [("container_down", 5), ("container_recovered", 10), ("container_down", 30), ("container_recovered", 35)]),
    ([0, 120], [], []), ([0, 3], [(1, 0)], [("container_down", 8)]),
    ([0], [(1, 0)], [("container_down", 5)])])
def test_states_inside_a_silence(spark, logs, states, expected):
    rows = spark.createDataFrame([("c", m * MINUTE) for m in logs], "ContainerId string, s long").selectExpr(
        "ContainerId", "timestamp_seconds(1704067200 + s) AS Timestamp", "'s' AS ServiceName")
    snaps = spark.createDataFrame([("c", m * MINUTE, "running" if up else "exited") for m, up in states], "ContainerId string, s long, state string").selectExpr(
        "ContainerId", "timestamp_seconds(1704067200 + s) AS snapshot_ts", "state")
    last = "2024-01-01 02:05:00" if len(logs) > 1 else "2024-01-01 00:30:00"
    found = detect.state_transitions(rows, snaps, 300, last, second_look=300).collect()
    assert [(r.type, r["at"].hour * 60 + r["at"].minute) for r in sorted(found, key=lambda r: r["at"])] == expected


def test_rows_without_a_service_are_exported_assigned_and_cleared(spark):
    rows = spark.createDataFrame([(None, "2024-01-01 00:00:00"), (fixed.GATEWAY_SERVICE, "2024-01-01 00:00:00"), ("app", "2024-01-01 00:00:00")], "ServiceName string, t string").selectExpr(
        "ServiceName", "to_timestamp(t) AS Timestamp", "'c' AS ContainerId", "concat('n-', coalesce(ServiceName, 'none')) AS ContainerName",
        "'hub.example/ann/app:1' AS ContainerImage", "'INFO' AS SeverityText", "'h' AS HostName", "'b' AS Body")
    assert {r.ContainerName for r in sinks.export_rows(rows).collect()} == {"n-none", "n-app"}
    users = spark.createDataFrame([(7, "ann")], "id bigint, username string")
    owned = spark.createDataFrame([], "container_id string, user_id bigint")
    assert {r.container_id for r in scope.auto_assign(rows, users, owned, ["hub.example"]).collect()} == {"n-none", "n-app"}
    assert {r.ContainerName for r in rows.filter(lifecycle.clear_condition(7, "2024-01-31 00:00:00")).collect()} == {"n-none", "n-app"}


def test_a_repeated_batch_leaves_its_rows_once(spark, sf_dir, tmp_path):
    rows = views.stored_logs(spark, sf_dir).limit(200)
    path = str(tmp_path / "t")
    tails.append_batch(rows, 0, path)
    tails.append_batch(rows.limit(50), 1, path)
    tails.append_batch(rows.limit(50), 1, path)
    assert spark.read.parquet(path).count() == 250
    assert all(f.name.startswith("batch-") for f in (tmp_path / "t").glob("log_date=*/*.parquet"))


def test_a_batch_that_broke_off_is_replaced_and_a_finished_one_does_not_come_back(spark, sf_dir, tmp_path):
    rows = views.stored_logs(spark, sf_dir).limit(60)
    path = tmp_path / "t"
    tails.append_batch(rows, 4, str(path), "s")
    (path / "_batches" / "s" / "4.done").rename(tmp_path / "record")  # as if the last step had not been reached
    tails.append_batch(rows, 4, str(path), "s")
    assert spark.read.parquet(str(path)).count() == 60
    for file in path.glob("log_date=*/*.parquet"):
        file.rename(tmp_path / file.name)  # purged since
    tails.append_batch(rows, 4, str(path), "s")
    assert not list(path.glob("log_date=*/*.parquet"))


def test_streams_into_one_table_keep_each_others_rows(spark, sf_dir, tmp_path):
    rows, path = views.stored_logs(spark, sf_dir).limit(40), str(tmp_path / "t")
    source = str(tmp_path / "in")
    views.ingress(spark, sf_dir).limit(30).write.parquet(source)
    ingress = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    for name in ("a", "b"):  # another stream, or the same one from a new checkpoint
        tails.ingest_stream(ingress, path, str(tmp_path / name)).awaitTermination(120)
        tails.ingest_stream(ingress, path, str(tmp_path / name)).awaitTermination(120)  # a restart has nothing to add
    once = tails.ingest_logs(spark.read.parquet(source)).count()
    assert once > 0 and spark.read.parquet(path).count() == 2 * once
