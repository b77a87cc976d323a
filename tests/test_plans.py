"""What the physical plans must look like."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tidelog.operators import access, analytics, detect, scope, services
from tidelog.plans import views
from tidelog.plans.registry import load_all

# Queries whose building already runs jobs (written tables, streams, checkpoints) are left out.
EAGER = {"LC-", "ST-", "SNK-1", "DET-8", "SRC-3"}
LAZY = sorted(name for name, q in load_all().items()
              if not any(q.inventory.startswith(e) for e in EAGER) and name not in ("critical_alerts", "request_floods"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairing_of_everything_with_everything(name, spark, sf_dir):
    plan = plan_of(contract.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_scan_reads_only_needed_columns(spark, sf_dir):
    plan = plan_of(services.service_summary(views.logs(spark, sf_dir), views.AS_OF, views.HOURS))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


@pytest.mark.parametrize("make", [
    lambda logs, acc: services.service_summary(logs, views.AS_OF, views.HOURS),
    lambda logs, acc: analytics.patterns(logs, views.AS_OF, views.HOURS * 60),
    lambda logs, acc: detect._spam_counts(logs, "1 minute", None),
    lambda logs, acc: access.top_paths(acc, views.AS_OF, views.HOURS),
    lambda logs, acc: access.ip_summary(acc, views.AS_OF, views.HOURS),
])
def test_rows_are_aggregated_by_hash_before_the_first_shuffle(make, spark, sf_dir):
    plan = plan_of(make(views.logs(spark, sf_dir), views.access(spark, sf_dir)))
    # The plan prints top down: the last aggregate is the one next to the scan.
    steps = [line for line in plan.splitlines() if "Aggregate" in line or "Exchange" in line or "Scan" in line]
    scan = max(i for i, line in enumerate(steps) if "Scan" in line)
    assert "HashAggregate" in steps[scan - 1] and "partial_" in steps[scan - 1]


def test_first_rows_are_limited_before_the_shuffle(spark, sf_dir):
    plan = plan_of(scope.first_rows(views.logs(spark, sf_dir), ["ContainerName"], [F.col("LogId")], 5))
    assert "WindowGroupLimit" in plan


def test_client_summary_scans_once(spark, sf_dir):
    plan = plan_of(access.ip_summary(views.access(spark, sf_dir), views.AS_OF, views.HOURS))
    assert plan.count("FileScan") == 1


@pytest.mark.parametrize("exact", [False, True])
def test_correlation_scans_each_log_once(exact, spark, sf_dir):
    from tidelog.operators import incident
    plan = plan_of(incident.gateway_correlation(views.logs(spark, sf_dir), views.access(spark, sf_dir), views.AS_OF, 24, exact))
    assert plan.count("FileScan") == 2


def test_top_k_is_not_a_full_sort(spark, sf_dir):
    plan = plan_of(access.top_paths(views.access(spark, sf_dir), views.AS_OF, views.HOURS))
    assert "TakeOrderedAndProject" in plan


def test_context_moves_rows_of_the_anchors_slots_only(spark, sf_dir):
    from tidelog.operators import search
    logs = views.logs(spark, sf_dir)
    anchors = logs.orderBy("LogId").limit(3).select("ContainerName", F.col("Timestamp").alias("anchor_ts"))
    plan = plan_of(search.context_bulk(logs, anchors, 30))
    # Bottom up, every scan of the log meets the broadcast slots before it is dealt or sorted.
    lines = [line for line in plan.splitlines() if any(word in line for word in ("Exchange hashpartitioning", "Sort [", "BroadcastHashJoin", "FileScan"))]
    scans = [i for i, line in enumerate(lines) if "FileScan" in line]
    assert scans and all("BroadcastHashJoin" in lines[i - 1] and "LeftSemi" in lines[i - 1] for i in scans)


def test_a_side_of_few_but_large_rows_is_not_broadcast(spark, monkeypatch):
    from tidelog.operators import bounded
    rows = spark.range(20).selectExpr("id", "repeat('x', 1000) AS body")
    assert bounded.small_side(rows)._jdf.queryExecution().analyzed().toString().startswith("ResolvedHint")
    monkeypatch.setattr(bounded, "MAX_BROADCAST_BYTES", 10_000)
    assert not bounded.small_side(rows)._jdf.queryExecution().analyzed().toString().startswith("ResolvedHint")
