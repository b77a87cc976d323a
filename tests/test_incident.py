"""The correlation's one pass against the two reports it stands for."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import access, incident
from tidelog.plans import views


@pytest.mark.parametrize("as_of, hours", [(views.AS_OF, 24), ("2024-01-10 05:00:00", 2), ("2030-01-01 00:00:00", 1)])
def test_one_pass_equals_overview_and_top_paths(as_of, hours, spark, sf_dir):
    acc = views.access(spark, sf_dir)
    acc = acc.withColumn("path", F.when(F.col("bytes_sent") % 5 > 0, F.col("path")).when(F.col("bytes_sent") % 2 == 0, ""))
    row = access.overview_with_worst_paths(acc, as_of, hours, 5).first().asDict()
    paths = row.pop("path_errors")
    clients = row.pop("errors_4xx_exact")
    assert row == access.access_overview(acc, as_of, hours).first().asDict()
    assert paths == sum(r["errors"] for r in access.top_paths(acc, as_of, hours, 5).collect())
    assert clients == access.window_of(acc, as_of, hours).filter("status >= 400 AND status < 500").count()


def test_an_empty_window_is_quiet(spark, sf_dir):
    row = incident.gateway_correlation(views.logs(spark, sf_dir), views.access(spark, sf_dir), "2030-01-01 00:00:00", 1).first()
    assert (row["status"], row["total_requests"], row["errors_4xx"], row["errors_5xx"], row["app_errors"]) == ("quiet", 0, 0, 0, 0)
