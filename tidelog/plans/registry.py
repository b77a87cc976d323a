"""Registered queries: name -> inventory id, Spark query, and the SQL its result is checked with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidelog.plans import views

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    inventory: str
    run: Run
    oracle: str | None


REGISTRY: dict[str, Registered] = {}

_ACC = """
SELECT Timestamp, remote_addr, method, referer, path,
  CASE WHEN regexp_full_match(status, '[0-9]{1,5}') THEN TRY_CAST(status AS INTEGER) ELSE 0 END AS status,
  CAST(bytes_sent AS BIGINT) AS bytes_sent, CAST(request_time AS DOUBLE) AS request_time
FROM access
"""

_CTES = {
    "logs": views.LOGS_SQL,
    "access": views.ACCESS_SQL.replace("{T0}", views.T0_ORACLE),
    "acc": _ACC,
    "users": views.USERS_SQL,
    "ownership": views.OWNERSHIP_SQL,
    "snap": views.RUNTIME_SQL,
    "notif": views.NOTIFICATIONS_SQL,
}


def given(*names: str, **more: str) -> str:
    """WITH clause of the derived tables, and of further ones."""
    parts = []
    for name in names:
        if name == "acc":
            parts.append(("access", _CTES["access"]))
        parts.append((name, _CTES[name]))
    parts += list(more.items())
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in parts) + "\n"


AS_OF = f"TIMESTAMP '{views.AS_OF}'"
SINCE = f"({AS_OF} - INTERVAL {views.HOURS} HOUR)"


def register(name: str, inventory: str, oracle: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Registered(inventory, run, oracle)
        return run
    return add


def load_all() -> dict[str, Registered]:
    from tidelog.plans import (access_queries, analytics_queries, detect_queries, incident_queries,  # noqa: F401
                               ingest_queries, lifecycle_queries, search_queries, stream_queries)
    return REGISTRY
