"""Row scope, ownership and display names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelog.functions import fixed
from tidelog.functions.values import attr, before, or_default, time_bounded

# Joins with the ownership table carry no broadcast hint: the planner broadcasts it while
# its measured size allows that, and uses a skew-aware shuffle join beyond.


def owned_containers(ownership: DataFrame, user_id: int) -> DataFrame:
    return ownership.filter(F.col("user_id") == user_id).select(F.col("container_id").alias("ContainerName")).distinct()


def scoped(df: DataFrame, ownership: DataFrame, user_id: int, role: str) -> DataFrame:
    """Developers see rows of containers they own, other roles all rows.

    The scope is applied to the rows before any user condition, so no OR gets around it.
    """
    if role != "developer":
        return df
    return df.join(owned_containers(ownership, user_id), "ContainerName", "left_semi")


def scope_request(df: DataFrame, ownership: DataFrame, user_id: int, role: str,
                  names: Sequence[str] = ()) -> DataFrame:
    """Rows of the requested containers within the scope; no request means all of it."""
    rows = scoped(df, ownership, user_id, role)
    return rows.filter(F.col("ContainerName").isin(*names)) if names else rows


def auto_assign(df: DataFrame, users: DataFrame, ownership: DataFrame, registries: Sequence[str],
                as_of: str | Column | None = None, hours: float = 1) -> DataFrame:
    """New ownership rows from image names `registry/user/...` of the given registries.

    With `as_of`, from the containers seen in the last `hours`.
    """
    if as_of is not None:
        df = time_bounded(df, before(as_of, hours, "HOUR"), open_start=True)
    image = F.col("ContainerImage")
    known = F.lit(False)
    for registry in registries:
        known = known | F.startswith(image, F.lit(registry.rstrip("/") + "/"))
    parts = F.split(image, "/")
    images = (df.filter(~F.col("ServiceName").eqNullSafe(fixed.GATEWAY_SERVICE) & known)
              .select("ContainerName", "ContainerImage").distinct()
              .filter(F.size(parts) >= 3)
              .select(F.col("ContainerName").alias("container_id"), F.lower(F.trim(parts[1])).alias("login")))
    name = F.lower(F.trim(F.col("username")))
    logins = (users.filter(F.coalesce(name, F.lit("")) != "")
              .select("id", F.explode(F.array_distinct(F.array(name, F.substring_index(name, "@", 1)))).alias("login"))
              .groupBy("login").agg(F.min("id").alias("user_id")))
    return (images.join(logins, "login").select("container_id", "user_id").distinct()
            .join(ownership.select("container_id", "user_id"), ["container_id", "user_id"], "left_anti"))


def ownership_report(ownership: DataFrame, users: DataFrame) -> DataFrame:
    return (ownership.join(users, ownership["user_id"] == users["id"])
            .select("container_id", F.col("container_id").alias("container_name"), "user_id",
                    "username", "role", "custom_name")
            .orderBy("container_id", "user_id"))


def with_alias(df: DataFrame, ownership: DataFrame, user_id: int) -> DataFrame:
    """Adds `display_name`: the user's own name of the container, else its name."""
    names = (ownership.filter(F.col("user_id") == user_id)
             .groupBy(F.col("container_id").alias("ContainerName")).agg(F.max("custom_name").alias("_custom")))
    return (df.join(names, "ContainerName", "left")
            .withColumn("display_name", F.coalesce(F.nullif("_custom", F.lit("")), "ContainerName"))
            .drop("_custom"))


def service_name(df: DataFrame) -> Column:
    """Compose service of a row, else the container name."""
    if "ComposeService" in df.columns:
        return or_default("ComposeService", F.col("ContainerName"))
    return or_default(attr("ResourceAttributes", fixed.SERVICE_ATTR), F.col("ContainerName"))


def split_service_key(key: str) -> tuple[str, str, str] | None:
    parts = [part.strip() for part in (key or "").split("/", 2)]
    return tuple(parts) if len(parts) == 3 and all(parts) else None


def service_scope(df: DataFrame, key: str) -> DataFrame:
    """Rows of one service, given as host/project/service."""
    parts = split_service_key(key)
    if parts is None:
        raise ValueError(f"not a service key: {key!r}")
    host, project, service = parts
    return df.filter((F.col("HostName") == host) & (F.col("ComposeProject") == project)
                     & (service_name(df) == service))


def match_containers(services: DataFrame, containers: DataFrame, name: str = "name") -> DataFrame:
    """Pairs of service and container: project and service both occur in the name, or it is the service.

    Substrings of a container name that are as long as some project name meet the project names in an equi-join, so no
    service is compared with every container. The lengths that occur are a handful and are read first.
    """
    wanted = services.select("service_key", F.lower("compose_project").alias("_project"),
                             F.lower("compose_service").alias("_service")).distinct()
    named = (containers.select(F.coalesce(F.col(name), F.lit("")).alias("container_name")).distinct()
             .withColumn("_name", F.lower("container_name")).filter(F.col("_name") != ""))
    size = F.length("_name")
    lengths = [r.n for r in wanted.filter(F.col("_project") != "").select(F.length("_project").alias("n")).distinct().collect()]
    none = F.array().cast("array<string>")
    pieces = F.concat(none, *(F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(F.col("_name"), i, F.lit(n)))
                                     ).otherwise(none) for n in sorted(lengths)))
    by_project = (named.withColumn("_project", F.explode(F.array_distinct(pieces)))
                  .join(wanted, "_project")
                  .filter((F.col("_service") != "") & F.contains(F.col("_name"), F.col("_service"))))
    by_service = named.join(wanted, named["_name"] == wanted["_service"])
    columns = ["service_key", "container_name"]
    return by_project.select(*columns).unionByName(by_service.select(*columns)).distinct()


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salts: int = 16) -> DataFrame:
    """First n rows per key. A busy key is first cut to n rows in each of its salts."""
    keys = list(keys)

    def cut(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return rows.withColumn("_rn", rank).filter(F.col("_rn") <= n).drop("_rn")

    salted = df.withColumn("_salt", F.pmod(F.hash(*order), F.lit(salts)))
    return cut(cut(salted, [*keys, "_salt"]), keys).drop("_salt")
