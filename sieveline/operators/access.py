"""Entitlements: tenants, roles, permissions, API keys, audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.joins import lookup_join


def tenant_access(requests: DataFrame, tenants: DataFrame, resource: str, allowed: str) -> DataFrame:
    """Adds ``is_allowed``: the tenant is enabled and lists the resource, or has no list."""
    known = tenants.select(F.col("id").alias("tenant_id"), "enabled", F.col(allowed).alias("_list"))
    joined = lookup_join(requests, known, ["tenant_id"], "left")
    open_list = F.col("_list").isNull() | (F.size("_list") == 0)
    ok = F.col("enabled") & (open_list | F.array_contains("_list", F.col(resource)))
    return joined.withColumn("is_allowed", F.coalesce(ok, F.lit(False))).drop("enabled", "_list")


def _grants(users: DataFrame, roles: DataFrame) -> DataFrame:
    """(user_id, permission) over all roles of a user."""
    held = users.select("user_id", F.explode("roles").alias("role"))
    given = roles.select(F.col("name").alias("role"), F.explode("permissions").alias("permission")).distinct()
    return lookup_join(held, given, ["role"]).select("user_id", "permission")


def has_permission(requests: DataFrame, users: DataFrame, roles: DataFrame) -> DataFrame:
    """Adds ``is_granted``; 'admin' grants everything, unknown users and roles nothing.

    requests(request_id, user_id, wanted).  Roles are small sets, so a user's
    grants are first folded into one row per user.
    """
    per_user = _grants(users, roles).groupBy("user_id").agg(F.collect_set("permission").alias("_has"))
    joined = lookup_join(requests, per_user, ["user_id"], "left")
    ok = F.array_contains("_has", "admin") | F.array_contains("_has", F.col("wanted"))
    return joined.withColumn("is_granted", F.coalesce(ok, F.lit(False))).drop("_has")


def effective_permissions(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Sorted distinct permissions of every user, empty without a known role; 'admin' is not expanded."""
    granted = _grants(users, roles).groupBy("user_id").agg(F.array_sort(F.collect_set("permission")).alias("permissions"))
    everyone = users.select("user_id").distinct().join(granted, "user_id", "left")
    return everyone.withColumn("permissions", F.coalesce("permissions", F.expr("cast(array() as array<string>)")))


def user_by_key(requests: DataFrame, users: DataFrame) -> DataFrame:
    """First registered user per requested API key; NULL if there is none."""
    first = users.where("api_key IS NOT NULL").groupBy("api_key").agg(F.min_by("user_id", "user_no").alias("user_id"))
    return lookup_join(requests, first, ["api_key"], "left")


def audit_query(
    log: DataFrame,
    equals: dict[str, str] | None = None,
    start: str | None = None,
    end: str | None = None,
    limit: int = 100,
    newest: int | None = None,
    seq: str = "seq",
) -> DataFrame:
    """The last ``limit`` matching entries, in append order.

    ``start`` and ``end`` are inclusive and compared as ISO text; ``newest``
    first restricts the log to its newest entries.
    """
    if newest is not None:
        log = log.orderBy(F.desc(seq)).limit(newest)
    for name, value in (equals or {}).items():
        log = log.where(F.col(name) == value)
    if start is not None:
        log = log.where(F.col("timestamp") >= start)
    if end is not None:
        log = log.where(F.col("timestamp") <= end)
    return log.orderBy(F.desc(seq)).limit(limit).orderBy(seq)


def write_audit(log: DataFrame, path: str) -> None:
    """Append entries, one JSON object per line."""
    log.write.mode("append").json(path)


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
