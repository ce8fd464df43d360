"""Stateless filters: content rules, priorities, tenants, triggers, chains."""

from __future__ import annotations

import operator
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.paths import js_text, path_present, path_text, truthy
from sieveline.operators.joins import lookup_join
from sieveline.schema import DEFAULT_PRIORITY
from sieveline.session import checkpoint_root

Filter = Callable[[DataFrame], DataFrame]


def rule_predicate(rule: Mapping[str, Any]) -> Column:
    """One content rule; within it match > regex > in > not_in > exists."""
    text = path_text(rule["field"])  # NULL only where the field is missing
    if rule.get("match") is not None:
        test = text.contains(rule["match"])
    elif rule.get("regex") is not None:
        test = text.rlike(rule["regex"])
    elif rule.get("in") is not None:
        test = text.isin([js_text(v) for v in rule["in"]])
    elif rule.get("not_in") is not None:
        test = ~text.isin([js_text(v) for v in rule["not_in"]])
    else:
        return path_present(rule["field"])
    return F.coalesce(test, F.lit(False))


def rules_predicate(rules: Sequence[Mapping[str, Any]], mode: str | None = "all") -> Column:
    """All (default) or any of the rules; no rules pass everything, or nothing."""
    if mode in (None, "all"):
        return reduce(operator.and_, map(rule_predicate, rules), F.lit(True))
    return reduce(operator.or_, map(rule_predicate, rules), F.lit(False))


def content_filter(rules: Sequence[Mapping[str, Any]], mode: str | None = "all") -> Filter:
    return lambda df: df.where(rules_predicate(rules, mode))


def priority_predicate(high: int = 2, low: int = 5, drop_low: bool = False) -> Column:
    p = F.coalesce(F.col("priority"), F.lit(DEFAULT_PRIORITY))
    return (p <= high) | ~((p >= low) & F.lit(drop_low))


def priority_router(high: int = 2, low: int = 5, drop_low: bool = False) -> Filter:
    return lambda df: df.where(priority_predicate(high, low, drop_low))


def trigger_predicate(trigger: Mapping[str, Any] | None) -> Column:
    """Does a primary event ask for a lookup? No trigger: never."""
    if not trigger:
        return F.lit(False)
    text = path_text(trigger["field"])
    if trigger.get("match"):
        test = text.contains(trigger["match"])
    elif trigger.get("regex"):
        test = text.rlike(trigger["regex"])
    else:
        test = truthy(trigger["field"])
    return F.coalesce(test, F.lit(False))


def with_metadata_text(metadata: Column, name: str, value: Column) -> Column:
    """Set one string field of a JSON object text, keeping the others."""
    others = F.map_filter(
        F.coalesce(F.from_json(metadata, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>")),
        lambda k, _: k != name,
    )
    return F.to_json(F.map_concat(others, F.create_map(F.lit(name), value.cast("variant"))))


def tenant_isolation(tenants: DataFrame, tenant: Column) -> Filter:
    """Keep rows of enabled tenants and note the tenant in the metadata."""

    def run(df: DataFrame) -> DataFrame:
        enabled = tenants.where("enabled").select(F.col("id").alias("_tenant")).distinct()
        kept = lookup_join(df.withColumn("_tenant", tenant), enabled, ["_tenant"])
        return kept.withColumn("metadata", with_metadata_text(F.col("metadata"), "tenant_id", F.col("_tenant"))).drop("_tenant")

    return run


def filter_chain(filters: Sequence[Filter]) -> Filter:
    """Ordered composition; a later filter sees only what earlier ones passed.

    A stateful filter looks at its input twice (to count keys, then to run), so
    what one stateful filter passed is checkpointed if another one follows.
    """
    filters = list(filters)
    stateful = [getattr(f, "stateful", False) for f in filters]

    def run(df: DataFrame) -> DataFrame:
        for i, f in enumerate(filters):
            df = df.transform(f)
            if stateful[i] and any(stateful[i + 1 :]):
                checkpoint_root(df.sparkSession)
                df = df.checkpoint()
        return df

    run.stateful = any(stateful)
    return run


def row_predicate_filter(predicate: Callable[..., pd.Series], columns: Sequence[str]) -> Filter:
    """User filter from a vectorised predicate: pandas Series in, booleans out."""

    @F.pandas_udf("boolean")
    def test(*series: pd.Series) -> pd.Series:
        return predicate(*series)

    return lambda df: df.where(test(*[F.col(c) for c in columns]))


def project_for_agent(prefix: str = "New event received:\n\n") -> Column:
    """Prompt text of an event: seven fields, without the raw line."""
    return F.concat(
        F.lit(prefix),
        F.to_json(
            F.struct(
                "event_id", "source_id",
                F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
                "event_type", "priority",
                F.try_parse_json("payload").alias("payload"),
                F.try_parse_json("metadata").alias("metadata"),
            ),
            {"pretty": "true"},
        ),
    )
