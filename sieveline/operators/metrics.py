"""Rollups over decision, response and status logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.numbers import round_js
from sieveline.operators.joins import lookup_join
from sieveline.operators.ordered import running_sum


def decision_log(events: DataFrame, decisions: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row per (event, filter) reached; a rejected event reaches no later filter.

    ``decisions`` are row predicates in chain order (stateful filters supply
    their flag column), so the log is a projection of the events.
    """
    rows, reached = [], F.lit(True)
    for i, (name, passed) in enumerate(decisions):
        rows.append(
            F.when(reached, F.struct(F.lit(i).alias("filter_no"), F.lit(name).alias("filter"), passed.alias("passed")))
        )
        reached = reached & passed
    return events.select(
        "event_id", "source_id", "timestamp",
        F.explode(F.array_compact(F.array(*rows))).alias("d"),
    ).select("event_id", "source_id", "timestamp", "d.filter_no", "d.filter", "d.passed")


def pipeline_totals(events: DataFrame, decisions: DataFrame, responses: DataFrame, buffered: DataFrame | None = None) -> DataFrame:
    """One row of totals.  responses(is_sent, tokens, error)."""
    received = events.agg(F.count("*").alias("events_received"))
    rejected = decisions.agg(F.count_if(~F.col("passed")).alias("events_filtered"))
    replies = responses.agg(
        F.count_if(F.col("is_sent") & F.col("error").isNull()).alias("events_sent"),
        F.count_if(~F.col("is_sent") | F.col("error").isNotNull()).alias("events_dropped"),
        F.coalesce(F.sum(F.when(F.col("is_sent") & F.col("error").isNull(), F.col("tokens"))), F.lit(0)).alias("tokens_total"),
    )
    if buffered is None:
        held = received.select(F.lit(0).cast("long").alias("events_buffered"))
    else:
        held = buffered.agg(F.count("*").alias("events_buffered"))
    one = F.lit(1)
    out = received.withColumn("_k", one)
    for part in (rejected, replies, held):  # one-row tables
        out = out.join(part.withColumn("_k", one), "_k")
    return out.drop("_k")


def adapter_metrics(events: DataFrame, status_log: DataFrame) -> DataFrame:
    """Events produced, last event time and latest status per source."""
    made = events.groupBy("source_id").agg(
        F.count("*").alias("events_produced"), F.max("timestamp").alias("last_event_at")
    )
    status = status_log.groupBy("source_id").agg(F.max_by("status", "status_at").alias("status"))
    return made.join(status, "source_id", "full_outer").select(
        "source_id",
        F.coalesce("events_produced", F.lit(0)).alias("events_produced"),
        "last_event_at",
        F.coalesce("status", F.lit("connected")).alias("status"),
    )


def filter_metrics(decisions: DataFrame) -> DataFrame:
    """In, out and drop rate per filter."""
    return (
        decisions.groupBy("filter_no", "filter")
        .agg(F.count("*").alias("events_in"), F.count_if("passed").alias("events_out"))
        .withColumn("drop_rate", (F.col("events_in") - F.col("events_out")) / F.col("events_in"))
    )


def tokens_hourly(responses: DataFrame, origin: str = "0 seconds") -> DataFrame:
    """Tokens per hour; ``origin`` shifts where an hour starts."""
    return responses.groupBy(F.window("timestamp", "1 hour", startTime=origin).getField("start").alias("hour_start")).agg(
        F.sum("tokens").alias("tokens")
    )


def events_per_second(events: DataFrame, now: Column | None = None, uptime_seconds: float | None = None) -> DataFrame:
    """Events of the last 60 s per second of min(uptime, 60); ``now`` defaults to the last event."""
    if now is None:
        last = events.agg(F.max("timestamp").alias("_now"))
        # One row; as an equi-join on a constant it stays a plain broadcast join.
        events = events.withColumn("_k", F.lit(1)).join(F.broadcast(last.withColumn("_k", F.lit(1))), "_k")
        now = F.col("_now")
    span = 60.0 if uptime_seconds is None else min(uptime_seconds, 60.0)
    recent = F.count_if(F.col("timestamp") > now - F.expr("interval 60 seconds"))
    rate = round_js(recent / F.lit(span), 2) if span > 0 else F.lit(0.0)
    return events.agg(rate.alias("events_per_second"))


def avg_latency(responses: DataFrame, last: int = 1000, seq: Sequence[str] = ("timestamp", "event_id")) -> DataFrame:
    """Rounded mean of the last latencies."""
    newest = responses.orderBy(*[F.desc(c) for c in seq]).limit(last)
    return newest.agg(F.coalesce(round_js(F.avg("latency_ms")), F.lit(0)).alias("avg_latency_ms"))


def inflight(marks: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Adds ``inflight`` after each mark (+1 start, -1 end)."""
    return running_sum(marks.withColumn("_step", F.col("step").cast("long")), "_step", [], order_by, through="inflight").drop(
        "_step", "_before"
    )


def event_status(transitions: DataFrame, recent: DataFrame) -> DataFrame:
    """Latest status of the events still in the recent list."""
    kept = lookup_join(transitions, recent.select("event_id").distinct(), ["event_id"], "left_semi")
    return kept.groupBy("event_id").agg(F.max_by("status", "seq").alias("status"))


def recent(df: DataFrame, n: int, order_by: Sequence[str] = ("timestamp", "event_id")) -> DataFrame:
    """The last ``n`` rows, newest first."""
    return df.orderBy(*[F.desc(c) for c in order_by]).limit(n)


def recent_per_agent(responses: DataFrame, n: int = 30) -> DataFrame:
    """Panels: the overall last ``n`` replies, ranked within each agent."""
    from pyspark.sql import Window

    w = Window.partitionBy("agent_id").orderBy(F.desc("timestamp"), F.desc("event_id"))
    last = recent(responses, n, ("timestamp", "event_id", "agent_id"))
    return last.withColumn("panel_pos", F.row_number().over(w).cast("bigint"))


def response_log(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Per (event, agent): content, tokens, latency and whether actions were asked for."""
    return requests.join(replies, ["event_id", "agent_id"]).select(
        "event_id", "source_id", "agent_id", "content",
        F.coalesce("tokens", F.lit(0)).alias("tokens_used"),
        "latency_ms",
        (F.coalesce(F.size("actions"), F.lit(0)) > 0).alias("has_actions"),
    )
