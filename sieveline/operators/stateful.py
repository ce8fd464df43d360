"""Stateful filters in event time: dedup, limits, adaptive sampling, batching, budgets.

Ties of the timestamp are broken by event id.  ``partition_by=[]`` is one global
state; any list of columns gives one state per key.  All of them run as ordered
scans (see ``ordered.py``): a key too large for one task, the global one
included, is spread over many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.numbers import hash_sample
from sieveline.functions.paths import key_parts, path_present
from sieveline.operators.ordered import (
    KEY,
    PART,
    TIME,
    AcceptScan,
    BatchScan,
    ClampScan,
    Ordered,
    SumScan,
    apply_scan,
    ordered_layout,
    running_sum,
)
from sieveline.operators.rules import Filter
from sieveline.schema import DEFAULT_PRIORITY

MICROS = 1_000_000


def _stateful(run: Filter) -> Filter:
    run.stateful = True
    return run


def _micros(seconds: float) -> int:
    return round(seconds * MICROS)


def _accept(df: DataFrame, keys: Sequence[str | Column], seconds: float, limit: int) -> DataFrame:
    # A row without a time is in nobody's window: it is a key of its own, and passes.
    alone = F.when(F.col("timestamp").isNull(), F.col("event_id"))
    layout = ordered_layout(df, [*keys, alone], ["event_id"])
    return apply_scan(layout, AcceptScan(_micros(seconds), limit)).df.drop(KEY, TIME, PART)


def dedup_window(
    key_fields: Sequence[str] = ("payload",),
    window_seconds: float = 30,
    partition_by: Sequence[str] = (),
    missing_key: str = "share",
    flag: str | None = None,
):
    """Drop events whose key was accepted less than ``window_seconds`` before.

    A dropped duplicate does not extend the window.  Missing key fields count
    as '' and share one key; ``missing_key="pass"`` lets such events through.
    Events without a time are nobody's duplicates.
    """

    def run(df: DataFrame) -> DataFrame:
        keyless = None
        if missing_key == "pass":
            complete = F.lit(True)
            for f in key_fields:
                complete = complete & path_present(f)
            keyless, df = df.where(~complete), df.where(complete)
        out = _accept(df, [*partition_by, *key_parts(key_fields)], window_seconds, 1)
        if keyless is not None:
            out = out.unionByName(keyless.withColumn("_accepted", F.lit(True)))
        return _finish(out, flag)

    return _stateful(run)


def _finish(df: DataFrame, flag: str | None) -> DataFrame:
    return df.where("_accepted").drop("_accepted") if flag is None else df.withColumnRenamed("_accepted", flag)


def rate_limit_sliding(
    max_events: int = 60,
    window_seconds: float = 60,
    partition_by: Sequence[str] = (),
    flag: str | None = None,
):
    """Pass while fewer than ``max_events`` were passed in the last window; events without a time pass uncounted."""
    return _stateful(lambda df: _finish(_accept(df, list(partition_by), window_seconds, max_events), flag))


def rate_limit_tumbling(max_events: int = 60, window: str = "1 minute", partition_by: Sequence[str] = ()):
    """First ``max_events`` per key and aligned window.

    The rank bound is pushed below the shuffle, so a task forwards at most
    ``max_events`` rows of any group.
    """
    from pyspark.sql import Window

    def run(df: DataFrame) -> DataFrame:
        slot = F.window("timestamp", window).getField("start")
        w = Window.partitionBy(*partition_by, "_slot").orderBy("timestamp", "event_id")
        return (
            df.withColumn("_slot", slot)
            .withColumn("_rank", F.row_number().over(w))
            .where(F.col("_rank") <= max_events)
            .drop("_slot", "_rank")
        )

    return run


def _sweep(df: DataFrame, window_seconds: float, keys: Sequence[str]) -> Ordered:
    """Rows plus one 'leaves the look-back' marker each, counted by a running sum.

    A marker sorts behind rows of the same instant because the lower bound of
    the look-back is inclusive.  No range frame, hence no group of rows has to
    be held together.
    """
    enter = df.withColumns(
        {"_kind": F.lit(0), "_delta": F.lit(1).cast("long"), "_at": F.coalesce(F.unix_micros("timestamp"), F.lit(0))}
    )
    leave = enter.select(
        *[F.col(k) for k in keys],
        F.lit(1).alias("_kind"),
        F.lit(-1).cast("long").alias("_delta"),
        (F.col("_at") + _micros(window_seconds)).alias("_at"),
    )
    both = enter.unionByName(leave, allowMissingColumns=True)
    layout = ordered_layout(both, list(keys), ["_at", "_kind", "event_id"], time_col=None)
    return apply_scan(layout, SumScan("_delta", "_count_before", "_count"))


def velocity(window_seconds: float = 60, partition_by: Sequence[str] = ()):
    """Adds ``velocity``: events of the look-back (this one included) per second."""

    def run(df: DataFrame) -> DataFrame:
        swept = _sweep(df, window_seconds, partition_by)
        return (
            swept.df.where("_kind = 0")
            .withColumn("velocity", F.col("_count") / F.lit(float(window_seconds)))
            .select(*df.columns, "velocity")
        )

    return run


def adaptive_rate(
    base_rate: float = 0.5,
    min_rate: float = 0.1,
    max_rate: float = 1.0,
    window_seconds: float = 60,
    high_velocity: float = 100,
    low_velocity: float = 10,
    partition_by: Sequence[str] = (),
):
    """Adds ``velocity`` and ``sample_rate``, the rate in force at each event."""

    def run(df: DataFrame) -> DataFrame:
        v = F.col("_count") / F.lit(float(window_seconds))
        row = F.col("_kind") == 0
        faster, slower = row & (v > high_velocity), row & (v < low_velocity)
        # Both scans use the partitions of the sweep: no second shuffle.
        steps = _sweep(df, window_seconds, partition_by).with_columns(
            {
                "velocity": v,
                "_factor": F.when(faster, F.lit(0.8)).when(slower, F.lit(1.2)).otherwise(F.lit(1.0)),
                "_lo": F.when(faster, F.lit(float(min_rate))).otherwise(F.lit(float("-inf"))),
                "_hi": F.when(slower, F.lit(float(max_rate))).otherwise(F.lit(float("inf"))),
            }
        )
        rated = apply_scan(steps, ClampScan(base_rate, "_factor", "_lo", "_hi"))
        return rated.df.where("_kind = 0").withColumn("sample_rate", F.col("_rate")).select(
            *df.columns, "velocity", "sample_rate"
        )

    return run


def adaptive_sample(keep_rate: bool = False, **config):
    """Pass priorities 1 and 2; sample the rest (missing priority too) at the rate in force."""

    def run(df: DataFrame) -> DataFrame:
        rated = adaptive_rate(**config)(df)
        urgent = F.coalesce(F.col("priority") <= 2, F.lit(False))
        kept = rated.where(urgent | (hash_sample(F.col("event_id")) < F.col("sample_rate")))
        return kept if keep_rate else kept.drop("velocity", "sample_rate")

    return _stateful(run)


def batch_members(
    window_seconds: float = 60,
    max_batch_size: int = 50,
    partition_by: Sequence[str] = (),
    origin_us: int | None = None,
):
    """Adds ``batch_no`` per key under arrival-driven count-or-time batching, and
    ``is_flush`` for the row that completes a batch.

    The first window starts at ``origin_us``, by default at the key's first event.
    """

    def run(df: DataFrame) -> DataFrame:
        layout = ordered_layout(df, list(partition_by), ["event_id"])
        flagged = apply_scan(layout, BatchScan(_micros(window_seconds), max_batch_size, origin_us))
        numbered = apply_scan(flagged, SumScan("_flush", "batch_no", "_through"))
        return numbered.df.select(*df.columns, "batch_no", (F.col("_flush") == 1).alias("is_flush"))

    return run


def summarize_batches(
    df: DataFrame,
    keys: Sequence[str],
    prompt: str = "Analyze the following batch of events",
    source_id: str = "aggregation",
    held: Column | None = None,
) -> DataFrame:
    """One event per batch; ``keys`` must bound a batch (number or window and chunk)."""
    summary = F.struct(
        "timestamp", "event_id", "source_id", "event_type", "priority", "payload"
    )
    grouped = df.groupBy(*keys).agg(
        F.count("*").alias("batch_size"),
        F.min(F.coalesce("priority", F.lit(DEFAULT_PRIORITY))).alias("priority"),
        F.array_sort(F.collect_list(summary)).alias("events"),
        *([] if held is None else [held.alias("is_held")]),
    )
    sources = F.array_distinct(F.transform("events", lambda e: e["source_id"]))
    return grouped.select(
        *[F.col(k).alias("batch_source" if k == "source_id" else k) for k in keys],
        F.lit(source_id).alias("source_id"),
        F.lit("DATA").alias("event_type"),
        "priority",
        "batch_size",
        F.lit(prompt).alias("window_prompt"),
        "events",
        sources.alias("source_ids"),
        F.to_json(
            F.struct(F.lit(True).alias("aggregated"), F.col("batch_size").alias("event_count"), sources.alias("source_ids"))
        ).alias("metadata"),
        *([] if held is None else ["is_held"]),
    )


def batch_arrival(partition_by: Sequence[str] = (), prompt: str = "Analyze the following batch of events", **config):
    """Batch events.  The rows held when the input ends form one more batch per
    key, marked ``is_held``; it goes on through later filters like any other."""

    def run(df: DataFrame) -> DataFrame:
        members = batch_members(partition_by=partition_by, **config)(df)
        keys = [*partition_by, "batch_no"]
        return summarize_batches(members, keys, prompt, held=~F.max("is_flush"))

    return _stateful(run)


def batch_events(batches: DataFrame, keys: Sequence[str] = ("batch_no",)) -> DataFrame:
    """Batches as canonical events, so that later filters and agents can take them."""
    item = lambda e: F.struct(
        e["event_id"].alias("event_id"), e["source_id"].alias("source_id"), e["timestamp"].alias("timestamp"),
        e["event_type"].alias("event_type"), e["priority"].alias("priority"), F.try_parse_json(e["payload"]).alias("payload"),
    )
    payload = F.to_json(F.struct("batch_size", "window_prompt", F.transform("events", item).alias("events")))
    return batches.select(
        F.md5(F.concat_ws("|", F.lit("batch"), *[F.col(k).cast("string") for k in keys], F.element_at("events", 1)["event_id"])).alias("event_id"),
        "source_id",
        F.element_at("events", -1)["timestamp"].alias("timestamp"),
        "event_type", "priority",
        payload.alias("payload"),
        "metadata",
        F.lit(None).cast("string").alias("raw"),
    )


def batch_tumbling(
    window: str = "1 minute",
    max_batch_size: int = 50,
    partition_by: Sequence[str] = (),
    prompt: str = "Analyze the following batch of events",
):
    """Batches within aligned windows, split into chunks of ``max_batch_size``."""

    def run(df: DataFrame) -> DataFrame:
        slotted = df.withColumn("window_start", F.window("timestamp", window).getField("start")).withColumn(
            "_one", F.lit(1).cast("long")
        )
        ranked = running_sum(
            slotted, "_one", [*partition_by, "window_start"], ["timestamp", "event_id"], before="_pos"
        )
        chunked = ranked.withColumn("chunk", F.floor(F.col("_pos") / F.lit(max_batch_size)).cast("long"))
        return summarize_batches(chunked, [*partition_by, "window_start", "chunk"], prompt)

    return _stateful(run)


def lazy_hours(df: DataFrame, seconds: float = 3600) -> DataFrame:
    """Adds ``hour_no``: an hour restarts at the first event an hour after its start."""
    layout = ordered_layout(df, [], ["event_id"])
    marked = apply_scan(layout, AcceptScan(_micros(seconds), 1)).with_columns({"_start": F.col("_accepted").cast("long")})
    return apply_scan(marked, SumScan("_start", "_b", "hour_no")).df.select(*df.columns, "hour_no")


def token_budget(
    agent: str = "agent_id",
    tokens: str = "tokens",
    max_per_hour: str = "max_per_hour",
    max_per_event: str | None = None,
    exact_hours: bool = False,
):
    """Adds ``tokens_before`` and ``is_sent``: send while the hour's total is below the budget.

    Rows are (event, agent) pairs; ``tokens`` is what the reply costs (0 for a
    failure) and a NULL budget never stops anything.  Summing all earlier rows
    equals summing the sent ones: once over budget, nothing more is added.
    """

    def run(df: DataFrame) -> DataFrame:
        if exact_hours:
            timed = lazy_hours(df)
            hour = "hour_no"
        else:
            hour = "hour_start"
            timed = df.withColumn(hour, F.window("timestamp", "1 hour").getField("start"))
        timed = timed.withColumn("_cost", F.coalesce(F.col(tokens), F.lit(0)).cast("long"))
        summed = running_sum(timed, "_cost", [agent, hour], ["timestamp", "event_id"], before="tokens_before")
        fits = F.col(max_per_hour).isNull() | (F.col("tokens_before") < F.col(max_per_hour))
        if max_per_event is not None:
            fits = fits & (F.col(max_per_event).isNull() | (F.col("_cost") <= F.col(max_per_event)))
        return summed.withColumn("is_sent", fits).drop("_cost", "_through")

    return run
