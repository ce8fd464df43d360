"""Live form of a specification: its sources as streams, its filters with state, its replies in an outbox.

    query = start_spec(compile_spec(spec), spark, out="/shared/out", checkpoint="/shared/ck")

Filters run as one streaming plan. Every micro-batch that passes them is routed
and scored in ``foreachBatch``; replies and actions go to a folder per batch, so a
replayed batch overwrites what it wrote. Budgets carry over from batch to batch: each
writes what agents used of the last day's hours, and the next one reads that alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import explode_actions
from sieveline.operators.routing import dispatch_actions, on_error
from sieveline.operators.rules import Filter, content_filter, priority_router
from sieveline.operators.scoring import Scorer, offline_scorer, score_in_budget, spent_in_hours
from sieveline.plans.spec import CompiledSpec, SpecError, custom_filter
from sieveline.schema import EVENT_SCHEMA
from sieveline.sources.files import read_capture, read_lines, stream_lines
from sieveline.sources.kafka import read_kafka_stream
from sieveline.sources.normalize import make_event, non_blank_lines, normalize_lines, union_sources
from sieveline.sources.tail import tail_lines
from sieveline.streaming import stateful
from sieveline.streaming.batches import batch_events_stream

COLUMNS = [f.name for f in EVENT_SCHEMA.fields]


def canonical_lines(lines: DataFrame, source_id: str) -> DataFrame:
    """Raw texts as canonical events: a random id and the time of reading, as a text has neither."""
    events = make_event(normalize_lines(lines.select("value"), source_id))
    return events.withColumn("metadata", F.lit(None).cast("string")).select(*COLUMNS)


def open_stream(spark: SparkSession, source: Mapping[str, Any]) -> DataFrame:
    """The streaming events of a source: log files, or Kafka topics.

    Whole files are read as they come to a folder; with ``follow`` the lines that are
    added to files are.
    """
    kind = source.get("adapter", "native/log-tailer")
    if kind == "kafka":
        events = read_kafka_stream(spark, source)
        return events.select(*[c for c in COLUMNS if c in events.columns])
    if kind in ("native/log-tailer", "native/stdin"):
        follow = non_blank_lines(tail_lines(spark, source["path"])) if source.get("follow") else stream_lines(spark, source["path"])
        return canonical_lines(follow, source["id"])
    raise SpecError(f"source {source['id']}: a stream of kind {kind} is brought by the caller")


def open_batch(spark: SparkSession, source: Mapping[str, Any]) -> DataFrame:
    """The stored events of a source: log files or exported captures."""
    kind = source.get("adapter", "native/log-tailer")
    if kind in ("native/log-tailer", "native/stdin"):
        return canonical_lines(read_lines(spark, source["path"]), source["id"])
    if kind == "native/tshark":
        return canonical_lines(read_capture(spark, source["path"], source.get("format", "json")), source["id"])
    raise SpecError(f"source {source['id']}: a table of kind {kind} is brought by the caller")


def _dedup(c: Mapping[str, Any], how: Mapping[str, Any]) -> Filter:
    keys = [*c.get("partition_by", ()), *c.get("key_fields", ["payload"])]
    return stateful.dedup_stream(keys, c.get("window_seconds", 30), **how)


def _sampling(c: Mapping[str, Any], how: Mapping[str, Any]) -> Filter:
    return stateful.adaptive_sample_stream(
        c.get("base_rate", 0.5), c.get("min_rate", 0.1), c.get("max_rate", 1.0), c.get("velocity_window_seconds", 60),
        c.get("high_velocity_threshold", 100), c.get("low_velocity_threshold", 10), c.get("partition_by", ["source_id"]), **how,
    )


def _batches(c: Mapping[str, Any], how: Mapping[str, Any]) -> Filter:
    return batch_events_stream(
        c.get("partition_by") or ["source_id"], c.get("window_seconds", 60), c.get("max_batch_size") or 50,
        c.get("summary_prompt") or "Analyze the following batch of events", **how,
    )


_STREAMS: dict[str, Callable[[Mapping[str, Any], Mapping[str, Any]], Filter]] = {
    "content-filter": lambda c, how: content_filter(c.get("rules", ()), c.get("mode")),
    "priority-router": lambda c, how: priority_router(
        c.get("high_priority_threshold", 2), c.get("low_priority_threshold", 5), bool(c.get("drop_low_priority", False))
    ),
    "dedup": _dedup,
    "rate-limiter": lambda c, how: stateful.rate_limit_stream(c.get("max_events_per_minute", 60), 60, c.get("partition_by", ["source_id"]), **how),
    "adaptive-sampling": _sampling,
    "windowed-aggregation": _batches,
}


def stream_filter(config: Mapping[str, Any], mode: str = "arrival", delay: str = "1 minute") -> Filter:
    """The streaming form of a filter.

    Without ``partition_by``, limits, rates and batches hold per source, so that no
    group takes the whole stream.
    """
    kind = config.get("type")
    if kind in _STREAMS:
        return _STREAMS[kind](config, {"mode": mode, "delay": delay})
    custom = custom_filter(kind)
    if custom is None:
        raise SpecError(f"filter type without a live form: {kind}")
    return custom(config)


def live_events(
    plan: CompiledSpec,
    spark: SparkSession,
    streams: Mapping[str, DataFrame] | None = None,
    mode: str = "arrival",
    delay: str = "1 minute",
    batch_mode: str | None = None,
) -> DataFrame:
    """The filtered stream; sources that the caller doesn't bring are opened."""
    given = streams or {}
    events = union_sources([given[s["id"]] if s["id"] in given else open_stream(spark, s) for s in plan.spec["sources"]])
    for config in plan.spec["filters"]:
        own = (batch_mode or mode) if config.get("type") == "windowed-aggregation" else mode
        events = events.transform(stream_filter(config, own, delay))
    return events


def in_one_file(few: DataFrame) -> DataFrame:
    """Few rows that are written as one file.

    They are shuffled: with ``coalesce`` one task would run the grouping of every
    partition and hold the memory of them all until it ends.
    """
    return few.repartition(1)


def _before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """A table as the micro-batch before left it; nothing older is read."""
    before = f"{path}/batch_id={batch_id - 1}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.parquet(before)


#: What of a filter's configuration its state depends on; everything else may change on an old checkpoint.
_STATE_OF = {"dedup": "key_fields", "rate-limiter": None, "adaptive-sampling": None, "windowed-aggregation": None}


def state_shape(plan: CompiledSpec, mode: str, batch_mode: str) -> list[str]:
    """One line per filter that keeps state, in order: what an old checkpoint must have in common."""
    lines = []
    for config in plan.spec["filters"]:
        kind = config["type"]
        if kind in _STATE_OF:
            own = config.get(_STATE_OF[kind]) if _STATE_OF[kind] else None
            how = batch_mode if kind == "windowed-aggregation" else mode
            lines.append(json.dumps({"filter": kind, "keys": own, "partition_by": list(config.get("partition_by") or ()), "mode": how}))
    return lines


def check_shape(spark: SparkSession, checkpoint: str, shape: list[str]) -> None:
    """Refuse a specification whose state an old checkpoint doesn't hold, by name; note the shape of a new one.

    Rules, windows, limits, agents and filters without state may change between runs.
    """
    path = f"{checkpoint}/state-shape"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        rows = [(i, line) for i, line in enumerate(shape)]
        spark.createDataFrame(rows, "no int, line string").coalesce(1).write.json(path)
        return
    before = [r["line"] for r in spark.read.schema("no int, line string").json(path).orderBy("no").collect()]
    for i in range(max(len(before), len(shape))):
        old, new = (json.loads(x[i]) if i < len(x) else None for x in (before, shape))
        if old != new:
            name = (new or old)["filter"]
            raise SpecError(f"filter {i + 1} with state ({name}) doesn't fit the checkpoint: it holds {old}, the specification asks for {new}")


def start_spec(
    plan: CompiledSpec,
    spark: SparkSession,
    out: str,
    checkpoint: str,
    streams: Mapping[str, DataFrame] | None = None,
    scorer: Scorer = offline_scorer,
    mode: str = "arrival",
    delay: str = "1 minute",
    trigger: Mapping[str, Any] | None = None,
):
    """Start the pipeline; returns the streaming query.

    With a trigger that ends by itself, as the default does, batches of events are
    decided in event time: a clock would keep the query going. On an old checkpoint a changed
    specification goes on with its state, or is refused by ``check_shape``.

    Writes ``out``/replies (every routed row with its reply, ``is_sent`` false
    beyond the budget), ``out``/actions, and ``out``/alerts, or ``out``/retry,
    ``out``/overflow and ``out``/given_up with the queue of failed requests, as the
    failure policy asks, each in a folder per micro-batch.
    """

    behavior = plan.spec["behavior"]
    policy = behavior["on_llm_unreachable"]
    limits = {k: behavior[n] for k, n in (("limit", "retry_limit"), ("max_attempts", "max_attempts"), ("retry_seconds", "retry_seconds")) if n in behavior}

    def each(batch: DataFrame, batch_id: int) -> None:
        session, now = batch.sparkSession, F.lit(datetime.now(timezone.utc))
        used = _before(session, f"{out}/budgets", batch_id)
        # Agents with and without a budget read the batch apart: the stream's plan runs once.
        batch.persist()
        try:
            requests, queue = plan.requests(batch).withColumn("attempt", F.lit(0)), dict(limits, now=now)
            waiting = _before(session, f"{out}/retry", batch_id) if policy == "buffer_limited" else None
            if waiting is not None:
                # What is due is asked again with this micro-batch, the rest goes on waiting.
                requests = requests.unionByName(waiting.where(F.col("due_at") <= now).select(requests.columns))
                queue["waiting"] = waiting.where(F.col("due_at") > now)
            replies = score_in_budget(requests, scorer, used=used)
            target = f"{out}/replies/batch_id={batch_id}"
            replies.write.mode("overwrite").parquet(target)
        finally:
            batch.unpersist()
        told = session.read.schema(replies.schema).parquet(target)
        in_one_file(spent_in_hours(told, used)).write.mode("overwrite").parquet(f"{out}/budgets/batch_id={batch_id}")
        sent = told.where("is_sent")
        parts = on_error(sent, policy, plan.handlers or [("none", "none")], **(queue if policy == "buffer_limited" else {}))
        if not plan.handlers:
            parts.pop("alerts", None)
        parts["actions"] = dispatch_actions(explode_actions(parts.pop("passed")), plan.handlers)
        for name, rows in parts.items():
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")

    trigger = trigger or {"availableNow": True}
    ends = "availableNow" in trigger or "once" in trigger
    check_shape(spark, checkpoint, state_shape(plan, mode, "ordered" if ends else mode))
    events = live_events(plan, spark, streams, mode, delay, "ordered" if ends else mode)
    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()
