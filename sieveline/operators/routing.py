"""Routing of events to agents, dispatch of actions, lookups and alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.json import is_json
from sieveline.functions.text import describe_action
from sieveline.operators.joins import lookup_join
from sieveline.operators.ordered import running_sum
from sieveline.operators.rules import trigger_predicate
from sieveline.session import checkpoint_root


def _targets(agents: Sequence[Mapping[str, Any]]) -> Column:
    """Agents for a row's source: fan-out agents plus those listing the source.

    The agents come from the pipeline's specification, so this is a constant of
    the plan and needs no join.
    """
    everyone = [a["id"] for a in agents if not a.get("sources")]
    listed: dict[str, list[str]] = {}
    for a in agents:
        for s in dict.fromkeys(a.get("sources") or []):
            listed.setdefault(s, []).append(a["id"])
    empty = F.expr("cast(array() as array<string>)")
    base = F.array(*[F.lit(i) for i in everyone]) if everyone else empty
    if not listed:
        return base
    table = F.create_map(*[x for s, ids in listed.items() for x in (F.lit(s), F.array(*[F.lit(i) for i in ids]))])
    return F.concat(base, F.coalesce(F.try_element_at(table, F.col("source_id")), empty))


def route_agents(events: DataFrame, agents: Sequence[Mapping[str, Any]]) -> DataFrame:
    """One row per (event, agent)."""
    return events.select("*", F.explode(_targets(agents)).alias("agent_id"))


def unrouted(events: DataFrame, agents: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Events no agent wants."""
    return events.where(F.size(_targets(agents)) == 0)


def route_agents_table(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Routing against a table of (agent_id, source_id) of any size."""
    return lookup_join(events, subscriptions.select("source_id", "agent_id").distinct(), ["source_id"])


def _handlers(handlers: Sequence[tuple[str, str]]) -> dict[str, str]:
    return dict(handlers)  # the last handler of a type wins


def dispatch_actions(actions: DataFrame, handlers: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds ``handler``; NULL where no handler has the action's type."""
    known = _handlers(handlers)
    if not known:
        return actions.withColumn("handler", F.lit(None).cast("string"))
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return actions.withColumn("handler", F.try_element_at(table, F.col("type")))


# Fixed value: how the message of an alert begins.
ALERT_MESSAGE = "LLM bridge unreachable for agent"
ALERT_SOURCE = "engine:pipeline"


def alert_fanout(failed: DataFrame, handlers: Sequence[tuple[str, str]], timestamp: str = "timestamp") -> DataFrame:
    """One action request per failed send and handler: its payload holds a whole ERROR event.

    The event's id is derived from the dropped event and the agent, its time is
    the dropped event's, so that a rerun raises the same alert.
    """
    alert_id = F.concat(F.lit("alert-"), F.col("event_id"), F.lit("-"), F.col("agent_id"))
    pairs = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(h).alias("handler")) for t, h in _handlers(handlers).items()])
    return failed.select("*", F.explode(pairs).alias("_h")).select(
        F.col("event_id").alias("dropped_event_id"),
        F.col("_h.type").alias("handler_type"),
        F.col("_h.handler").alias("handler"),
        F.lit("ERROR").alias("event_type"),
        F.to_json(
            F.struct(
                F.struct(
                    alert_id.alias("event_id"),
                    F.lit(ALERT_SOURCE).alias("source_id"),
                    F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
                    F.lit("ERROR").alias("event_type"),
                    F.struct(
                        F.concat(F.lit(ALERT_MESSAGE + ' "'), F.col("agent_id"), F.lit('"')).alias("message"),
                        F.col("error"),
                        F.col("event_id").alias("dropped_event_id"),
                    ).alias("payload"),
                ).alias("event")
            )
        ).alias("payload"),
    )


#: Failed requests that an agent's queue holds, and how often a request is asked at most.
QUEUE_LIMIT, MAX_ATTEMPTS, RETRY_SECONDS = 100, 3, 60.0


def buffer_failures(
    replies: DataFrame,
    limit: int = QUEUE_LIMIT,
    max_attempts: int = MAX_ATTEMPTS,
    retry_seconds: float = RETRY_SECONDS,
    waiting: DataFrame | None = None,
    now: Column | None = None,
) -> dict[str, DataFrame]:
    """Split replies into ``passed``, ``retry``, ``overflow`` and ``given_up``.

    ``attempt`` says how often a request was asked before (0 without that column).
    Failed ones wait, twice as long after each attempt, in a queue per agent, which
    ``waiting`` is already in; of a queue's oldest events ``limit`` stay, the
    rest overflows. What failed ``max_attempts`` times is given up.
    """
    tried = replies if "attempt" in replies.columns else replies.withColumn("attempt", F.lit(0))
    bad = tried.where("error IS NOT NULL").withColumn("attempt", F.col("attempt") + 1)
    pause = F.make_dt_interval(secs=F.lit(float(retry_seconds)) * F.pow(F.lit(2.0), F.col("attempt") - 1))
    queue = bad.where(F.col("attempt") < max_attempts).withColumn("due_at", (F.current_timestamp() if now is None else now) + pause)
    if waiting is not None:
        queue = queue.unionByName(waiting.select(queue.columns))
    oldest = Window.partitionBy("agent_id").orderBy(F.col("timestamp").asc_nulls_first(), "event_id")
    # The rank limit is applied below the shuffle: a task gets a few rows of an agent from each other task.
    kept = queue.withColumn("_rank", F.row_number().over(oldest)).where(F.col("_rank") <= limit).drop("_rank")
    return {
        "passed": replies.where("error IS NULL"),
        "retry": kept,
        "overflow": queue.join(kept.select("agent_id", "event_id"), ["agent_id", "event_id"], "left_anti").select(queue.columns),
        "given_up": bad.where(F.col("attempt") >= max_attempts),
    }


def retried(requests: DataFrame, ask, limit: int = QUEUE_LIMIT, max_attempts: int = MAX_ATTEMPTS) -> dict[str, DataFrame]:
    """Ask for requests, and for those that fail again and again until ``max_attempts``; the queue between two rounds is bounded.

    ``ask`` appends reply columns to requests. Each round is checkpointed, so that no agent is asked
    twice for the same attempt.
    """
    checkpoint_root(requests.sparkSession)
    todo, out = requests.withColumn("attempt", F.lit(0)), {}
    for _ in range(max_attempts):
        parts = buffer_failures(ask(todo).checkpoint(), limit, max_attempts)
        todo = parts.pop("retry").select(todo.columns)
        out = {k: out[k].unionByName(v.select(out[k].columns)) if k in out else v for k, v in parts.items()}
    return out


def on_error(replies: DataFrame, policy: str, handlers: Sequence[tuple[str, str]] = (), **queue) -> dict[str, DataFrame]:
    """Split replies by the failure policy into ``passed`` and what the policy asks for; ``queue`` goes to ``buffer_failures``."""
    good, bad = replies.where("error IS NULL"), replies.where("error IS NOT NULL")
    if policy == "drop_and_alert":
        return {"passed": good, "alerts": alert_fanout(bad, handlers)}
    if policy == "buffer_limited":
        return buffer_failures(replies, **queue)
    if policy == "passthrough":
        return {"passed": replies}
    raise ValueError(f"unknown failure policy: {policy}")


def triggered_lookup(
    primary: DataFrame, lookup: DataFrame, trigger: Mapping[str, Any] | None, on: str, ts: str = "timestamp"
) -> DataFrame:
    """Primary rows, each triggering one followed by its first lookup row.

    ``ord`` 0 is the primary row and 1 the lookup row behind it.  The lookup
    side is reduced to one row per key before the join.
    """
    first = lookup.groupBy(on).agg(F.min_by("result", "lookup_no").alias("payload"))
    hits = lookup_join(
        primary.where(trigger_predicate(trigger)).drop("payload"), first, [on]
    )
    columns = [*primary.columns]
    base = primary.withColumn("ord", F.lit(0))
    return base.unionByName(hits.select(*columns).withColumn("ord", F.lit(1)))


def approval_outcome(
    requests: DataFrame,
    replies: DataFrame,
    timeout_seconds: int = 60,
    auto_deny: bool = True,
    mode: str = "webhook",
    has_url: bool = True,
) -> DataFrame:
    """Adds ``is_approved``: requests(request_id, request_ts), replies(request_id, reply_ts, status, body)."""
    if mode == "webhook" and not has_url:
        return requests.withColumn("is_approved", F.lit(False))
    first = replies.groupBy("request_id").agg(F.min_by(F.struct("reply_ts", "status", "body"), "reply_ts").alias("_r"))
    joined = requests.join(first, "request_id", "left")
    in_time = F.col("_r.reply_ts") <= F.col("request_ts") + F.make_dt_interval(secs=F.lit(timeout_seconds))
    default = F.lit(not auto_deny)
    if mode == "console":
        answer = F.lower(F.trim(F.col("_r.body"))).startswith("y")
        verdict = F.when(F.coalesce(in_time, F.lit(False)), F.coalesce(answer, F.lit(False))).otherwise(default)
    else:
        verdict = webhook_verdict(in_time, F.col("_r.status"), F.col("_r.body"), auto_deny)
    return joined.withColumn("is_approved", verdict).drop("_r")


def webhook_verdict(in_time: Column, status: Column, body: Column, auto_deny: bool) -> Column:
    """Approved only by a reply in time, of a good status, whose ``approved`` is the boolean true."""
    given = F.try_variant_get(F.try_parse_json(body), "$.approved", "variant")
    is_boolean = F.coalesce(F.schema_of_variant(given) == "BOOLEAN", F.lit(False))
    yes = is_boolean & F.coalesce(F.try_variant_get(given, "$", "boolean"), F.lit(False))
    usable = in_time & status.between(200, 299) & is_json(body)
    return F.when(F.coalesce(usable, F.lit(False)), yes).otherwise(F.lit(not auto_deny))


def webhook_bodies(actions: DataFrame) -> DataFrame:
    """Outbox rows for webhook actions: the payload is the body."""
    return actions.withColumn("body", F.to_json(F.try_parse_json("action_payload")))


def tool_call_bodies(actions: DataFrame, default_tool: str, order_by: Sequence[str]) -> DataFrame:
    """Outbox rows for tool calls, with request ids counting up in the given order."""
    numbered = running_sum(actions.withColumn("_one", F.lit(1).cast("long")), "_one", [], list(order_by), through="id")
    tool = F.coalesce(F.get_json_object("config", "$.tool"), F.lit(default_tool))
    body = F.struct(
        F.lit("2.0").alias("jsonrpc"),
        F.col("id"),
        F.lit("tools/call").alias("method"),
        F.struct(tool.alias("name"), F.try_parse_json("action_payload").alias("arguments")).alias("params"),
    )
    return numbered.withColumn("body", F.to_json(body)).drop("_one", "_before")


def approval_texts(actions: DataFrame) -> DataFrame:
    return actions.withColumn("description", describe_action(F.col("type"), F.col("action_payload")))
