"""Registered queries: user extensions, specifications, streaming twins."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.routing import on_error, retried
from sieveline.operators.rules import project_for_agent, row_predicate_filter
from sieveline.operators.scoring import offline_scorer, record_scorer, score
from sieveline.operators.stateful import summarize_batches
from sieveline.plans import fixtures
from sieveline.plans.live import start_spec
from sieveline.plans import q_aggregates  # noqa: F401 - its SQL twins are shared
from sieveline.plans.q_functions import suggestions_present
from sieveline.plans.q_sources import _ACTIONS
from sieveline.plans.q_stateful import _ADAPT, _RATE, _flushes, _greedy, _jump
from sieveline.plans.registry import EV, ORACLES, REPLY, query, sql_ts, ts_text
from sieveline.plans.spec import compile_spec
from sieveline.schema import canonical_events, load_events, read_table
from sieveline.session import checkpoint_root, scratch_path
from sieveline.sources.polling import EventFeed, SourceRegistry
from sieveline.sources.tail import tail_lines
from sieveline.streaming.batches import batch_events_stream
from sieveline.streaming.documents import new_suggestions_stream
from sieveline.streaming.replies import assemble_live
from sieveline.streaming.sinks import run_actions, write_outbox
from sieveline.streaming.stateful import (
    adaptive_sample_stream,
    approval_stream,
    batch_members_stream,
    dedup_stream,
    rate_limit_stream,
    window_summary_stream,
)


@query("udf_filter", f"WITH {EV} SELECT event_id, source_id FROM ev WHERE (k + user_id) % 3 = 0")
def udf_filter(spark, sf_dir):
    def predicate(k: pd.Series, user: pd.Series) -> pd.Series:
        return (k + user) % 3 == 0

    e = load_events(spark, sf_dir).withColumns(
        {"k": F.get_json_object("raw", "$.k").cast("long"), "user": F.get_json_object("payload", "$.user_id").cast("long")}
    )
    return e.transform(row_predicate_filter(predicate, ["k", "user"])).select("event_id", "source_id")


@query("udf_source", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS type FROM events")
def udf_source(spark, sf_dir):
    registry = SourceRegistry()
    registry.register(EventFeed, "event texts, page by page", ["example"])
    registry.install(spark)
    text = F.to_json(F.struct("event_id", F.col("event_type").alias("type")))
    pages = read_table(spark, sf_dir, "events").select((F.col("event_id") % 16).cast("int").alias("page"), text.alias("value"))
    path = fixtures.land_pages(pages, scratch_path(spark, "pages"))
    raw = spark.read.format("event-feed").option("path", path).option("step", 2).load()
    return raw.select(F.get_json_object("value", "$.event_id").alias("event_id"), F.get_json_object("value", "$.type").alias("type"))


@query(
    "udf_scorer",
    f"""WITH {EV}, {REPLY} SELECT event_id, agent_id, CASE WHEN eid % 17 > 0 THEN 'Noted ' || event_id || '.' END AS content,
      eid % 17 > 0 AS has_tokens, CASE WHEN eid % 17 = 0 THEN 'agent is down for ' || event_id END AS failure FROM reply""",
)
def udf_scorer(spark, sf_dir):
    requests = fixtures.replies(spark, sf_dir).withColumn("prompt", project_for_agent()).select("event_id", "agent_id", "prompt")

    @record_scorer
    def failing(request: dict) -> dict:
        if int(request["event_id"]) % 17 == 0:
            raise RuntimeError(f"agent is down for {request['event_id']}")
        return offline_scorer.one(request)

    out = score(requests, failing)
    return out.select("event_id", "agent_id", "content", (F.col("tokens") > 20).alias("has_tokens"), F.col("error").alias("failure"))


@query(
    "udf_action",
    f"""WITH {EV}, {REPLY}, {_ACTIONS} SELECT event_id, agent_id, type, type <> 'fax' AND NOT (type = 'page' AND eid % 2 = 0) AS success,
      CASE WHEN type = 'webhook' THEN 'hook {{"id":' || event_id || '}}' WHEN type = 'page' AND eid % 2 = 1 THEN 'paged' END AS response,
      CASE WHEN type = 'fax' THEN 'no handler for action type ''fax''' WHEN type = 'page' AND eid % 2 = 0 THEN 'pager is down' END AS action_error FROM act""",
)
def udf_action(spark, sf_dir):
    from sieveline.functions.text import explode_actions

    def page(request):
        if int(request["event_id"]) % 2 == 0:
            raise RuntimeError("pager is down")
        return "paged"

    actions = explode_actions(fixtures.replies(spark, sf_dir)).select("event_id", "agent_id", "type", "action_payload")
    out = run_actions(actions, {"webhook": lambda r: "hook " + r["action_payload"], "page": page})
    return out.select("event_id", "agent_id", "type", "success", "response", "action_error")


@query(
    "udf_metrics",
    f"WITH {EV} SELECT count(*) AS events, count(*) FILTER (WHERE priority <= 2) AS urgent, {sql_ts('max(ts)')} AS last_event_at FROM ev",
)
def udf_metrics(spark, sf_dir):
    from pyspark.sql import Observation

    seen = Observation("passed")
    e = load_events(spark, sf_dir).observe(
        seen, F.count("*").alias("events"), F.count_if(F.col("priority") <= 2).alias("urgent"), F.max("timestamp").alias("last_event_at")
    )
    e.write.format("noop").mode("overwrite").save()
    m = seen.get
    return spark.range(1).select(
        F.lit(m["events"]).cast("bigint").alias("events"), F.lit(m["urgent"]).cast("bigint").alias("urgent"), ts_text(F.lit(m["last_event_at"])).alias("last_event_at")
    )


_SPEC = {
    "sources": [{"id": "feed", "adapter": "kafka"}],
    "filters": [
        {"type": "content-filter", "mode": "any", "rules": [{"field": "payload.type", "match": "error"}, {"field": "priority", "in": [2, 3]}]},
        {"type": "dedup", "window_seconds": 7200, "key_fields": ["source_id", "payload.type"]},
        {"type": "priority-router", "drop_low_priority": True, "low_priority_threshold": 4},
    ],
    "agents": [
        {"id": "triage", "runtime": "direct-llm", "model": "a/b", "system_prompt": "Look.", "token_budget": {"max_per_hour": 1000}},
        {"runtime": "direct-llm", "model": "c", "system_prompt": "Check.", "sources": ["src-1", "src-2"], "actions": [{"type": "webhook"}]},
    ],
}


@record_scorer
def spec_scorer(request: dict) -> dict:
    n = int(request["event_id"])
    return {"content": "ok", "tokens": 50 + n % 400, "latency_ms": 1.0, "error": None if n % 17 else "timeout"}


_SPEC_SQL = f"""WITH RECURSIVE {EV}, c AS (SELECT * FROM ev WHERE kind IN ('error', 'purchase', 'click')), {_jump('source_id || kind', '7200 SECOND', 'c')},
      d AS (SELECT k.* FROM k JOIN acc USING (key, ts)),
      r AS (SELECT d.*, a.agent_id, CASE WHEN eid % 17 = 0 THEN 0 ELSE 50 + eid % 400 END AS cost FROM d JOIN (VALUES ('triage', NULL), ('agent-1', 'src-1'), ('agent-1', 'src-2')) a(agent_id, src) ON a.src IS NULL OR a.src = d.source_id),
      b AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY agent_id, date_trunc('hour', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
      SELECT event_id, agent_id, CAST(CASE WHEN eid % 17 = 0 THEN 50 + eid % 400 ELSE cost END AS BIGINT) AS tokens, eid % 17 = 0 AS is_failed FROM b WHERE agent_id <> 'triage' OR before < 1000"""


@query("spec_compile", _SPEC_SQL)
def spec_compile(spark, sf_dir):
    out = compile_spec({**_SPEC, "behavior": {"on_llm_unreachable": "passthrough"}}).run({"feed": load_events(spark, sf_dir)}, spec_scorer)
    return out["passed"].select("event_id", "agent_id", "tokens", F.col("error").isNotNull().alias("is_failed"))


@query("failure_policies", f"""WITH {EV}, {REPLY} SELECT 'drop_and_alert' AS policy, event_id, agent_id, 'passed' AS part FROM reply WHERE error IS NULL
  UNION ALL SELECT 'drop_and_alert', event_id, NULL, 'alerts' FROM reply, range(2) WHERE error IS NOT NULL
  UNION ALL SELECT 'buffer_limited', event_id, agent_id, CASE WHEN error IS NULL THEN 'passed' WHEN i > 40 THEN 'overflow' WHEN eid % 34 = 0 THEN 'given_up' ELSE 'retried' END
    FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, error IS NULL ORDER BY ts, event_id) AS i FROM reply)
  UNION ALL SELECT 'passthrough', event_id, agent_id, 'passed' FROM reply""")
def failure_policies(spark, sf_dir):
    replies = fixtures.replies(spark, sf_dir)
    rows = []
    for policy in ("drop_and_alert", "passthrough"):
        for part, df in on_error(replies, policy, fixtures.HANDLERS).items():
            ids = F.col("dropped_event_id" if part == "alerts" else "event_id").alias("event_id")
            agent = F.lit(None).cast("string") if part == "alerts" else F.col("agent_id")
            rows.append(df.select(F.lit(policy).alias("policy"), ids, agent.alias("agent_id"), F.lit(part).alias("part")))

    def ask(requests):
        # An agent that is down at the first try is up again at the second, but for every other of these events.
        first = F.col("attempt") == 0
        still = F.when(F.col("event_id").cast("bigint") % 34 == 0, "still down")
        return requests.withColumn("error", F.when(first, F.col("failure")).otherwise(still))

    parts = retried(replies.withColumnRenamed("error", "failure"), ask, limit=40, max_attempts=2)
    for part, df in parts.items():
        name = F.when(F.col("attempt") > 0, "retried").otherwise("passed") if part == "passed" else F.lit(part)
        rows.append(df.select(F.lit("buffer_limited").alias("policy"), "event_id", "agent_id", name.alias("part")))
    return reduce(DataFrame.unionByName, rows)


# -- streaming twins -------------------------------------------------------------


def stream_events(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return canonical_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def drain(spark, stream, name):
    """Run a stream over all there is and return the table it wrote."""
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    started = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(
    "stream_dedup",
    f"WITH RECURSIVE {EV}, {_jump('user_id || kind', '24 HOUR')} SELECT k.event_id, k.source_id FROM k JOIN acc USING (key, ts)",
)
def stream_dedup(spark, sf_dir):
    s = stream_events(spark, sf_dir).transform(dedup_stream(["payload.user_id", "payload.type"], 86_400))
    return drain(spark, s, "dedup").select("event_id", "source_id")


@query("stream_rate_limit", f"WITH RECURSIVE {EV}, {_greedy('source_id', 3600, 2)} SELECT event_id FROM g WHERE ok")
def stream_rate_limit(spark, sf_dir):
    s = stream_events(spark, sf_dir).transform(rate_limit_stream(2, 3600, ["source_id"]))
    return drain(spark, s, "limit").select("event_id")


@query(
    "stream_sample",
    f"""WITH RECURSIVE {EV}, {_RATE} SELECT ev.event_id FROM ev JOIN rec USING (event_id)
      WHERE coalesce(priority <= 2, false) OR CAST(concat('0x', substr(md5(ev.event_id), 1, 8)) AS BIGINT) / 4294967296.0 < rate""",
)
def stream_sample(spark, sf_dir):
    s = stream_events(spark, sf_dir).transform(adaptive_sample_stream(**_ADAPT))
    return drain(spark, s, "sample").select("event_id")


@query("stream_approvals", f"WITH {EV} SELECT event_id AS request_id FROM ev WHERE eid % 6 = 1 AND k * 2 <= 60")
def stream_approvals(spark, sf_dir):
    """Requests that are approved by then; denials wait for the watermark."""
    e = stream_events(spark, sf_dir)
    m = F.col("event_id").cast("bigint") % 6
    wait = F.get_json_object("raw", "$.k").cast("int") * 2
    requests = e.select(F.col("event_id").alias("request_id"), F.col("timestamp").alias("request_ts"))
    replies = stream_events(spark, sf_dir).where(m != 0).select(
        F.col("event_id").alias("request_id"),
        (F.col("timestamp") + F.make_dt_interval(secs=wait)).alias("reply_ts"),
        F.when(m == 4, 503).otherwise(200).alias("status"),
        F.when(m.isin(1, 4), '{"approved":true}').when(m == 2, '{"approved":"true"}').otherwise("oops").alias("body"),
    )
    return drain(spark, approval_stream(requests, replies), "approvals").where("is_approved").select("request_id")


@query("stream_spec", _SPEC_SQL)
def stream_spec(spark, sf_dir):
    """The specification of ``spec_compile``, run live over the stream of the table."""
    plan = compile_spec({**_SPEC, "behavior": {"on_llm_unreachable": "passthrough"}})
    out, checkpoint = scratch_path(spark, "live"), scratch_path(spark, "live-checkpoint")
    start_spec(plan, spark, out, checkpoint, {"feed": stream_events(spark, sf_dir)}, spec_scorer).awaitTermination()
    return spark.read.parquet(f"{out}/replies").where("is_sent").select("event_id", "agent_id", "tokens", F.col("error").isNotNull().alias("is_failed"))


@query(
    "stream_batches",
    f"""WITH RECURSIVE {EV}, {_flushes('source_id', '6 HOUR', 10)} SELECT key AS batch_source, CAST(batch_no AS BIGINT) AS batch_no, count(*) AS batch_size,
      string_agg(event_id, ',' ORDER BY ts, eid) AS ids FROM m GROUP BY 1, 2""",
)
def stream_batches(spark, sf_dir):
    s = stream_events(spark, sf_dir).transform(batch_members_stream(21_600, 10, ["source_id"]))
    batches = summarize_batches(drain(spark, s, "batches"), ["source_id", "batch_no"])
    ids = F.array_join(F.transform("events", lambda e: e["event_id"]), ",")
    return batches.select("batch_source", "batch_no", "batch_size", ids.alias("ids"))


@query(
    "stream_windows",
    f"""WITH {EV}, w AS (SELECT source_id, time_bucket(INTERVAL 6 HOUR, ts) AS w, count(*) AS n, min(coalesce(priority, 3)) AS p FROM ev GROUP BY 1, 2)
      SELECT source_id, {sql_ts('w')} AS window_start, n AS batch_size, p AS priority FROM w WHERE w + INTERVAL 6 HOUR <= (SELECT max(ts) FROM ev) - INTERVAL 1 MINUTE""",
)
def stream_windows(spark, sf_dir):
    # Windows the watermark has passed; the open ones stay in the state.
    s = stream_events(spark, sf_dir).transform(window_summary_stream("6 hours"))
    return drain(spark, s, "windows").select("source_id", ts_text("window_start").alias("window_start"), "batch_size", "priority")


@query(
    "stream_batch_events",
    f"""WITH RECURSIVE {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts, event_id) AS i FROM ev),
    m(source_id, i, event_id, priority, ts, opened, no, n) AS (
      SELECT source_id, i, event_id, priority, ts, ts, CAST(0 AS BIGINT), 1 FROM o WHERE i = 1
      UNION ALL SELECT o.source_id, o.i, o.event_id, o.priority, o.ts, CASE WHEN m.n < 10 AND o.ts < m.opened + INTERVAL 6 HOUR THEN m.opened ELSE o.ts END,
        CASE WHEN m.n < 10 AND o.ts < m.opened + INTERVAL 6 HOUR THEN m.no ELSE m.no + 1 END,
        CASE WHEN m.n < 10 AND o.ts < m.opened + INTERVAL 6 HOUR THEN m.n + 1 ELSE 1 END
      FROM m JOIN o ON o.source_id = m.source_id AND o.i = m.i + 1),
    b AS (SELECT source_id, no, count(*) AS batch_size, min(coalesce(priority, 3)) AS priority, string_agg(event_id, ',' ORDER BY i) AS ids,
        min(opened) + INTERVAL 6 HOUR AS closes, max(ts) AS last_ts FROM m GROUP BY 1, 2)
    SELECT source_id AS batch_source, batch_size, priority, ids, {sql_ts('last_ts')} AS at FROM b
    WHERE closes <= (SELECT max(ts) FROM ev) - INTERVAL 1 MINUTE OR (batch_size = 10 AND last_ts <= (SELECT max(ts) FROM ev) - INTERVAL 1 MINUTE)""",
)
def stream_batch_events(spark, sf_dir):
    """Batches with their members that the watermark has closed; open ones stay in the state."""
    s = stream_events(spark, sf_dir).transform(batch_events_stream(["source_id"], 21_600, 10, mode="ordered"))
    found = drain(spark, s, "batch-events")
    ids = F.from_json("payload", "events array<struct<event_id:string>>")["events"]["event_id"]
    return found.select(
        F.get_json_object("metadata", "$.source_ids[0]").alias("batch_source"), F.get_json_object("payload", "$.batch_size").cast("long").alias("batch_size"),
        "priority", F.array_join(ids, ",").alias("ids"), ts_text("timestamp").alias("at"),
    )


@query("stream_doc_suggestions", ORACLES["src_doc_new_suggestions"])
def stream_doc_suggestions(spark, sf_dir):
    """Changes found poll by poll in a stream of snapshots, one micro-batch a year."""
    polls = read_table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("doc-"), (F.col("l_suppkey") % 90).cast("string")).alias("doc_id"), F.year("l_shipdate").alias("poll")
    ).distinct()
    ids = suggestions_present(spark, sf_dir).groupBy("doc_id", "poll").agg(F.collect_set("suggestion_id").alias("suggestion_ids"))
    table, path = polls.join(ids, ["doc_id", "poll"], "left"), scratch_path(spark, "snapshots")
    checkpoint_root(spark)
    table = table.checkpoint()
    first, last = table.agg(F.min("poll"), F.max("poll")).first()
    for year in range(first, last + 1):
        table.where(F.col("poll") == year).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = drain(spark, new_suggestions_stream(stream), "new-suggestions")
    return found.select("doc_id", F.col("poll").cast("int").alias("poll"), "suggestion_id")


@query("stream_assemble", ORACLES["assemble_stream"])
def stream_assemble(spark, sf_dir):
    """Replies from chunks that come in three micro-batches, out of order."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    c = read_table(spark, sf_dir, "conversations").withColumns({"n": F.row_number().over(order) - 1, "is_last": F.lead("turn").over(order).isNull()})
    n = F.col("n")
    chunk = lambda seq, kind, text, tokens: F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("type"), text.alias("text"), tokens.cast("long").alias("tokens_used"))
    nothing, none = F.lit(None).cast("string"), F.lit(None).cast("long")
    said = F.when(F.col("role") != "system", F.col("text")).otherwise(F.lit(""))
    parts = F.array_compact(
        F.array(
            chunk(2 * n, "text", said, none),
            chunk(2 * n + 1, "usage", nothing, F.when(F.col("role") == "assistant", F.length("text"))),
            F.when(F.col("is_last"), chunk(2 * n + 2, "done", nothing, none)),
        )
    )
    chunks = c.select(F.col("conv_id").alias("response_id"), F.explode(parts).alias("p")).select("response_id", "p.*")
    path = scratch_path(spark, "chunks")
    for k in (2, 0, 1):
        chunks.where(F.pmod(F.xxhash64("response_id", "seq"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = drain(spark, assemble_live(stream), "replies-live")
    return found.select(F.col("response_id").cast("long").alias("response_id"), F.md5("content").alias("content"), F.length("content").cast("bigint").alias("n_chars"), "tokens_used")


def tail_rounds(spark, sf_dir, path, run):
    """Lines of the events in four rounds, each followed by a run: there before, added, the last line ended and more, cut off and new."""
    line = F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))
    lines = read_table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("bucket"), line.alias("value"))
    for k, how in enumerate([{}, {"end": ""}, {"lead": "\n"}, {"cut": True}]):
        fixtures.append_lines(lines.where(F.col("event_id") % 4 == k).drop("event_id"), path, **how)
        run()


@query("stream_tail", "SELECT event_type || ' ' || event_id AS line FROM events WHERE event_id % 4 > 0")
def stream_tail(spark, sf_dir):
    """Log files that grow between triggers and are cut off once; what stood there before is left out."""
    path, out, checkpoint = (scratch_path(spark, n) for n in ("logs", "tail", "tail-checkpoint"))

    def run():
        lines = tail_lines(spark, path, block_bytes=20_000)
        lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    tail_rounds(spark, sf_dir, path, run)
    return spark.read.parquet(out).select(F.col("value").alias("line"))


@query(
    "stream_outbox",
    f"WITH {EV}, {REPLY}, {_ACTIONS} SELECT event_id, agent_id, type, CASE type WHEN 'webhook' THEN 'hook-new' WHEN 'page' THEN 'pager' END AS handler FROM act",
)
def stream_outbox(spark, sf_dir):
    table = scratch_path(spark, "replies")
    fixtures.replies(spark, sf_dir).select("event_id", "agent_id", "content").write.parquet(table)
    stream = spark.readStream.schema("event_id string, agent_id string, content string").parquet(table)
    path = scratch_path(spark, "outbox")
    write_outbox(stream, fixtures.HANDLERS, path, scratch_path(spark, "outbox-checkpoint")).awaitTermination()
    return spark.read.parquet(path).select("event_id", "agent_id", "type", "handler")
