"""Registered queries: aggregations, sort and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions.replies import usage_tokens
from sieveline.functions.text import with_actions
from sieveline.operators.access import audit_query
from sieveline.operators.agent_bench import bench_errors, bench_ranking, bench_samples, bench_summary, bench_winners
from sieveline.operators.metrics import (
    adapter_metrics,
    avg_latency,
    decision_log,
    events_per_second,
    filter_metrics,
    inflight,
    pipeline_totals,
    recent,
    recent_per_agent,
    response_log,
    tokens_hourly,
)
from sieveline.operators.rules import priority_predicate, rules_predicate
from sieveline.operators.stateful import token_budget
from sieveline.operators.streams import assemble_stream, last_assistant
from sieveline.plans import fixtures
from sieveline.plans.registry import EV, REPLY, query, sql_ts, ts_text
from sieveline.schema import load_events, read_table

_RULE = [{"field": "payload.type", "regex": "^(error|purchase|view)$"}]


def _decisions(spark, sf_dir):
    e = load_events(spark, sf_dir)
    return e, decision_log(e, [("content-filter", rules_predicate(_RULE)), ("priority-router", priority_predicate(2, 5, True))])


_DEC = """dec AS (SELECT event_id, 'content-filter' AS filter, kind IN ('error','purchase','view') AS passed FROM ev
  UNION ALL SELECT event_id, 'priority-router', coalesce(priority, 3) < 5 FROM ev WHERE kind IN ('error','purchase','view'))"""
_BUDGET = """spent AS (SELECT *, coalesce(sum(CASE WHEN error IS NULL THEN tokens ELSE 0 END) OVER (PARTITION BY agent_id, date_trunc('hour', ts)
    ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM reply),
  sent AS (SELECT *, max_per_hour IS NULL OR before < max_per_hour AS is_sent FROM spent)"""


def _sent(spark, sf_dir):
    r = fixtures.replies(spark, sf_dir).withColumn("cost", F.when(F.col("error").isNull(), F.col("tokens")).otherwise(F.lit(0)))
    return r.transform(token_budget(tokens="cost"))


@query(
    "pipeline_totals",
    f"""WITH {EV}, {REPLY}, {_DEC}, {_BUDGET} SELECT (SELECT count(*) FROM ev) AS events_received,
      (SELECT count(*) FROM dec WHERE NOT passed) AS events_filtered, (SELECT count(*) FROM sent WHERE is_sent AND error IS NULL) AS events_sent,
      (SELECT count(*) FROM sent WHERE NOT is_sent OR error IS NOT NULL) AS events_dropped, CAST(0 AS BIGINT) AS events_buffered,
      (SELECT CAST(sum(tokens) AS BIGINT) FROM sent WHERE is_sent AND error IS NULL) AS tokens_total""",
)
def pipeline_totals_q(spark, sf_dir):
    e, log = _decisions(spark, sf_dir)
    return pipeline_totals(e, log, _sent(spark, sf_dir))


@query(
    "adapter_metrics",
    f"""WITH {EV} SELECT source_id, count(*) AS events_produced, {sql_ts('max(ts)')} AS last_event_at,
      arg_max(CASE WHEN kind = 'error' THEN 'degraded' ELSE 'connected' END, ts) AS status FROM ev GROUP BY 1""",
)
def adapter_metrics_q(spark, sf_dir):
    e = load_events(spark, sf_dir)
    log = e.select("source_id", F.col("timestamp").alias("status_at"), F.when(F.col("event_type") == "ERROR", "degraded").otherwise("connected").alias("status"))
    return adapter_metrics(e, log).withColumn("last_event_at", ts_text("last_event_at"))


@query(
    "filter_metrics",
    f"""WITH {EV}, {_DEC} SELECT filter, count(*) AS events_in, count(*) FILTER (WHERE passed) AS events_out,
      round((count(*) - count(*) FILTER (WHERE passed)) / count(*), 9) AS drop_rate FROM dec GROUP BY 1""",
)
def filter_metrics_q(spark, sf_dir):
    return filter_metrics(_decisions(spark, sf_dir)[1]).select("filter", "events_in", "events_out", F.round("drop_rate", 9).alias("drop_rate"))


@query(
    "tokens_hourly",
    f"""WITH {EV}, {REPLY} SELECT {sql_ts("date_trunc('hour', ts - INTERVAL 17 MINUTE) + INTERVAL 17 MINUTE")} AS hour_start, CAST(sum(tokens) AS BIGINT) AS tokens FROM reply GROUP BY 1""",
)
def tokens_hourly_q(spark, sf_dir):
    return tokens_hourly(fixtures.replies(spark, sf_dir), "17 minutes").withColumn("hour_start", ts_text("hour_start"))


@query(
    "events_per_second",
    f"WITH {EV} SELECT floor(count(*) FILTER (WHERE ts > (SELECT max(ts) FROM ev) - INTERVAL 60 SECOND) / 60.0 * 100 + 0.5) / 100 AS events_per_second FROM ev",
)
def events_per_second_q(spark, sf_dir):
    return events_per_second(load_events(spark, sf_dir))


@query(
    "avg_latency_1000",
    f"WITH {EV}, {REPLY} SELECT CAST(floor(avg(latency_ms) + 0.5) AS BIGINT) AS avg_latency_ms FROM (SELECT latency_ms FROM reply ORDER BY ts DESC, event_id DESC, agent_id DESC LIMIT 1000)",
)
def avg_latency_q(spark, sf_dir):
    return avg_latency(fixtures.replies(spark, sf_dir))


_SAMPLES = """smp AS (SELECT 'bridge-' || (user_id % 5) AS bridge, event_id AS seq, floor(value * 100.0 + 0.5) / 100.0 AS latency_ms,
    CASE WHEN user_id % 5 = 4 OR event_id % 17 = 0 THEN 0 ELSE 50 + event_id % 400 END AS tokens_used,
    CASE WHEN user_id % 5 = 4 OR event_id % 17 = 0 THEN '' ELSE 'reply ' || event_id END AS content,
    CASE WHEN user_id % 5 = 4 OR event_id % 17 = 0 THEN 'bridge error ' || repeat('x', CAST(event_id % 200 AS INTEGER)) END AS error
  FROM events WHERE event_id % 4 >= 1)"""
_SUMMARY = """smm AS (SELECT bridge, count(*) AS iterations, count(error) AS errors,
    coalesce(floor(sum(latency_ms) FILTER (WHERE error IS NULL) / (count(*) - count(error)) * 100.0 + 0.5) / 100.0, 0.0) AS avg_latency_ms,
    coalesce(min(latency_ms) FILTER (WHERE error IS NULL), 0.0) AS min_latency_ms, coalesce(max(latency_ms) FILTER (WHERE error IS NULL), 0.0) AS max_latency_ms,
    coalesce(quantile_disc(latency_ms, 0.5) FILTER (WHERE error IS NULL), 0.0) AS p50_latency_ms,
    coalesce(quantile_disc(latency_ms, 0.95) FILTER (WHERE error IS NULL), 0.0) AS p95_latency_ms,
    CAST(coalesce(sum(tokens_used) FILTER (WHERE error IS NULL), 0) AS BIGINT) AS total_tokens,
    coalesce(CAST(floor(sum(tokens_used) FILTER (WHERE error IS NULL) / (count(*) - count(error)) + 0.5) AS BIGINT), 0) AS avg_tokens_per_request,
    coalesce(floor(sum(tokens_used) FILTER (WHERE error IS NULL) / (sum(latency_ms) FILTER (WHERE error IS NULL) / 1000) * 100.0 + 0.5) / 100.0, 0.0) AS tokens_per_second
  FROM smp GROUP BY 1)"""


def _samples(spark, sf_dir):
    return bench_samples(fixtures.bench_runs(spark, sf_dir), 1)


@query("bench_samples", f"WITH {_SAMPLES} SELECT bridge, seq, latency_ms, tokens_used, content, error FROM smp")
def bench_samples_q(spark, sf_dir):
    return _samples(spark, sf_dir)


@query("bench_summary", f"WITH {_SAMPLES}, {_SUMMARY} SELECT * FROM smm")
def bench_summary_q(spark, sf_dir):
    return bench_summary(_samples(spark, sf_dir))


@query(
    "bench_errors",
    f"""WITH {_SAMPLES} SELECT bridge, count(error) || '/' || count(*) || ' failed' AS failures,
      CASE WHEN length(arg_min(error, seq)) > 120 THEN substr(arg_min(error, seq), 1, 120) || '...' ELSE arg_min(error, seq) END AS first_error
      FROM smp GROUP BY 1 HAVING count(error) > 0""",
)
def bench_errors_q(spark, sf_dir):
    return bench_errors(_samples(spark, sf_dir))


@query(
    "bench_ranking",
    f"WITH {_SAMPLES}, {_SUMMARY} SELECT row_number() OVER (ORDER BY errors = iterations, avg_latency_ms, bridge) AS place, bridge, avg_latency_ms, errors FROM smm",
)
def bench_ranking_q(spark, sf_dir):
    from pyspark.sql import Window

    # One row per bridge is ranked here, never samples.
    ranked = bench_ranking(bench_summary(_samples(spark, sf_dir)))
    w = Window.orderBy((F.col("errors") == F.col("iterations")).asc(), "avg_latency_ms", "bridge")
    return ranked.select(F.row_number().over(w).cast("bigint").alias("place"), "bridge", "avg_latency_ms", "errors")


@query(
    "bench_winners",
    f"""WITH {_SAMPLES}, {_SUMMARY}, o AS (SELECT *, row_number() OVER (ORDER BY errors = iterations, avg_latency_ms, bridge) AS i, count(*) OVER () AS n FROM smm)
      SELECT a.bridge AS fastest, z.bridge AS slowest, CASE WHEN z.avg_latency_ms > 0 THEN round(z.avg_latency_ms / a.avg_latency_ms, 1) END AS speedup,
        (SELECT arg_max(bridge, tokens_per_second) FROM smm) AS highest_throughput
      FROM o a JOIN o z ON a.i = 1 AND z.i = z.n WHERE a.n > 1 AND a.avg_latency_ms > 0""",
)
def bench_winners_q(spark, sf_dir):
    return bench_winners(bench_summary(_samples(spark, sf_dir)))


@query(
    "inflight",
    f"""WITH {EV}, m AS (SELECT eid, ts AS tm, 1 AS step FROM ev UNION ALL SELECT eid, ts + to_microseconds(CAST(value * 10000000 AS BIGINT)), -1 FROM ev)
      SELECT eid, step, CAST(sum(step) OVER (ORDER BY tm, step DESC, eid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS inflight FROM m""",
)
def inflight_q(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    took = F.round(F.col("value") * 10000000).cast("bigint")
    marks = e.select(
        F.col("event_id").alias("eid"),
        F.explode(F.array(F.struct(F.col("us").alias("at"), F.lit(1).alias("step")), F.struct((F.col("us") + took).alias("at"), F.lit(-1).alias("step")))).alias("m"),
    ).select("eid", "m.at", "m.step", (-F.col("m.step")).alias("starts_first"))
    return inflight(marks, ["at", "starts_first", "eid"]).select("eid", "step", "inflight")


@query(
    "assemble_stream",
    """WITH t AS (SELECT conv_id AS response_id, string_agg(text, '' ORDER BY turn) AS content FROM conversations WHERE role <> 'system' GROUP BY 1),
      u AS (SELECT conv_id AS response_id, arg_max(length(text), turn) FILTER (WHERE role = 'assistant') AS n FROM conversations GROUP BY 1)
      SELECT response_id, md5(coalesce(content, '')) AS content, length(coalesce(content, '')) AS n_chars, CAST(coalesce(n, 0) AS BIGINT) AS tokens_used FROM u LEFT JOIN t USING (response_id)""",
)
def assemble_stream_q(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    # Every turn is a text chunk; an assistant turn is followed by a usage chunk.
    parts = F.array_compact(
        F.array(
            F.when(F.col("role") != "system", F.struct((F.col("turn") * 2).alias("seq"), F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("bigint").alias("tokens_used"))),
            F.when(F.col("role") == "assistant", F.struct((F.col("turn") * 2 + 1).alias("seq"), F.lit("usage").alias("type"), F.lit(None).cast("string").alias("text"), F.length("text").cast("bigint").alias("tokens_used"))),
            F.struct((F.col("turn") * 2 + 1).alias("seq"), F.lit("done").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("bigint").alias("tokens_used")),
        )
    )
    chunks = c.select(F.col("conv_id").alias("response_id"), F.explode(parts).alias("p")).select("response_id", "p.*")
    out = assemble_stream(chunks)
    return out.select("response_id", F.md5("content").alias("content"), F.length("content").cast("bigint").alias("n_chars"), "tokens_used")


_PROVIDERS = ["anthropic", "openai", "ollama", "langgraph", "crewai", "openclaw", "other"]


def reply_bodies(spark, sf_dir):
    n, k = F.col("event_id").cast("bigint"), F.get_json_object("raw", "$.k")
    i = (n % 7).cast("int")
    provider = F.element_at(F.array(*[F.lit(p) for p in _PROVIDERS]), i + 1)
    t = F.concat(F.lit("text "), F.col("event_id"))
    body = (
        F.when(i == 0, F.concat(F.lit('{"content":[{"text":"'), t, F.lit('"}],"usage":{"input_tokens":'), k, F.lit(',"output_tokens":7}}')))
        .when(i == 1, F.concat(F.lit('{"choices":[{"message":{"content":"'), t, F.lit('"}}],"usage":{"total_tokens":'), k, F.lit("}}")))
        .when(i == 2, F.concat(F.lit('{"message":{"content":"'), t, F.lit('"},"prompt_eval_count":'), k, F.lit("}")))
        .when(i == 3, F.concat(F.lit('{"metadata":{"tokens_used":'), k, F.lit("}}")))
        .when(i == 4, F.concat(F.lit('{"output":"'), t, F.lit('","usage":{"total_tokens":'), k, F.lit("}}")))
        .when(i == 5, F.concat(F.lit('{"text":"'), t, F.lit('","tokens_used":'), k, F.lit("}")))
        .otherwise(F.lit("{}"))
    )
    return load_events(spark, sf_dir).select("event_id", provider.alias("provider"), body.alias("body"))


@query(
    "usage_tokens",
    f"""WITH {EV} SELECT event_id, list_extract({_PROVIDERS}, CAST(eid % 7 + 1 AS INTEGER)) AS provider,
      CAST(CASE eid % 7 WHEN 0 THEN k + 7 WHEN 6 THEN 0 ELSE k END AS BIGINT) AS tokens FROM ev""",
)
def usage_tokens_q(spark, sf_dir):
    return reply_bodies(spark, sf_dir).select("event_id", "provider", usage_tokens(F.col("provider"), F.col("body")).alias("tokens"))


@query(
    "response_log",
    f"WITH {EV}, {REPLY} SELECT event_id, source_id, agent_id, tokens AS tokens_used, latency_ms, eid % 3 = 1 AS has_actions FROM reply WHERE error IS NULL",
)
def response_log_q(spark, sf_dir):
    r = fixtures.replies(spark, sf_dir)
    requests = r.select("event_id", "source_id", "agent_id")
    replies = with_actions(r.where("error IS NULL").select("event_id", "agent_id", "content", "tokens", "latency_ms"))
    return response_log(requests, replies).drop("content")


# -- sort, limit, top-k --------------------------------------------------------


@query("recent_events", f"WITH {EV} SELECT event_id, source_id, event_type, {sql_ts('ts')} AS at FROM ev ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_events(spark, sf_dir):
    return recent(load_events(spark, sf_dir), 50).select("event_id", "source_id", "event_type", ts_text("timestamp").alias("at"))


@query("recent_errors", f"WITH {EV}, {REPLY} SELECT event_id, agent_id, error FROM reply WHERE error IS NOT NULL ORDER BY ts DESC, event_id DESC, agent_id DESC LIMIT 20")
def recent_errors(spark, sf_dir):
    bad = fixtures.replies(spark, sf_dir).where("error IS NOT NULL")
    return recent(bad, 20, ("timestamp", "event_id", "agent_id")).select("event_id", "agent_id", "error")


@query(
    "recent_responses",
    f"""WITH {EV}, {REPLY}, l AS (SELECT * FROM reply WHERE error IS NULL AND agent_id = 'triage' OR error IS NULL AND agent_id = 'audit' ORDER BY ts DESC, event_id DESC, agent_id DESC LIMIT 30)
      SELECT event_id, agent_id, row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, event_id DESC) AS panel_pos FROM l""",
)
def recent_responses(spark, sf_dir):
    good = fixtures.replies(spark, sf_dir).where("error IS NULL")
    return recent_per_agent(good, 30).select("event_id", "agent_id", "panel_pos")


_AUDIT = """log AS (SELECT o_orderkey AS seq, strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') AS timestamp, 'user-' || o_custkey AS actor, o_orderstatus AS action,
  o_orderpriority AS resource, 'tenant-' || (o_custkey % 7) AS tenant_id, CASE WHEN o_orderkey % 10 = 0 THEN 'denied' ELSE 'success' END AS result FROM orders)"""


@query(
    "audit_query",
    f"""WITH {_AUDIT} SELECT seq, actor, timestamp FROM log WHERE action = 'O' AND tenant_id = 'tenant-3' AND result = 'success'
      AND timestamp >= '1996-01-01T00:00:00.000Z' AND timestamp <= '1999-12-31T00:00:00.000Z' ORDER BY seq DESC LIMIT 100""",
)
def audit_query_q(spark, sf_dir):
    out = audit_query(
        fixtures.audit_log(spark, sf_dir),
        {"action": "O", "tenant_id": "tenant-3", "result": "success"},
        "1996-01-01T00:00:00.000Z",
        "1999-12-31T00:00:00.000Z",
    )
    return out.select("seq", "actor", "timestamp")


@query(
    "audit_cap",
    f"WITH {_AUDIT}, newest AS (SELECT * FROM log ORDER BY seq DESC LIMIT 10000) SELECT seq, actor, resource FROM newest WHERE result = 'denied' ORDER BY seq DESC LIMIT 2000",
)
def audit_cap(spark, sf_dir):
    out = audit_query(fixtures.audit_log(spark, sf_dir), {"result": "denied"}, limit=2000, newest=10_000)
    return out.select("seq", "actor", "resource")


@query(
    "last_assistant",
    """SELECT conv_id, md5(coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant'),
      '{"role":"' || arg_max(role, turn) || '"}')) AS content FROM conversations GROUP BY 1""",
)
def last_assistant_q(spark, sf_dir):
    out = last_assistant(read_table(spark, sf_dir, "conversations"))
    shown = F.when(F.col("content").startswith('{"role":"'), F.concat(F.lit('{"role":"'), F.get_json_object("content", "$.role"), F.lit('"}'))).otherwise(F.col("content"))
    return out.select("conv_id", F.md5(shown).alias("content"))
