"""Registered queries: stateful filters, windows, batches, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.operators.rules import priority_predicate
from sieveline.operators.stateful import (
    adaptive_rate,
    adaptive_sample,
    batch_arrival,
    batch_tumbling,
    dedup_window,
    rate_limit_sliding,
    rate_limit_tumbling,
    token_budget,
    velocity,
)
from sieveline.plans.q_aggregates import _BUDGET, _sent
from sieveline.plans.registry import EV, REPLY, query, sql_ts, ts_text
from sieveline.schema import load_events


def _jump(key: str, interval: str, rel: str = "ev") -> str:
    """Accept chain of windowed dedup: jump to the first event a window later."""
    return f"""k AS (SELECT *, {key} AS key FROM {rel}), acc AS (
      SELECT key, min(ts) AS ts FROM k GROUP BY key UNION ALL
      SELECT a.key, (SELECT min(k.ts) FROM k WHERE k.key = a.key AND k.ts >= a.ts + INTERVAL {interval}) FROM acc a WHERE a.ts IS NOT NULL)"""


@query(
    "dedup_window",
    f"WITH RECURSIVE {EV}, {_jump('user_id || kind', '24 HOUR')} SELECT k.event_id, k.source_id, k.kind FROM k JOIN acc USING (key, ts)",
)
def dedup_window_q(spark, sf_dir):
    out = load_events(spark, sf_dir).transform(dedup_window(["payload.user_id", "payload.type"], 86_400))
    return out.select("event_id", "source_id", F.get_json_object("payload", "$.type").alias("kind"))


@query(
    "dedup_window_hot_key",
    f"WITH RECURSIVE {EV}, {_jump('0', '10 MINUTE')} SELECT k.event_id, k.source_id FROM k JOIN acc USING (key, ts)",
)
def dedup_window_hot_key(spark, sf_dir):
    # A key field no event has: all of them share the key ''.
    return load_events(spark, sf_dir).transform(dedup_window(["payload.absent"], 600)).select("event_id", "source_id")


def _greedy(key: str, seconds: int, limit: int) -> str:
    """Sliding limit row by row within gap islands (a full gap leaves no state)."""
    return f"""o AS (SELECT *, {key} AS key, CASE WHEN ts - lag(ts) OVER (PARTITION BY {key} ORDER BY ts, eid) < INTERVAL {seconds} SECOND THEN 0 ELSE 1 END AS gap FROM ev),
    i AS (SELECT *, sum(gap) OVER (PARTITION BY key ORDER BY ts, eid ROWS UNBOUNDED PRECEDING) AS island FROM o),
    r AS (SELECT *, row_number() OVER (PARTITION BY key, island ORDER BY ts, eid) AS rn FROM i),
    g AS (SELECT key, island, rn, event_id, [ts] AS kept, true AS ok FROM r WHERE rn = 1
      UNION ALL
      SELECT r.key, r.island, r.rn, r.event_id,
        CASE WHEN len(list_filter(g.kept, lambda x: x > r.ts - INTERVAL {seconds} SECOND)) < {limit}
          THEN list_append(list_filter(g.kept, lambda x: x > r.ts - INTERVAL {seconds} SECOND), r.ts) ELSE g.kept END,
        len(list_filter(g.kept, lambda x: x > r.ts - INTERVAL {seconds} SECOND)) < {limit}
      FROM g JOIN r ON r.key = g.key AND r.island = g.island AND r.rn = g.rn + 1)"""


@query("rate_limit_sliding", f"WITH RECURSIVE {EV}, {_greedy('0', 600, 2)} SELECT event_id, ok AS is_passed FROM g")
def rate_limit_sliding_q(spark, sf_dir):
    out = load_events(spark, sf_dir).transform(rate_limit_sliding(2, 600, flag="is_passed"))
    return out.select("event_id", "is_passed")


@query("rate_limit_sliding_keyed", f"WITH RECURSIVE {EV}, {_greedy('source_id', 3600, 2)} SELECT event_id, ok AS is_passed FROM g")
def rate_limit_sliding_keyed(spark, sf_dir):
    out = load_events(spark, sf_dir).transform(rate_limit_sliding(2, 3600, ["source_id"], flag="is_passed"))
    return out.select("event_id", "is_passed")


@query(
    "rate_limit_tumbling",
    f"""WITH {EV} SELECT event_id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id, date_trunc('hour', ts) ORDER BY ts, eid) AS rn FROM ev) WHERE rn <= 2""",
)
def rate_limit_tumbling_q(spark, sf_dir):
    return load_events(spark, sf_dir).transform(rate_limit_tumbling(2, "1 hour", ["source_id"])).select("event_id", "source_id")


@query(
    "velocity",
    f"""WITH {EV} SELECT event_id, round(count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) / 3600.0, 12) AS velocity FROM ev""",
)
def velocity_q(spark, sf_dir):
    return load_events(spark, sf_dir).transform(velocity(3600)).select("event_id", F.round("velocity", 12).alias("velocity"))


@query(
    "velocity_keyed",
    f"""WITH {EV} SELECT event_id, round(count(*) OVER (PARTITION BY source_id ORDER BY ts RANGE BETWEEN INTERVAL 21600 SECOND PRECEDING AND CURRENT ROW) / 21600.0, 12) AS velocity FROM ev""",
)
def velocity_keyed(spark, sf_dir):
    return load_events(spark, sf_dir).transform(velocity(21_600, ["source_id"])).select("event_id", F.round("velocity", 12).alias("velocity"))


_RATE = """v AS (SELECT *, count(*) OVER (PARTITION BY source_id ORDER BY ts RANGE BETWEEN INTERVAL 21600 SECOND PRECEDING AND CURRENT ROW) AS n,
    row_number() OVER (PARTITION BY source_id ORDER BY ts, eid) AS rn FROM ev),
  rec AS (SELECT source_id, rn, event_id, CAST(CASE WHEN n > 11 THEN greatest(0.1, 0.5 * 0.8) WHEN n < 7 THEN least(1.0, 0.5 * 1.2) ELSE 0.5 END AS DOUBLE) AS rate FROM v WHERE rn = 1
    UNION ALL SELECT v.source_id, v.rn, v.event_id, CASE WHEN v.n > 11 THEN greatest(0.1::DOUBLE, rec.rate * 0.8::DOUBLE)
      WHEN v.n < 7 THEN least(1.0::DOUBLE, rec.rate * 1.2::DOUBLE) ELSE rec.rate END
    FROM rec JOIN v ON v.source_id = rec.source_id AND v.rn = rec.rn + 1)"""
_ADAPT = dict(
    base_rate=0.5, min_rate=0.1, max_rate=1.0, window_seconds=21_600, high_velocity=11.5 / 21_600, low_velocity=6.5 / 21_600,
    partition_by=["source_id"],
)


@query("adaptive_rate", f"WITH RECURSIVE {EV}, {_RATE} SELECT event_id, source_id, round(rate, 9) AS sample_rate FROM rec")
def adaptive_rate_q(spark, sf_dir):
    out = load_events(spark, sf_dir).transform(adaptive_rate(**_ADAPT))
    return out.select("event_id", "source_id", F.round("sample_rate", 9).alias("sample_rate"))


@query(
    "adaptive_sample",
    f"""WITH RECURSIVE {EV}, {_RATE} SELECT ev.event_id, event_type FROM ev JOIN rec USING (event_id)
      WHERE coalesce(priority <= 2, false) OR CAST(concat('0x', substr(md5(ev.event_id), 1, 8)) AS BIGINT) / 4294967296.0 < rate""",
)
def adaptive_sample_q(spark, sf_dir):
    return load_events(spark, sf_dir).transform(adaptive_sample(**_ADAPT)).select("event_id", "event_type")


@query(
    "adaptive_rate_global",
    f"""WITH {EV}, v AS (SELECT event_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS n,
      row_number() OVER (ORDER BY ts, event_id) AS rn FROM ev),
    rates AS (SELECT list_reduce(list([CAST(n AS DOUBLE)] ORDER BY rn), lambda a, x: list_append(a, CASE WHEN x[1] > 18 THEN greatest(0.1::DOUBLE, a[len(a)] * 0.8::DOUBLE)
      WHEN x[1] < 10 THEN least(1.0::DOUBLE, a[len(a)] * 1.2::DOUBLE) ELSE a[len(a)] END), [0.5::DOUBLE]) AS r FROM v)
    SELECT event_id, round(r[rn + 1], 9) AS sample_rate FROM v, rates""",
)
def adaptive_rate_global(spark, sf_dir):
    # One rate for all sources: every row depends on the one before.
    config = {**_ADAPT, "partition_by": [], "window_seconds": 3600, "high_velocity": 18 / 3600, "low_velocity": 10 / 3600}
    out = load_events(spark, sf_dir).transform(adaptive_rate(**config))
    return out.select("event_id", F.round("sample_rate", 9).alias("sample_rate"))


@query(
    "token_budget",
    f"WITH {EV}, {REPLY}, {_BUDGET} SELECT event_id, agent_id, CAST(before AS BIGINT) AS tokens_before, is_sent FROM sent",
)
def token_budget_q(spark, sf_dir):
    return _sent(spark, sf_dir).select("event_id", "agent_id", "tokens_before", "is_sent")


@query(
    "token_budget_exact_hours",
    f"""WITH RECURSIVE {EV}, {REPLY}, {_jump('0', '3600 SECOND')}, h AS (SELECT ts AS start FROM acc WHERE ts IS NOT NULL),
      t AS (SELECT r.*, h.start FROM reply r ASOF JOIN h ON r.ts >= h.start),
      s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY agent_id, start ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
      SELECT event_id, agent_id, CAST(before AS BIGINT) AS tokens_before, max_per_hour IS NULL OR before < max_per_hour AS is_sent FROM s""",
)
def token_budget_exact_hours(spark, sf_dir):
    from sieveline.plans import fixtures

    r = fixtures.replies(spark, sf_dir)
    return r.transform(token_budget(exact_hours=True)).select("event_id", "agent_id", "tokens_before", "is_sent")


def _flushes(key: str, window: str, limit: int) -> str:
    """Flush events of count-or-time batching, one jump per batch and key."""
    return f"""k AS (SELECT *, {key} AS key, row_number() OVER (PARTITION BY {key} ORDER BY ts, eid) AS rn FROM ev),
    f AS (SELECT key, 0 AS no, CAST(0 AS BIGINT) AS rn, min(ts) AS start FROM k GROUP BY key
      UNION ALL SELECT k.key, f.no + 1, k.rn, k.ts FROM f JOIN k ON k.key = f.key AND k.rn = least(f.rn + {limit},
        coalesce((SELECT min(x.rn) FROM k x WHERE x.key = f.key AND x.rn > f.rn AND x.ts >= f.start + INTERVAL {window}), f.rn + {limit}))),
    m AS (SELECT k.*, coalesce((SELECT max(f.no) FROM f WHERE f.key = k.key AND f.rn < k.rn), 0) AS batch_no FROM k)"""


@query(
    "batch_arrival",
    f"""WITH RECURSIVE {EV}, {_flushes('0', '6 HOUR', 60)} SELECT CAST(batch_no AS BIGINT) AS batch_no, count(*) AS batch_size, min(coalesce(priority, 3)) AS priority,
      string_agg(event_id, ',' ORDER BY ts, eid) AS ids FROM m GROUP BY 1""",
)
def batch_arrival_q(spark, sf_dir):
    out = load_events(spark, sf_dir).transform(batch_arrival(window_seconds=21_600, max_batch_size=60))
    ids = F.array_join(F.transform("events", lambda e: e["event_id"]), ",")
    return out.select("batch_no", "batch_size", "priority", ids.alias("ids"))


@query(
    "flush_on_end",
    f"""WITH RECURSIVE {EV}, {_flushes('source_id', '6 HOUR', 10)} SELECT key AS batch_source, count(*) AS batch_size, string_agg(event_id, ',' ORDER BY ts, eid) AS ids
      FROM m WHERE rn > (SELECT max(f.rn) FROM f WHERE f.key = m.key) GROUP BY 1 HAVING min(coalesce(priority, 3)) < 5""",
)
def flush_on_end(spark, sf_dir):
    batches = load_events(spark, sf_dir).transform(batch_arrival(["source_id"], window_seconds=21_600, max_batch_size=10))
    held = batches.where("is_held").where(priority_predicate(2, 5, True))
    ids = F.array_join(F.transform("events", lambda e: e["event_id"]), ",")
    return held.select("batch_source", "batch_size", ids.alias("ids"))


@query(
    "batch_tumbling",
    f"""WITH {EV}, n AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS w, row_number() OVER (PARTITION BY source_id, time_bucket(INTERVAL 6 HOUR, ts) ORDER BY ts, event_id) - 1 AS rn FROM ev)
      SELECT source_id AS batch_source, {sql_ts('w')} AS window_start, rn // 10 AS chunk, count(*) AS batch_size, min(coalesce(priority, 3)) AS priority,
        string_agg(event_id, ',' ORDER BY ts, event_id) AS ids, source_id AS source_ids FROM n GROUP BY ALL""",
)
def batch_tumbling_q(spark, sf_dir):
    out = load_events(spark, sf_dir).transform(batch_tumbling("6 hours", 10, ["source_id"]))
    ids = F.array_join(F.transform("events", lambda e: e["event_id"]), ",")
    return out.select(
        "batch_source", ts_text("window_start").alias("window_start"), "chunk", "batch_size", "priority", ids.alias("ids"),
        F.array_join("source_ids", ",").alias("source_ids"),
    )
