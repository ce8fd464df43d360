"""The flagship chain: rules, dedup, priorities, rate limit, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.rules import content_filter, filter_chain, priority_router
from sieveline.operators.stateful import batch_tumbling, dedup_window, rate_limit_tumbling
from sieveline.plans.registry import EV, query, sql_ts, ts_text
from sieveline.plans.q_stateful import _jump
from sieveline.schema import load_events


def triage(events: DataFrame) -> DataFrame:
    chain = filter_chain(
        [
            content_filter(
                [
                    {"field": "payload.type", "regex": "^(error|purchase|click|view)$"},
                    {"field": "source_id", "in": [f"src-{i}" for i in range(9)]},
                ]
            ),
            dedup_window(["source_id", "payload.type"], 1800),
            priority_router(2, 5, True),
            rate_limit_tumbling(2, "1 hour", ["source_id"]),
            batch_tumbling("6 hours", 5, ["source_id"]),
        ]
    )
    return events.transform(chain)


@query(
    "flagship",
    f"""WITH RECURSIVE {EV}, c AS (SELECT * FROM ev WHERE kind IN ('error','purchase','click','view') AND user_id % 10 < 9), {_jump('source_id || kind', '1800 SECOND', 'c')},
      d AS (SELECT k.* FROM k JOIN acc USING (key, ts)), p AS (SELECT * FROM d WHERE coalesce(priority, 3) < 5),
      l AS (SELECT *, row_number() OVER (PARTITION BY source_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn FROM p),
      b AS (SELECT *, (row_number() OVER (PARTITION BY source_id, time_bucket(INTERVAL 6 HOUR, ts) ORDER BY ts, event_id) - 1) // 5 AS chunk, time_bucket(INTERVAL 6 HOUR, ts) AS w FROM l WHERE rn <= 2)
      SELECT source_id AS batch_source, {sql_ts('w')} AS window_start, chunk, count(*) AS batch_size, min(coalesce(priority, 3)) AS priority, string_agg(event_id, ',' ORDER BY ts, event_id) AS ids FROM b GROUP BY source_id, w, chunk""",
)
def flagship(spark, sf_dir):
    batches = triage(load_events(spark, sf_dir))
    ids = F.array_join(F.transform("events", lambda e: e["event_id"]), ",")
    return batches.select("batch_source", ts_text("window_start").alias("window_start"), "chunk", "batch_size", "priority", ids.alias("ids"))
