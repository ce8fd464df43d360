"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The canonical events of ``schema.canonical_events``, spelled in SQL.
EV = """ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS eid, user_id, value, event_type AS kind,
    'src-' || CAST(user_id % 10 AS VARCHAR) AS source_id, ts,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'ALERT' WHEN 'view' THEN 'METRIC'
      WHEN 'signup' THEN 'HEARTBEAT' ELSE 'DATA' END AS event_type,
    CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 5 END AS priority,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, props,
    '{"type":"' || event_type || '","user_id":' || user_id || ',"value":' || value || ',"k":'
      || json_extract_string(props, '$.k') || '}' AS payload
  FROM events)"""

# Replies of three agents to the events they are routed to (see ``fixtures.replies``).
REPLY = """reply AS (
  SELECT e.*, a.agent_id, 50 + eid % 400 AS tokens, e.value AS latency_ms,
    CASE WHEN eid % 17 = 0 THEN 'timeout after ' || CAST(eid AS VARCHAR) || ' ms' END AS error,
    CASE WHEN a.agent_id = 'triage' THEN 3000 WHEN a.agent_id = 'audit' THEN 900 END AS max_per_hour
  FROM ev e JOIN (VALUES ('triage', NULL), ('audit', 'src-1'), ('audit', 'src-2'), ('idle', 'src-99')) a(agent_id, src)
    ON a.src IS NULL OR a.src = e.source_id)"""


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package()
            return fn(spark, sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def ts_text(c: str | Column) -> Column:
    """Timestamps are compared as text of microsecond precision."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"
