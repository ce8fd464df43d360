"""Raw text to canonical events, validation, union of sources, defaults."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.json import is_json, is_json_nested
from sieveline.functions.text import is_blank
from sieveline.schema import DEFAULT_PRIORITY, EVENT_TYPES

HEADER_PREFIXES = ("Filtering the log data", "Timestamp")


def non_blank_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    return lines.where(~is_blank(F.col(value)))


def payload_of(text: Column) -> Column:
    """JSON text stays as it is; anything else is wrapped as ``{"data": text}``."""
    return F.when(is_json(text), text).otherwise(F.to_json(F.struct(text.alias("data"))))


def normalize_lines(lines: DataFrame, source_id: str | Column, value: str = "value", as_json: bool = True) -> DataFrame:
    """Adds ``source_id``, ``event_type``, ``priority``, ``payload`` and ``raw``."""
    text = F.col(value)
    source = F.lit(source_id) if isinstance(source_id, str) else source_id
    return lines.select(
        *[c for c in lines.columns if c != value],
        source.alias("source_id"),
        F.lit("DATA").alias("event_type"),
        F.lit(DEFAULT_PRIORITY).alias("priority"),
        (payload_of(text) if as_json else F.to_json(F.struct(text.alias("data")))).alias("payload"),
        text.alias("raw"),
    )


def syslog_lines(lines: DataFrame, source_id: str | Column, value: str = "value", line_no: str = "line_no") -> DataFrame:
    """System log lines: a header is skipped only as the first line; never parsed as JSON."""
    text = F.col(value)
    header = (F.col(line_no) == 0) & reduce(lambda a, b: a | b, [text.startswith(p) for p in HEADER_PREFIXES])
    return normalize_lines(non_blank_lines(lines.where(~header), value), source_id, value, as_json=False)


def is_valid_event() -> Column:
    """Five required fields, a legal type and an object (or array) payload."""
    present = reduce(
        lambda a, b: a & b,
        [F.col(c).isNotNull() for c in ("event_id", "source_id", "timestamp", "event_type", "payload")],
    )
    nested = is_json_nested(F.col("payload"))
    return F.coalesce(present & F.col("event_type").isin(*EVENT_TYPES) & nested, F.lit(False))


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine)."""
    return events.where(is_valid_event()), events.where(~is_valid_event())


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def fill_event_defaults(records: DataFrame, record_json: str = "record", now: Column | None = None) -> DataFrame:
    """Sample events for agent measurements: missing fields get defaults, a
    missing payload becomes the whole record."""

    def field(name: str) -> Column:
        return F.get_json_object(record_json, f"$.{name}")

    return records.select(
        F.coalesce(field("event_id"), F.md5(F.col(record_json))).alias("event_id"),
        F.coalesce(field("source_id"), F.lit("bench")).alias("source_id"),
        F.coalesce(F.try_to_timestamp(field("timestamp")), F.current_timestamp() if now is None else now).alias("timestamp"),
        F.coalesce(field("event_type"), F.lit("DATA")).alias("event_type"),
        field("priority").cast("int").alias("priority"),
        F.coalesce(field("payload"), F.col(record_json)).alias("payload"),
        field("metadata").alias("metadata"),
    )


def make_event(df: DataFrame) -> DataFrame:
    """Constructor defaults: random id, current time, priority 3."""
    have = set(df.columns)
    return df.withColumns(
        {
            "event_id": F.coalesce(F.col("event_id"), F.uuid()) if "event_id" in have else F.uuid(),
            "timestamp": F.coalesce(F.col("timestamp"), F.current_timestamp()) if "timestamp" in have else F.current_timestamp(),
            "priority": F.coalesce(F.col("priority"), F.lit(DEFAULT_PRIORITY)) if "priority" in have else F.lit(DEFAULT_PRIORITY),
        }
    )


def poll_envelope() -> Column:
    """Envelope of one poll result row (kind, name, data, error)."""
    data = F.to_json(F.try_parse_json("data"))
    name = F.to_json(F.struct(F.col("name").alias("v")))
    quoted = F.substring(name, 6, F.length(name) - 6)
    failure = F.to_json(F.struct(F.col("error"), F.col("name").alias("tool")))
    return (
        F.when(F.col("error").isNotNull(), failure)
        .when(F.col("kind") == "resource", F.concat(F.lit('{"resource":'), quoted, F.lit(',"data":'), data, F.lit("}")))
        .otherwise(F.concat(F.lit('{"tool":'), quoted, F.lit(',"data":'), data, F.lit("}")))
    )


def poll_once(table: DataFrame, high_water: Column, ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """Batch twin of a polling source: (new rows, one-row cursor).

    The cursor moves only if there are new rows.
    """
    fresh = table.where(F.col(ts) > high_water)
    cursor = fresh.agg(
        F.coalesce(F.max(ts), high_water).alias("offset"), F.count("*").alias("n_events")
    )
    return fresh, cursor


def source_health(events: DataFrame, status_log: DataFrame) -> DataFrame:
    """Latest status and last event time per source."""
    seen = events.groupBy("source_id").agg(F.max("timestamp").alias("last_event_at"))
    status = status_log.groupBy("source_id").agg(F.max_by("status", "status_at").alias("status"))
    return status.join(seen, "source_id", "full_outer").withColumn(
        "status", F.coalesce("status", F.lit("disconnected"))
    )


def composite_status(primary: Column, secondary: Column) -> Column:
    return F.when(primary == "error", "error").when(secondary == "error", "degraded").otherwise(primary)
