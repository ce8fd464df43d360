"""Kafka: option mapping, metadata, and the wire form of events."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.json import is_json
from sieveline.schema import DEFAULT_PRIORITY, EVENT_SCHEMA, EVENT_TYPES
from sieveline.sources.normalize import normalize_lines

# SASL mechanisms and the login module each of them needs.
SASL_MECHANISMS = {
    "plain": ("PLAIN", "org.apache.kafka.common.security.plain.PlainLoginModule"),
    "scram-sha-256": ("SCRAM-SHA-256", "org.apache.kafka.common.security.scram.ScramLoginModule"),
    "scram-sha-512": ("SCRAM-SHA-512", "org.apache.kafka.common.security.scram.ScramLoginModule"),
}


def kafka_options(config: Mapping[str, Any]) -> dict[str, str]:
    """Map a source config to options of Spark's Kafka connector."""
    brokers = config["brokers"]
    topics = config.get("topics") or config["topic"]
    if not isinstance(topics, str):
        topics = ",".join(topics)
    if not isinstance(brokers, str):
        brokers = ",".join(brokers)
    options = {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topics,
        "startingOffsets": "earliest" if config.get("from_beginning") else "latest",
        "includeHeaders": "true",
        "kafka.session.timeout.ms": str(config.get("session_timeout_ms", 30_000)),
        # Connection retries: from one second, doubling to ten.
        "kafka.reconnect.backoff.ms": "1000",
        "kafka.reconnect.backoff.max.ms": "10000",
    }
    if config.get("group_id"):
        options["kafka.group.id"] = config["group_id"]
    if config.get("client_id"):
        options["kafka.client.id"] = config["client_id"]
    sasl, ssl = config.get("sasl"), bool(config.get("ssl"))
    if sasl:
        name, module = SASL_MECHANISMS[sasl.get("mechanism", "plain").lower()]
        user, password = (str(sasl[k]).replace("\\", "\\\\").replace('"', '\\"') for k in ("username", "password"))
        options["kafka.sasl.mechanism"] = name
        options["kafka.sasl.jaas.config"] = f'{module} required username="{user}" password="{password}";'
    if sasl or ssl:
        options["kafka.security.protocol"] = ("SASL_" if sasl else "") + ("SSL" if ssl else "PLAINTEXT")
    return options


def read_kafka_stream(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    """Streaming events from Kafka (needs the connector on the class path)."""
    return kafka_events(spark.readStream.format("kafka").options(**kafka_options(config)).load(), config["id"])


def kafka_metadata() -> Column:
    """``{"kafka": {...}}`` for a row with Kafka columns; a null key is left out."""
    headers = F.map_from_entries(
        F.transform(
            F.coalesce(F.col("headers"), F.expr("array()")),
            lambda h: F.struct(h["key"].alias("key"), h["value"].cast("string").alias("value")),
        )
    )
    return F.to_json(
        F.struct(
            F.struct(
                F.col("topic"),
                F.col("partition"),
                F.col("offset").cast("string").alias("offset"),
                F.col("key").cast("string").alias("key"),
                headers.alias("headers"),
                F.unix_millis(F.col("timestamp")).cast("string").alias("timestamp"),
            ).alias("kafka")
        )
    )


def kafka_events(records: DataFrame, source_id: str) -> DataFrame:
    """Kafka records to events; the record position serves as event id."""
    base = records.select(
        F.concat_ws("-", "topic", F.col("partition").cast("string"), F.col("offset").cast("string")).alias("event_id"),
        "timestamp",
        kafka_metadata().alias("metadata"),
        F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"),
    )
    return normalize_lines(base, source_id)


def replay_landed(records: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """Batch twin for landed Kafka records: subscribed topics, from the start or
    behind the committed offsets of ``config["committed"]``.

    Offsets are committed per topic and partition, ``{topic: {partition: offset}}``;
    a plain number holds for all partitions of its topic.  Partitions without a
    committed offset are read from the start.
    """
    topics = config.get("topics") or [config["topic"]]
    kept = records.where(F.col("topic").isin(list(topics)))
    committed = config.get("committed") or {}
    if not config.get("from_beginning") and committed:
        done = F.lit(-1)
        for topic, offsets in committed.items():
            here = F.col("topic") == topic
            for partition, offset in (offsets.items() if isinstance(offsets, Mapping) else [(None, offsets)]):
                done = F.when(here if partition is None else here & (F.col("partition") == partition), F.lit(offset)).otherwise(done)
        kept = kept.where(F.col("offset") > done)
    return kafka_events(kept, config["id"])


# The fields of the wire form that must be JSON strings.
STRING_FIELDS = ("event_id", "source_id", "timestamp", "event_type")


def decode_bus(records: DataFrame, value: str = "value") -> DataFrame:
    """Message bytes to validated events; broken or invalid messages are left out.

    Fields are read as VARIANT so that a number or a quoted object in the place
    of a string or an object is told apart.
    """
    text = F.col(value).cast("string")
    wire = ", ".join(f"{f} variant" for f in (*STRING_FIELDS, "payload", "metadata")) + ", priority int, raw string"
    e = records.where(is_json(text)).select(F.from_json(text, wire).alias("e")).select("e.*")
    strings = reduce(lambda a, b: a & b, [F.schema_of_variant(F.col(f)) == "STRING" for f in STRING_FIELDS])
    decoded = e.where(F.coalesce(strings, F.lit(False))).select(
        *[F.try_variant_get(f, "$", "string").alias(f) for f in STRING_FIELDS],
        "priority",
        F.to_json("payload").alias("payload"),
        F.to_json("metadata").alias("metadata"),
        "raw",
    )
    nested = F.col("payload").startswith("{") | F.col("payload").startswith("[")
    return (
        decoded.where(F.col("event_type").isin(*EVENT_TYPES) & F.coalesce(nested, F.lit(False)))
        .withColumn("timestamp", F.try_to_timestamp("timestamp"))
        .select(*[f.name for f in EVENT_SCHEMA.fields])
    )


def event_json() -> Column:
    """Wire form of an event: nested payload and metadata, absent fields left out."""
    known = [
        F.col("event_id"), F.col("source_id"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.col("event_type"), F.col("priority"),
        F.try_parse_json("payload").alias("payload"),
        F.try_parse_json("metadata").alias("metadata"),
        F.col("raw"),
    ]
    return F.to_json(F.struct(*known))


def encode_bus(events: DataFrame, topic: str, prefix: str = "events-") -> DataFrame:
    """Events to Kafka rows (topic, key, value, headers)."""
    header = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value"))
    return events.select(
        F.lit(prefix + topic).alias("topic"),
        F.col("source_id").alias("key"),
        event_json().alias("value"),
        F.array(
            header("event_type", F.col("event_type")),
            header("priority", F.coalesce(F.col("priority"), F.lit(DEFAULT_PRIORITY)).cast("string")),
        ).alias("headers"),
    )


def write_kafka_stream(events: DataFrame, config: Mapping[str, Any], topic: str, checkpoint: str):
    rows = encode_bus(events, topic, config.get("topic_prefix", "events-"))
    return (
        rows.writeStream.format("kafka")
        .options(**{k: v for k, v in kafka_options({**config, "topic": topic}).items() if k.startswith("kafka.")})
        .option("includeHeaders", "true")
        .option("checkpointLocation", checkpoint)
        .start()
    )
