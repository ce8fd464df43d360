"""Registered queries: scans, sources, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.operators.access import write_audit
from sieveline.operators.routing import dispatch_actions, tool_call_bodies, webhook_bodies
from sieveline.functions.text import explode_actions, is_blank
from sieveline.plans import fixtures
from sieveline.plans.registry import EV, REPLY, query, sql_ts, ts_text
from sieveline.schema import load_events, read_table
from sieveline.session import checkpoint_root, scratch_path
from sieveline.sources.files import read_capture, read_lines
from sieveline.sources.kafka import decode_bus, encode_bus, event_json, kafka_events, replay_landed
from sieveline.sources.polling import EventFeed
from sieveline.sources.normalize import (
    composite_status,
    fill_event_defaults,
    is_valid_event,
    non_blank_lines,
    normalize_lines,
    poll_envelope,
    source_health,
    syslog_lines,
    union_sources,
)

_SPACE = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_LINES = "line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"
_NOT_BLANK = f"regexp_replace(value, '^{_SPACE}+', '') <> ''"


@query(
    "src_text_lines",
    f"WITH {_LINES} SELECT md5(value) AS line, count(*) AS n FROM line WHERE {_NOT_BLANK} GROUP BY 1",
)
def src_text_lines(spark, sf_dir):
    # Documents are written out as a log folder and read back line by line.
    path = scratch_path(spark, "lines")
    read_table(spark, sf_dir, "documents").select("text").write.text(path)
    return read_lines(spark, path).groupBy(F.md5("value").alias("line")).agg(F.count("*").alias("n"))


@query(
    "src_normalize_json",
    f"""WITH {_LINES}, mixed AS (SELECT 'e' AS origin, event_id AS id, 0 AS line_no, props AS raw, props AS payload, json_extract_string(props, '$.k') AS k FROM events
      UNION ALL SELECT 'd', doc_id, line_no, CASE WHEN doc_id % 5 = 0 THEN '42 ' || value WHEN doc_id % 5 = 1 THEN '{{"a":1}} ' || value ELSE value END, NULL, NULL FROM line WHERE {_NOT_BLANK})
      SELECT origin, id, line_no, 'feed-' || origin AS source_id, 'DATA' AS event_type, 3 AS priority, raw,
        CASE WHEN origin = 'e' THEN k ELSE raw END AS seen, payload IS NULL AS wrapped FROM mixed""",
)
def src_normalize_json(spark, sf_dir):
    # The document lines are prose, some of them behind a JSON value.
    lead = F.when(F.col("doc_id") % 5 == 0, F.lit("42 ")).when(F.col("doc_id") % 5 == 1, F.lit('{"a":1} ')).otherwise(F.lit(""))
    docs = fixtures.document_lines(spark, sf_dir).select(
        F.lit("d").alias("origin"), F.col("doc_id").alias("id"), F.col("line_no").cast("bigint").alias("line_no"),
        F.when(~is_blank(F.col("value")), F.concat(lead, F.col("value"))).otherwise(F.col("value")).alias("value"),
    )
    props = read_table(spark, sf_dir, "events").select(
        F.lit("e").alias("origin"), F.col("event_id").alias("id"), F.lit(0).cast("bigint").alias("line_no"), F.col("props").alias("value")
    )
    lines = non_blank_lines(docs.unionByName(props))
    out = normalize_lines(lines, F.concat(F.lit("feed-"), F.col("origin")))
    wrapped = F.get_json_object("payload", "$.data").isNotNull()
    return out.select(
        "origin", "id", "line_no", "source_id", "event_type", "priority", "raw",
        F.when(wrapped, F.get_json_object("payload", "$.data")).otherwise(F.get_json_object("payload", "$.k")).alias("seen"),
        wrapped.alias("wrapped"),
    )


@query(
    "src_capture_json",
    f"WITH {EV} SELECT event_id AS frame, kind AS protocol, user_id % 7 AS port FROM ev",
)
def src_capture_json(spark, sf_dir):
    # Files with many arrays one after another, over many lines, behind a single document each.
    path = scratch_path(spark, "capture")
    e = read_table(spark, sf_dir, "events")
    packet = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("frame"), F.col("event_type").alias("protocol"),
            (F.col("user_id") % 7).alias("port"),
        ),
        {"pretty": "true"},
    )
    arrays = e.where("event_id % 10 > 0").groupBy(F.floor(F.col("event_id") / 1000).alias("part")).agg(
        F.concat(F.lit("[\n"), F.array_join(F.collect_list(packet), ",\n"), F.lit("\n]")).alias("value")
    )
    documents = arrays.select("value").unionByName(e.where("event_id % 10 = 0").select(packet.alias("value")))
    documents.coalesce(4).write.text(path)
    got = read_capture(spark, path, "json")
    return got.select(
        F.get_json_object("value", "$.frame").alias("frame"),
        F.get_json_object("value", "$.protocol").alias("protocol"),
        F.get_json_object("value", "$.port").cast("bigint").alias("port"),
    )


def _kafka_rows(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    header = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value"))
    return e.select(
        F.lit("orders").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string")).cast("binary").alias("key"),
        F.when(F.col("event_id") % 5 != 0, F.col("props")).cast("binary").alias("value"),
        F.col("props").cast("binary").alias("fallback"),
        F.array(header("kind", F.col("event_type"))).alias("headers"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


@query(
    "src_kafka_meta",
    f"""WITH {EV} SELECT 'orders-' || (user_id % 4) || '-' || event_id AS event_id, 'kafka-in' AS source_id, 'orders' AS topic,
      CAST(user_id % 4 AS VARCHAR) AS part, event_id AS off, eid % 3 <> 0 AS has_key,
      CASE WHEN eid % 3 <> 0 THEN CAST(user_id AS VARCHAR) END AS key, kind AS header,
      CAST(epoch_us(ts) // 1000 AS VARCHAR) AS ms, CASE WHEN eid % 5 <> 0 THEN CAST(k AS VARCHAR) END AS k, eid % 5 = 0 AS empty FROM ev""",
)
def src_kafka_meta(spark, sf_dir):
    out = kafka_events(_kafka_rows(spark, sf_dir), "kafka-in")
    meta = lambda p: F.get_json_object("metadata", f"$.kafka.{p}")
    return out.select(
        "event_id", "source_id",
        meta("topic").alias("topic"), meta("partition").alias("part"), meta("offset").alias("off"),
        meta("key").isNotNull().alias("has_key"), meta("key").alias("key"),
        meta("headers.kind").alias("header"), meta("timestamp").alias("ms"),
        F.get_json_object("payload", "$.k").alias("k"),
        (F.get_json_object("payload", "$.data") == "").eqNullSafe(True).alias("empty"),
    )


@query(
    "src_polling_cursor",
    f"""WITH {EV}, f AS (SELECT * FROM ev WHERE ts > TIMESTAMP '2024-01-20 12:00:00')
      SELECT event_id, {sql_ts('ts')} AS at, (SELECT {sql_ts('max(ts)')} FROM f) AS cursor FROM f""",
)
def src_polling_cursor(spark, sf_dir):
    """Polled on executors in two runs; a page that can't be fetched by the first is fetched by the second."""
    spark.dataSource.register(EventFeed)
    since = F.lit("2024-01-20 12:00:00").cast("timestamp")
    page = F.floor((F.unix_seconds("timestamp") - F.unix_seconds(since)) / 43_200).cast("int")
    text = F.to_json(F.struct("event_id", ts_text("timestamp").alias("at")))
    fresh = load_events(spark, sf_dir).where(F.col("timestamp") > since).select(page.alias("page"), text.alias("value"))
    path, status, out, checkpoint = (scratch_path(spark, n) for n in ("pages", "status", "polled", "poll-checkpoint"))
    # Page 2 comes late: its poll fails at first.
    for landed in (fresh.where("page < 6 and page <> 2"), fresh.where("page >= 6 or page = 2")):
        fixtures.land_pages(landed, path)
        feed = spark.readStream.format("event-feed").option("path", path).option("status", status).load()
        feed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("value string, received_at string").parquet(out)
    rows = got.select(F.get_json_object("value", "$.event_id").alias("event_id"), F.get_json_object("value", "$.at").alias("at"))
    # The cursor is one row; an equi-join on a constant attaches it.
    one = rows.agg(F.max("at").alias("cursor")).withColumn("_k", F.lit(1))
    return rows.withColumn("_k", F.lit(1)).join(F.broadcast(one), "_k").drop("_k")


@query(
    "src_poll_envelope",
    f"""WITH {EV} SELECT event_id, CASE WHEN eid % 17 = 0 THEN NULL WHEN eid % 2 = 0 THEN source_id END AS resource,
      CASE WHEN eid % 17 = 0 OR eid % 2 = 1 THEN source_id END AS tool, CASE WHEN eid % 17 <> 0 THEN CAST(k AS VARCHAR) END AS k,
      CASE WHEN eid % 17 = 0 THEN 'refused' END AS error FROM ev""",
)
def src_poll_envelope(spark, sf_dir):
    n = F.col("event_id").cast("bigint")
    polls = load_events(spark, sf_dir).select(
        "event_id",
        F.when(n % 2 == 0, "resource").otherwise("tool").alias("kind"),
        F.col("source_id").alias("name"),
        F.col("payload").alias("data"),
        F.when(n % 17 == 0, "refused").alias("error"),
    )
    out = polls.select("event_id", poll_envelope().alias("e"))
    get = lambda p: F.get_json_object("e", p)
    return out.select(
        "event_id", get("$.resource").alias("resource"), get("$.tool").alias("tool"), get("$.data.k").alias("k"), get("$.error").alias("error")
    )


@query(
    "src_syslog_lines",
    f"""WITH {_LINES}, headed AS (SELECT doc_id, line_no, CASE WHEN line_no = 0 AND doc_id % 2 = 0 THEN 'Timestamp  ' || value
        WHEN line_no = 1 AND doc_id % 2 = 0 THEN 'Timestamp kept ' || value ELSE value END AS value FROM line)
      SELECT doc_id, line_no, value AS data, 'syslog' AS source_id FROM headed
      WHERE NOT (line_no = 0 AND (starts_with(value, 'Timestamp') OR starts_with(value, 'Filtering the log data'))) AND {_NOT_BLANK}""",
)
def src_syslog_lines(spark, sf_dir):
    even = F.col("doc_id") % 2 == 0
    lines = fixtures.document_lines(spark, sf_dir).withColumn(
        "value",
        F.when(even & (F.col("line_no") == 0), F.concat(F.lit("Timestamp  "), "value"))
        .when(even & (F.col("line_no") == 1), F.concat(F.lit("Timestamp kept "), "value"))
        .otherwise(F.col("value")),
    )
    out = syslog_lines(lines, "syslog")
    return out.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.get_json_object("payload", "$.data").alias("data"), "source_id")


@query(
    "src_union",
    f"""WITH {EV} SELECT 'events' AS origin, event_id, event_type FROM ev UNION ALL
      SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'DATA' FROM orders UNION ALL
      SELECT 'documents', CAST(doc_id AS VARCHAR), 'DATA' FROM documents""",
)
def src_union(spark, sf_dir):
    events = load_events(spark, sf_dir).withColumn("origin", F.lit("events"))
    orders = read_table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("origin"), F.col("o_orderkey").cast("string").alias("event_id"), F.lit("DATA").alias("event_type")
    )
    docs = read_table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").cast("string").alias("event_id"), F.lit("DATA").alias("event_type")
    )
    return union_sources([events, orders, docs]).select("origin", "event_id", "event_type")


def _maybe_broken(spark, sf_dir):
    n = F.col("event_id").cast("bigint")
    return (
        load_events(spark, sf_dir)
        .withColumn("n", n)
        .withColumn("source_id", F.when(n % 11 != 0, F.col("source_id")))
        .withColumn("event_type", F.when(n % 7 == 0, F.lower("event_type")).otherwise(F.col("event_type")))
        .withColumn(
            "payload",
            F.when(n % 13 == 0, F.lit('"text"')).when(n % 13 == 1, F.lit("[1,2]")).when(n % 13 == 2, F.lit("{broken")).otherwise(F.col("payload")),
        )
    )


_VALID = "eid % 11 <> 0 AND eid % 7 <> 0 AND eid % 13 NOT IN (0, 2)"


@query("src_validate", f"WITH {EV} SELECT event_id, {_VALID} AS is_valid FROM ev")
def src_validate(spark, sf_dir):
    return _maybe_broken(spark, sf_dir).select("event_id", is_valid_event().alias("is_valid"))


@query(
    "src_kafka",
    f"""WITH {EV} SELECT 'topic-' || (user_id % 4) || '-' || (eid % 4) || '-' || event_id AS event_id, 'kafka-in' AS source_id, CAST(k AS VARCHAR) AS k FROM ev
      WHERE user_id % 4 = 1 AND eid > CASE eid % 4 WHEN 0 THEN 300 WHEN 1 THEN 5000 WHEN 2 THEN 20 ELSE -1 END
        OR user_id % 4 = 2 AND eid > 700 OR user_id % 4 = 3""",
)
def src_kafka(spark, sf_dir):
    # Kafka itself needs its connector and brokers; these are landed records of four topics with four partitions each.
    landed = _kafka_rows(spark, sf_dir).select(
        F.concat(F.lit("topic-"), F.col("partition").cast("string")).alias("topic"), (F.col("offset") % 4).cast("int").alias("partition"), "offset", "key", "headers", "timestamp",
        F.coalesce("value", "fallback").alias("value"),
    )
    config = {"id": "kafka-in", "topics": ["topic-1", "topic-2", "topic-3", "topic-9"], "committed": {"topic-1": {0: 300, 1: 5000, 2: 20}, "topic-2": 700}}
    return replay_landed(landed, config).select("event_id", "source_id", F.get_json_object("payload", "$.k").alias("k"))


@query(
    "src_decode_bus",
    f"""WITH {EV} SELECT event_id, source_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS at, CASE WHEN eid % 13 = 1 THEN '' ELSE CAST(k AS VARCHAR) END AS k FROM ev
      WHERE {_VALID} AND eid % 19 <> 0 AND eid % 23 <> 0 AND eid % 29 <> 0 AND (eid % 31 <> 0 OR eid % 13 = 1)""",
)
def src_decode_bus(spark, sf_dir):
    n = F.col("n")
    wire = _maybe_broken(spark, sf_dir).withColumn(
        "payload", F.when(n % 13 == 2, F.lit("null")).otherwise(F.col("payload"))
    )
    body = (
        F.when(n % 19 == 0, F.lit("not json {"))
        .when(n % 23 == 0, F.concat(event_json(), F.lit(" x")))
        .when(n % 29 == 0, F.regexp_replace(event_json(), '"event_id":"([0-9]+)"', '"event_id":$1'))
        .when(n % 31 == 0, F.regexp_replace(event_json(), '"payload":[{][^}]*[}]', r'"payload":"{}"'))
        .otherwise(event_json())
    )
    # The topic as it would have landed.
    path = scratch_path(spark, "topic")
    wire.select(body.cast("binary").alias("value")).write.parquet(path)
    return decode_bus(spark.read.parquet(path)).select(
        "event_id", "source_id", "event_type",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"),
        F.coalesce(F.get_json_object("payload", "$.k"), F.lit("")).alias("k"),
    )


@query(
    "sink_kafka_encode",
    f"""WITH {EV} SELECT 'events-raw' AS topic, source_id AS key, event_id, CAST(k AS VARCHAR) AS k, event_type AS h_type,
      CAST(coalesce(priority, 3) AS VARCHAR) AS h_priority FROM ev""",
)
def sink_kafka_encode(spark, sf_dir):
    rows = encode_bus(load_events(spark, sf_dir), "raw")
    return rows.select(
        "topic", "key",
        F.get_json_object("value", "$.event_id").alias("event_id"),
        F.get_json_object("value", "$.payload.k").alias("k"),
        F.expr("cast(headers[0].value as string)").alias("h_type"),
        F.expr("cast(headers[1].value as string)").alias("h_priority"),
    )


@query(
    "sink_audit_jsonl",
    "SELECT o_orderkey AS seq, 'user-' || o_custkey AS actor, o_orderstatus AS action, o_orderpriority AS resource, strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') AS timestamp FROM orders",
)
def sink_audit_jsonl(spark, sf_dir):
    path = scratch_path(spark, "audit")
    log = fixtures.audit_log(spark, sf_dir)
    write_audit(log.where("seq % 2 = 0"), path)
    write_audit(log.where("seq % 2 = 1"), path)  # a later append
    back = spark.read.schema(log.schema).json(path)
    return back.select("seq", "actor", "action", "resource", "timestamp")


_ACTIONS = """act AS (SELECT r.*, p.pos, p.type, p.tool FROM reply r JOIN (VALUES (0, 'webhook', 't1'), (1, 'page', NULL), (2, 'fax', NULL)) p(pos, type, tool)
   ON r.eid % 3 = 1)"""


@query(
    "sink_outbox",
    f"""WITH {EV}, {REPLY}, {_ACTIONS}, h AS (SELECT *, row_number() OVER (ORDER BY ts, event_id, agent_id, pos) AS id FROM act WHERE type = 'webhook')
      SELECT event_id, agent_id, 'webhook' AS kind, '{{"id":' || event_id || '}}' AS body FROM h
      UNION ALL SELECT event_id, agent_id, 'tool', '{{"jsonrpc":"2.0","id":' || id || ',"method":"tools/call","params":{{"name":"t1","arguments":{{"id":' || event_id || '}}}}}}' FROM h""",
)
def sink_outbox(spark, sf_dir):
    actions = explode_actions(fixtures.replies(spark, sf_dir))
    hooks = dispatch_actions(actions, fixtures.HANDLERS).where("type = 'webhook' AND handler IS NOT NULL")
    # Kept, as numbering reads them several times: replies are searched for actions once.
    checkpoint_root(spark)
    hooks = hooks.select("event_id", "agent_id", "timestamp", "action_pos", "config", "action_payload").checkpoint()
    bodies = webhook_bodies(hooks).select("event_id", "agent_id", F.lit("webhook").alias("kind"), "body")
    calls = tool_call_bodies(hooks, "lookup", ["timestamp", "event_id", "agent_id", "action_pos"])
    return bodies.unionByName(calls.select("event_id", "agent_id", F.lit("tool").alias("kind"), "body"))


@query(
    "src_health",
    f"""WITH {EV}, s AS (SELECT source_id, max(ts) AS last, arg_max(CASE eid % 4 WHEN 0 THEN 'connected' WHEN 1 THEN 'degraded' WHEN 2 THEN 'error' ELSE 'disconnected' END, ts) AS status FROM ev GROUP BY 1)
      SELECT source_id, {sql_ts('last')} AS last_event_at, status,
        CASE WHEN status = 'error' THEN 'error' WHEN source_id = 'src-3' THEN 'degraded' ELSE status END AS composite FROM s""",
)
def src_health(spark, sf_dir):
    e = load_events(spark, sf_dir)
    m = F.col("event_id").cast("bigint") % 4
    status = F.when(m == 0, "connected").when(m == 1, "degraded").when(m == 2, "error").otherwise("disconnected")
    log = e.select("source_id", F.col("timestamp").alias("status_at"), status.alias("status"))
    secondary = F.when(F.col("source_id") == "src-3", "error").otherwise("connected")
    return source_health(e, log).select(
        "source_id", ts_text("last_event_at").alias("last_event_at"), "status",
        composite_status(F.col("status"), secondary).alias("composite"),
    )


@query(
    "src_bench_events",
    f"""WITH {EV} SELECT CASE WHEN eid % 2 = 0 THEN event_id ELSE md5('{{"k":' || k || ',"n":' || eid || '}}') END AS event_id,
      CASE WHEN eid % 2 = 0 THEN 'src-x' ELSE 'bench' END AS source_id, 'DATA' AS event_type,
      CASE WHEN eid % 2 = 0 THEN '{{"v":' || k || '}}' ELSE '{{"k":' || k || ',"n":' || eid || '}}' END AS payload, eid % 2 = 1 AS no_priority,
      CASE WHEN eid % 2 = 0 THEN '2024-05-01 10:00:00.000000' ELSE '2024-06-01 00:00:00.000000' END AS at FROM ev""",
)
def src_bench_events(spark, sf_dir):
    n, k = F.col("event_id"), F.get_json_object("raw", "$.k")
    full = F.concat(
        F.lit('{"event_id":"'), n, F.lit('","source_id":"src-x","timestamp":"2024-05-01T10:00:00Z","priority":2,"payload":{"v":'), k, F.lit("}}")
    )
    bare = F.concat(F.lit('{"k":'), k, F.lit(',"n":'), n, F.lit("}"))
    records = load_events(spark, sf_dir).select(F.when(n.cast("bigint") % 2 == 0, full).otherwise(bare).alias("record"))
    out = fill_event_defaults(records, now=F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return out.select(
        "event_id", "source_id", "event_type", "payload",
        F.col("priority").isNull().alias("no_priority"), ts_text("timestamp").alias("at"),
    )
