"""Registered queries: projections, filters, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions.numbers import hash_sample, round_js
from sieveline.functions.paths import event_key, path_text
from sieveline.functions.redact import redact_fields
from sieveline.functions.replies import model_name, model_provider
from sieveline.functions.text import describe_action
from sieveline.functions.urls import url_guard
from sieveline.operators.rules import (
    content_filter,
    filter_chain,
    priority_router,
    project_for_agent,
    tenant_isolation,
    trigger_predicate,
)
from sieveline.operators.stateful import dedup_window, rate_limit_tumbling
from sieveline.plans.registry import EV, query, sql_ts, ts_text
from sieveline.schema import load_events, read_table
from sieveline.sources.normalize import make_event


@query(
    "path_get",
    f"""WITH {EV} SELECT event_id, source_id AS top, kind AS a_type, CAST(k AS VARCHAR) AS deep, CAST(user_id AS VARCHAR) AS tag1,
      'null' AS nulled, CAST(NULL AS VARCHAR) AS through_null, CAST(NULL AS VARCHAR) AS missing, CAST(NULL AS VARCHAR) AS guarded,
      '[' || user_id || ',"' || kind || '"]' AS nested FROM ev""",
)
def path_get(spark, sf_dir):
    e = load_events(spark, sf_dir)
    get = lambda p: F.get_json_object("payload", p)
    deep = F.concat(
        F.lit('{"type":"'), get("$.type"), F.lit('","a":{"b":{"k":'), get("$.k"),
        F.lit('}},"n":null,"tags":['), get("$.user_id"), F.lit(',"'), get("$.type"), F.lit('"]}'),
    )
    e = e.withColumn("payload", deep)
    return e.select(
        "event_id",
        path_text("source_id").alias("top"),
        path_text("payload.type").alias("a_type"),
        path_text("payload.a.b.k").alias("deep"),
        path_text("payload.tags.0").alias("tag1"),
        path_text("payload.n").alias("nulled"),
        path_text("payload.n.x").alias("through_null"),
        path_text("payload.a.c").alias("missing"),
        path_text("payload.constructor").alias("guarded"),
        path_text("payload.tags").alias("nested"),
    )


@query("event_key", f"""WITH {EV} SELECT event_id, source_id || '|' || user_id || '||' || event_type AS event_key FROM ev""")
def event_key_q(spark, sf_dir):
    key = event_key(["source_id", "payload.user_id", "payload.absent", "event_type"])
    return load_events(spark, sf_dir).select("event_id", key.alias("event_key"))


def _ruled(spark, sf_dir, rules, mode="all"):
    return load_events(spark, sf_dir).transform(content_filter(rules, mode)).select("event_id", "source_id", "event_type")


_COLS = "event_id, source_id, event_type"


@query("filter_contains", f"WITH {EV} SELECT {_COLS} FROM ev WHERE contains(kind, 'ur')")
def filter_contains(spark, sf_dir):
    return _ruled(spark, sf_dir, [{"field": "payload.type", "match": "ur"}])


@query("filter_regex", f"WITH {EV} SELECT {_COLS} FROM ev WHERE regexp_matches(CAST(user_id AS VARCHAR), '^1[0-4]|9$')")
def filter_regex(spark, sf_dir):
    return _ruled(spark, sf_dir, [{"field": "payload.user_id", "regex": "^1[0-4]|9$"}])


@query("filter_in", f"WITH {EV} SELECT {_COLS} FROM ev WHERE k IN (22, 44, 69)")
def filter_in(spark, sf_dir):
    return _ruled(spark, sf_dir, [{"field": "payload.k", "in": [22, "44", 69]}])


@query("filter_not_in", f"WITH {EV} SELECT {_COLS} FROM ev WHERE priority IS NOT NULL AND priority NOT IN (1, 5)")
def filter_not_in(spark, sf_dir):
    return _ruled(spark, sf_dir, [{"field": "priority", "not_in": [1, 5]}])


@query("filter_exists", f"WITH {EV} SELECT {_COLS} FROM ev WHERE priority IS NOT NULL")
def filter_exists(spark, sf_dir):
    return _ruled(spark, sf_dir, [{"field": "priority"}, {"field": "payload.k"}])


_RULES = [
    {"field": "payload.type", "regex": "^(error|purchase|view)$"},
    {"field": "source_id", "in": ["src-1", "src-2", "src-3"]},
    {"field": "payload.k", "not_in": [5, 6]},
]


@query(
    "filter_rules_all",
    f"WITH {EV} SELECT {_COLS} FROM ev WHERE kind IN ('error','purchase','view') AND user_id % 10 IN (1,2,3) AND k NOT IN (5,6)",
)
def filter_rules_all(spark, sf_dir):
    return _ruled(spark, sf_dir, _RULES)


@query(
    "filter_rules_any",
    f"WITH {EV} SELECT {_COLS} FROM ev WHERE kind IN ('error','purchase') OR user_id % 10 IN (1,2) OR k < 10",
)
def filter_rules_any(spark, sf_dir):
    rules = [
        {"field": "payload.type", "regex": "error|purchase"},
        {"field": "source_id", "in": ["src-1", "src-2"]},
        {"field": "payload.k", "regex": "^[0-9]$"},
        {"field": "payload.nowhere"},
    ]
    return _ruled(spark, sf_dir, rules, "any")


@query(
    "priority_router",
    f"WITH {EV} SELECT {_COLS}, coalesce(priority, 3) AS p FROM ev WHERE coalesce(priority, 3) < 5",
)
def priority_router_q(spark, sf_dir):
    out = load_events(spark, sf_dir).transform(priority_router(2, 5, True))
    return out.select("event_id", "source_id", "event_type", F.coalesce("priority", F.lit(3)).alias("p"))


@query(
    "tenant_isolation",
    f"""WITH {EV} SELECT event_id, CAST(k AS VARCHAR) AS k, 's' || s_suppkey AS tenant
      FROM ev JOIN supplier ON s_suppkey = user_id % 120 JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey <> 0""",
)
def tenant_isolation_q(spark, sf_dir):
    tenants = (
        read_table(spark, sf_dir, "supplier")
        .join(read_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), (F.col("n_regionkey") != 0).alias("enabled"))
    )
    e = load_events(spark, sf_dir).withColumn("metadata", F.concat(F.lit('{"k":'), F.get_json_object("raw", "$.k"), F.lit("}")))
    tenant = F.concat(F.lit("s"), (F.get_json_object("payload", "$.user_id").cast("bigint") % 120).cast("string"))
    out = e.transform(tenant_isolation(tenants, tenant))
    return out.select(
        "event_id",
        path_text("metadata.k").alias("k"),
        path_text("metadata.tenant_id").alias("tenant"),
    )


@query(
    "trigger_predicate",
    f"""WITH {EV} SELECT event_id, contains(kind, 'err') AS by_match, user_id % 2 = 0 AS by_regex, k <> 0 AS by_truth,
      false AS by_missing, false AS untriggered FROM ev""",
)
def trigger_predicate_q(spark, sf_dir):
    return load_events(spark, sf_dir).select(
        "event_id",
        trigger_predicate({"field": "payload.type", "match": "err"}).alias("by_match"),
        trigger_predicate({"field": "payload.user_id", "regex": "[02468]$"}).alias("by_regex"),
        trigger_predicate({"field": "payload.k"}).alias("by_truth"),
        trigger_predicate({"field": "payload.none"}).alias("by_missing"),
        trigger_predicate(None).alias("untriggered"),
    )


# Every page is checked under its own URL and under rewritten hosts.
_URL_FORMS = ["own", "10.1.2.3", "172.16.0.9", "172.32.0.9", "192.168.1.1", "169.254.169.254", "0.1.2.3", "localhost", "[::1]", "127.0.0.2", "8.8.8.8", "ftp",
    "2130706433", "0x7f000001", "0300.0250.0.1", "127.1", "192.168.257", "u:p@10.0.0.1:8080", "256.1.1.1", "a_b.example", "[0:0:0:0:0:0:0:1]", "bad host"]


@query(
    "url_guard",
    """WITH u AS (SELECT page_id, url, f.form FROM pages, (VALUES ('own'),('10.1.2.3'),('172.16.0.9'),('172.32.0.9'),('192.168.1.1'),
        ('169.254.169.254'),('0.1.2.3'),('localhost'),('[::1]'),('127.0.0.2'),('8.8.8.8'),('ftp'),
        ('2130706433'),('0x7f000001'),('0300.0250.0.1'),('127.1'),('192.168.257'),('u:p@10.0.0.1:8080'),('256.1.1.1'),('a_b.example'),('[0:0:0:0:0:0:0:1]'),('bad host')) f(form))
      SELECT page_id, form, CASE WHEN form = 'ftp' THEN 'protocol' WHEN form IN ('localhost', '[::1]', '2130706433', '0x7f000001', '127.1', '[0:0:0:0:0:0:0:1]') THEN 'host'
        WHEN form IN ('256.1.1.1', 'bad host') THEN 'invalid' WHEN form IN ('0300.0250.0.1', '192.168.257', 'u:p@10.0.0.1:8080') THEN 'private'
        WHEN form IN ('10.1.2.3','172.16.0.9','192.168.1.1','169.254.169.254','0.1.2.3') THEN 'private' ELSE 'ok' END AS verdict FROM u""",
)
def url_guard_q(spark, sf_dir):
    form = F.col("form")
    url = (
        F.when(form == "own", F.col("url"))
        .when(form == "ftp", F.regexp_replace("url", "^https?", "ftp"))
        .otherwise(F.regexp_replace("url", "^(https?)://[^/?#]+", F.concat(F.lit("$1://"), form)))
    )
    pages = read_table(spark, sf_dir, "pages").select(
        "page_id", "url", F.explode(F.array(*[F.lit(f) for f in _URL_FORMS])).alias("form")
    )
    return pages.select("page_id", "form", url_guard(url).alias("verdict"))


@query(
    "project_for_agent",
    f"""WITH {EV} SELECT event_id, 'New event received:' AS first_line, event_id AS j_id, event_type AS j_type,
      strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS j_time,
      CAST(k AS VARCHAR) AS j_k, false AS has_raw, priority IS NOT NULL AS has_priority FROM ev""",
)
def project_for_agent_q(spark, sf_dir):
    text = project_for_agent()
    body = F.regexp_extract(text, r"^New event received:\n\n([\s\S]*)$", 1)
    out = load_events(spark, sf_dir).select("event_id", text.alias("prompt"), body.alias("body"))
    return out.select(
        "event_id",
        F.split_part("prompt", F.lit("\n"), F.lit(1)).alias("first_line"),
        F.get_json_object("body", "$.event_id").alias("j_id"),
        F.get_json_object("body", "$.event_type").alias("j_type"),
        F.get_json_object("body", "$.timestamp").alias("j_time"),
        F.get_json_object("body", "$.payload.k").alias("j_k"),
        F.get_json_object("body", "$.raw").isNotNull().alias("has_raw"),
        F.get_json_object("body", "$.priority").isNotNull().alias("has_priority"),
    )


@query(
    "make_event",
    f"WITH {EV} SELECT source_id, payload, coalesce(priority, 3) AS priority, true AS has_id, true AS has_time FROM ev",
)
def make_event_q(spark, sf_dir):
    bare = load_events(spark, sf_dir).select("source_id", "payload", "priority")
    return make_event(bare).select(
        "source_id", "payload", "priority",
        (F.length("event_id") == 36).alias("has_id"),
        F.col("timestamp").isNotNull().alias("has_time"),
    )


@query(
    "redact_fields",
    """SELECT c_custkey, substr(c_name, 1, 4) || '***' AS token, CASE WHEN length(CAST(c_custkey AS VARCHAR)) > 4
        THEN substr(CAST(c_custkey AS VARCHAR), 1, 4) || '***' ELSE '***' END AS deep, c_mktsegment AS plain,
        c_name AS listed, CAST(c_nationkey AS VARCHAR) AS number FROM customer""",
)
def redact_fields_q(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    doc = F.to_json(
        F.struct(
            F.col("c_name").alias("token"),
            F.struct(
                F.struct(F.col("c_custkey").cast("string").alias("password")).alias("inner"),
                F.col("c_mktsegment").alias("segment"),
            ).alias("config"),
            F.struct(F.array("c_name").alias("secret")).alias("lists"),
            F.col("c_nationkey").alias("url"),
        )
    )
    r = c.select("c_custkey", redact_fields(doc).alias("d"))
    return r.select(
        "c_custkey",
        F.get_json_object("d", "$.token").alias("token"),
        F.get_json_object("d", "$.config.inner.password").alias("deep"),
        F.get_json_object("d", "$.config.segment").alias("plain"),
        F.get_json_object("d", "$.lists.secret[0]").alias("listed"),
        F.get_json_object("d", "$.url").alias("number"),
    )


@query(
    "describe_action",
    """SELECT doc_id, '[Approval Required]' || chr(10) || 'Action: ' || source || chr(10) || 'Payload: ' ||
      CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '... [truncated]' ELSE text END AS description FROM documents""",
)
def describe_action_q(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", describe_action(F.col("source"), F.col("text")).alias("description")
    )


@query(
    "model_ref",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN lower(p_brand) WHEN 1 THEN 'a' WHEN 2 THEN 'openai' ELSE 'crewai' END AS provider,
      CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN 'b' ELSE p_type END AS model FROM part""",
)
def model_ref(spark, sf_dir):
    form = F.col("p_size") % 4
    ref = (
        F.when(form == 0, F.concat(F.lower("p_brand"), F.lit("/"), F.col("p_type")))
        .when(form == 1, F.concat(F.lit("a/b/"), F.col("p_type")))
        .otherwise(F.col("p_type"))
    )
    runtime = F.when(form == 2, "direct-llm").otherwise("crewai")
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", model_provider(ref, runtime).alias("provider"), model_name(ref).alias("model")
    )


_CHAIN_SQL = f"""WITH RECURSIVE {EV},
  r AS (SELECT *, source_id || '|' || user_id AS key FROM ev WHERE kind IN ('error','purchase','view','click') AND user_id % 10 < 6),
  acc AS (
    SELECT key, min(ts) AS ts FROM r GROUP BY key
    UNION ALL
    SELECT a.key, (SELECT min(r.ts) FROM r WHERE r.key = a.key AND r.ts >= a.ts + INTERVAL 6 HOUR) FROM acc a WHERE a.ts IS NOT NULL),
  d AS (SELECT r.* FROM r JOIN acc USING (key, ts)),
  p AS (SELECT * FROM d WHERE coalesce(priority, 3) < 5),
  n AS (SELECT *, row_number() OVER (PARTITION BY source_id, date_trunc('hour', ts) ORDER BY ts, eid) AS rn FROM p)
  SELECT event_id, source_id, event_type, {sql_ts('ts')} AS at FROM n WHERE rn <= 2"""


@query("filter_chain", _CHAIN_SQL)
def filter_chain_q(spark, sf_dir):
    chain = filter_chain(
        [
            content_filter(
                [
                    {"field": "payload.type", "regex": "^(error|purchase|view|click)$"},
                    {"field": "source_id", "in": [f"src-{i}" for i in range(6)]},
                ]
            ),
            dedup_window(["source_id", "payload.user_id"], 6 * 3600),
            priority_router(2, 5, True),
            rate_limit_tumbling(2, "1 hour", ["source_id"]),
        ]
    )
    return load_events(spark, sf_dir).transform(chain).select(
        "event_id", "source_id", "event_type", ts_text("timestamp").alias("at")
    )


@query(
    "hash_sample",
    f"WITH {EV} SELECT event_id, round(CAST(concat('0x', substr(md5(event_id), 1, 8)) AS BIGINT) / 4294967296.0, 9) AS u FROM ev",
)
def hash_sample_q(spark, sf_dir):
    return load_events(spark, sf_dir).select("event_id", F.round(hash_sample(F.col("event_id")), 9).alias("u"))


@query(
    "round_js",
    """SELECT c_custkey, CAST(floor(c_acctbal + 0.5) AS BIGINT) AS whole, floor(c_acctbal / 7 * 100.0 + 0.5) / 100.0 AS cents,
      CAST(floor(-c_custkey - 0.5 + 0.5) AS BIGINT) AS halves FROM customer""",
)
def round_js_q(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select(
        "c_custkey",
        round_js(F.col("c_acctbal")).alias("whole"),
        round_js(F.col("c_acctbal") / 7, 2).alias("cents"),
        round_js(-F.col("c_custkey") - F.lit(0.5)).alias("halves"),
    )
