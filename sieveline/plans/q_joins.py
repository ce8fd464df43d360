"""Registered queries: routing, dispatch, lookups, entitlements."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions.text import explode_actions
from sieveline.operators.access import effective_permissions, has_permission, tenant_access, user_by_key
from sieveline.operators.metrics import event_status, recent
from sieveline.operators.routing import (
    alert_fanout,
    approval_outcome,
    dispatch_actions,
    route_agents,
    route_agents_table,
    triggered_lookup,
    unrouted,
)
from sieveline.plans import fixtures
from sieveline.plans.q_sources import _ACTIONS
from sieveline.plans.registry import EV, REPLY, query
from sieveline.schema import load_events, read_table


@query("route_agents", f"WITH {EV}, {REPLY} SELECT event_id, source_id, agent_id FROM reply")
def route_agents_q(spark, sf_dir):
    return route_agents(load_events(spark, sf_dir), fixtures.AGENTS).select("event_id", "source_id", "agent_id")


@query(
    "route_agents_table",
    f"WITH {EV} SELECT event_id, source_id, 'agent-' || s_nationkey AS agent_id FROM ev JOIN (SELECT DISTINCT s_nationkey, s_suppkey % 10 AS s FROM supplier) ON source_id = 'src-' || s",
)
def route_agents_table_q(spark, sf_dir):
    subs = read_table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("agent-"), F.col("s_nationkey").cast("string")).alias("agent_id"),
        F.concat(F.lit("src-"), (F.col("s_suppkey") % 10).cast("string")).alias("source_id"),
    )
    return route_agents_table(load_events(spark, sf_dir), subs).select("event_id", "source_id", "agent_id")


@query("unrouted", f"WITH {EV} SELECT event_id, source_id FROM ev WHERE source_id NOT IN ('src-1', 'src-2', 'src-99')")
def unrouted_q(spark, sf_dir):
    listed = [a for a in fixtures.AGENTS if a["sources"]]
    return unrouted(load_events(spark, sf_dir), listed).select("event_id", "source_id")


@query(
    "dispatch_actions",
    f"""WITH {EV}, {REPLY}, {_ACTIONS} SELECT event_id, agent_id, type,
      CASE type WHEN 'webhook' THEN 'hook-new' WHEN 'page' THEN 'pager' END AS handler, type <> 'fax' AS is_handled FROM act""",
)
def dispatch_actions_q(spark, sf_dir):
    out = dispatch_actions(explode_actions(fixtures.replies(spark, sf_dir)), fixtures.HANDLERS)
    return out.select("event_id", "agent_id", "type", "handler", F.col("handler").isNotNull().alias("is_handled"))


@query(
    "triggered_lookup",
    f"""WITH {EV} SELECT event_id, 0 AS ord, payload FROM ev UNION ALL
      SELECT event_id, 1, '{{"customer":"' || c_name || '"}}' FROM ev JOIN customer ON c_custkey = user_id WHERE kind = 'error'""",
)
def triggered_lookup_q(spark, sf_dir):
    e = load_events(spark, sf_dir).withColumn("user_id", F.get_json_object("payload", "$.user_id").cast("bigint"))
    c = read_table(spark, sf_dir, "customer")
    # Two results per customer; only the first one is taken.
    lookup = c.select(
        F.col("c_custkey").alias("user_id"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("lookup_no"),
        F.to_json(F.struct(F.col("c_name").alias("customer"))).alias("result"),
    ).withColumn("result", F.when(F.col("lookup_no") == 1, F.col("result")).otherwise(F.lit('{"second":true}')))
    out = triggered_lookup(e, lookup, {"field": "payload.type", "match": "error"}, "user_id")
    return out.select("event_id", "ord", "payload")


@query(
    "alert_fanout",
    f"""WITH {EV}, {REPLY} SELECT event_id AS dropped_event_id, h.type AS handler_type, h.handler, 'ERROR' AS event_type,
      '{{"event":{{"event_id":"alert-' || event_id || '-' || agent_id || '","source_id":"engine:pipeline","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z","event_type":"ERROR","payload":{{"message":"LLM bridge unreachable for agent \\"'
      || agent_id || '\\"","error":"' || error || '","dropped_event_id":"' || event_id || '"}}}}}}' AS payload
      FROM reply JOIN (VALUES ('webhook', 'hook-new'), ('page', 'pager')) h(type, handler) ON error IS NOT NULL""",
)
def alert_fanout_q(spark, sf_dir):
    failed = fixtures.replies(spark, sf_dir).where("error IS NOT NULL")
    return alert_fanout(failed, fixtures.HANDLERS)


@query(
    "tenant_access",
    """SELECT o_orderkey, coalesce(n_regionkey <> 0 AND (s_suppkey % 3 = 0 OR o_orderpriority IN ('1-URGENT', '2-HIGH')), false) AS is_allowed
      FROM orders LEFT JOIN (supplier JOIN nation ON n_nationkey = s_nationkey) ON s_suppkey = o_custkey % 150""",
)
def tenant_access_q(spark, sf_dir):
    tenants = (
        read_table(spark, sf_dir, "supplier")
        .join(read_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("id"),
            (F.col("n_regionkey") != 0).alias("enabled"),
            F.when(F.col("s_suppkey") % 3 != 0, F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("allowed_models"),
        )
    )
    requests = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 150).alias("tenant_id"), F.col("o_orderpriority").alias("model")
    )
    return tenant_access(requests, tenants, "model", "allowed_models").select("o_orderkey", "is_allowed")


def _users_roles(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")
    users = c.select(
        F.col("c_custkey").alias("user_id"),
        F.array(
            F.when(F.col("c_custkey") % 11 == 0, "RETIRED-ROLE").otherwise(seg),
            F.when(F.col("c_custkey") % 50 == 0, "ROOT").when(F.col("c_custkey") % 7 == 0, "NO-SUCH-ROLE").otherwise("VIEWER"),
        ).alias("roles"),
    )
    # Roles: one per market segment plus a viewer and an administrator.
    base = c.select(seg.alias("name")).distinct().select(
        "name", F.array(F.concat(F.lit("read:"), F.lower("name")), F.concat(F.lit("edit:"), F.lower(F.substring("name", 1, 1)))).alias("permissions")
    )
    fixed = spark.createDataFrame(
        [("ROOT", ["admin"]), ("VIEWER", ["read:all", "read:building"])], "name string, permissions array<string>"
    )
    return users, base.unionByName(fixed)


_GRANTS = """u AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS seg,
    CASE WHEN c_custkey % 50 = 0 THEN 'ROOT' WHEN c_custkey % 7 = 0 THEN 'NO' ELSE 'VIEWER' END AS extra FROM customer),
  g AS (SELECT user_id, 'read:' || lower(seg) AS p FROM u WHERE seg IS NOT NULL UNION SELECT user_id, 'edit:' || lower(substr(seg, 1, 1)) FROM u WHERE seg IS NOT NULL
    UNION SELECT user_id, 'admin' FROM u WHERE extra = 'ROOT' UNION SELECT user_id, unnest(['read:all', 'read:building']) FROM u WHERE extra = 'VIEWER')"""


@query(
    "has_permission",
    f"""WITH {_GRANTS}, req AS (SELECT o_orderkey AS request_id, o_custkey * 2 AS user_id,
        CASE o_orderkey % 3 WHEN 0 THEN 'read:all' WHEN 1 THEN 'read:building' ELSE 'edit:a' END AS wanted FROM orders)
      SELECT request_id, wanted, EXISTS (SELECT 1 FROM g WHERE g.user_id = req.user_id AND p IN ('admin', wanted)) AS is_granted FROM req""",
)
def has_permission_q(spark, sf_dir):
    m = F.col("o_orderkey") % 3
    requests = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        (F.col("o_custkey") * 2).alias("user_id"),
        F.when(m == 0, "read:all").when(m == 1, "read:building").otherwise("edit:a").alias("wanted"),
    )
    return has_permission(requests, *_users_roles(spark, sf_dir)).select("request_id", "wanted", "is_granted")


@query("effective_permissions", f"WITH {_GRANTS} SELECT u.user_id, coalesce(string_agg(p, ',' ORDER BY p), '') AS permissions FROM u LEFT JOIN g USING (user_id) GROUP BY 1")
def effective_permissions_q(spark, sf_dir):
    out = effective_permissions(*_users_roles(spark, sf_dir))
    return out.select("user_id", F.array_join("permissions", ",").alias("permissions"))


@query(
    "user_by_key",
    """WITH u AS (SELECT 'key-' || CAST(c_custkey % 400 AS VARCHAR) AS api_key, min(c_custkey) AS user_id FROM customer GROUP BY 1)
      SELECT o_orderkey, coalesce(user_id, -1) AS user_id FROM orders LEFT JOIN u ON api_key = 'key-' || CAST(o_orderkey % 500 AS VARCHAR)""",
)
def user_by_key_q(spark, sf_dir):
    users = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("user_no"),
        F.concat(F.lit("key-"), (F.col("c_custkey") % 400).cast("string")).alias("api_key"),
    )
    requests = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("key-"), (F.col("o_orderkey") % 500).cast("string")).alias("api_key")
    )
    return user_by_key(requests, users).select("o_orderkey", F.coalesce("user_id", F.lit(-1)).alias("user_id"))


@query(
    "approval_outcome",
    f"""WITH {EV} SELECT event_id, CASE WHEN eid % 6 = 0 THEN false WHEN (k * 2) > 60 THEN false WHEN eid % 6 = 1 THEN true
      WHEN eid % 6 = 2 THEN false WHEN eid % 6 = 3 THEN false WHEN eid % 6 = 4 THEN false ELSE false END AS strict,
      CASE WHEN eid % 6 = 0 THEN true WHEN (k * 2) > 60 THEN true WHEN eid % 6 = 1 THEN true
      WHEN eid % 6 = 2 THEN false WHEN eid % 6 = 3 THEN false WHEN eid % 6 = 4 THEN true ELSE true END AS lenient FROM ev""",
)
def approval_outcome_q(spark, sf_dir):
    e = load_events(spark, sf_dir)
    m = F.col("event_id").cast("bigint") % 6
    requests = e.select(F.col("event_id").alias("request_id"), F.col("timestamp").alias("request_ts"))
    body = (
        F.when(m == 1, '{"approved":true}').when(m == 2, '{"approved":"true"}').when(m == 3, '{"ok":1}').when(m == 4, '{"approved":true}').otherwise("oops")
    )
    wait = F.get_json_object("raw", "$.k").cast("int") * 2
    replies = e.where(m != 0).select(
        F.col("event_id").alias("request_id"),
        (F.col("timestamp") + F.make_dt_interval(secs=wait)).alias("reply_ts"),
        F.when(m == 4, 503).otherwise(200).alias("status"),
        body.alias("body"),
    )
    strict = approval_outcome(requests, replies, 60, True).withColumnRenamed("is_approved", "strict")
    both = approval_outcome(strict, replies, 60, False).withColumnRenamed("is_approved", "lenient")
    return both.select(F.col("request_id").alias("event_id"), "strict", "lenient")


@query(
    "event_status",
    f"""WITH {EV}, recent AS (SELECT * FROM ev ORDER BY ts DESC, event_id DESC LIMIT 50)
      SELECT event_id, CASE WHEN eid % 17 = 0 THEN 'dropped' WHEN eid % 3 = 0 THEN 'sent' ELSE 'filtered' END AS status FROM recent""",
)
def event_status_q(spark, sf_dir):
    e = load_events(spark, sf_dir)
    n = F.col("event_id").cast("bigint")
    last = F.when(n % 17 == 0, "dropped").when(n % 3 == 0, "sent").otherwise("filtered")
    steps = e.select(
        "event_id", F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), s.alias("status")) for i, s in enumerate([F.lit("received"), F.lit("processing"), last])])).alias("s")
    ).select("event_id", "s.seq", "s.status")
    return event_status(steps, recent(e, 50))
