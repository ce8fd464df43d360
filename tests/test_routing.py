"""Routing, dispatch, approvals, entitlements, outbox bodies, stored streams."""

import json

import pytest
from pyspark.sql import functions as F

from sieveline.functions.text import explode_actions, ndjson_lines, sse_data
from sieveline.operators import joins, ordered, streams
from sieveline.operators.access import audit_query, effective_permissions, has_permission, tenant_access, user_by_key
from sieveline.operators.agent_bench import bench_errors, bench_ranking, bench_summary, bench_winners
from sieveline.operators.joins import lookup_join
from sieveline.operators.metrics import avg_latency, decision_log, filter_metrics, inflight
from sieveline.operators.routing import (
    alert_fanout,
    approval_outcome,
    dispatch_actions,
    buffer_failures,
    on_error,
    route_agents,
    tool_call_bodies,
    triggered_lookup,
    unrouted,
)
from sieveline.operators.streams import assemble_stream, last_assistant, ordered_concat

AGENTS = [{"id": "all"}, {"id": "net", "sources": ["a", "b", "a"]}]


def test_routing(spark):
    e = spark.createDataFrame([("1", "a"), ("2", "c")], "event_id string, source_id string")
    pairs = sorted((r["event_id"], r["agent_id"]) for r in route_agents(e, AGENTS).collect())
    assert pairs == [("1", "all"), ("1", "net"), ("2", "all")]
    assert [r["event_id"] for r in unrouted(e, AGENTS[1:]).collect()] == ["2"]
    assert route_agents(e, [{"id": "x", "sources": ["zz"]}]).count() == 0


def test_actions(spark):
    good = 'x\n```json:actions\r\n[{"type":"webhook","payload":{"a":1}},{"type":"fax"}]\n```\n```json:actions\n[{"type":"late"}]\n```'
    rows = [("1", good), ("2", "```json:actions\n[{\n```"), ("3", '```json:actions\n{"type":"webhook"}\n```'), ("4", "none"), ("5", "```json:actions\n[] x\n```"), ("6", None)]
    out = explode_actions(spark.createDataFrame(rows, "event_id string, content string"))
    done = dispatch_actions(out, [("webhook", "old"), ("webhook", "new")])
    assert [(r["event_id"], r["type"], r["handler"], r["action_payload"]) for r in done.orderBy("action_pos").collect()] == [
        ("1", "webhook", "new", '{"a":1}'), ("1", "fax", None, None)
    ]
    bodies = tool_call_bodies(out.where("type = 'webhook'").withColumn("config", F.lit('{"tool":"t"}')), "default", ["event_id"])
    assert json.loads(bodies.first()["body"]) == {
        "jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "t", "arguments": {"a": 1}}
    }


def test_failures(spark):
    r = spark.createDataFrame([("1", "all", None, 0), ("2", "all", "boom", 0)], "event_id string, agent_id string, error string, s long").withColumn("timestamp", F.timestamp_seconds("s"))
    out = on_error(r, "drop_and_alert", [("webhook", "h"), ("page", "p")])
    assert out["passed"].count() == 1 and out["alerts"].count() == 2
    assert json.loads(out["alerts"].first()["payload"])["event"]["payload"]["dropped_event_id"] == "2"
    assert on_error(r, "passthrough")["passed"].count() == 2
    assert on_error(r, "buffer_limited")["retry"].count() == 1
    many = spark.createDataFrame([(f"{i:02d}", "a" if i < 9 else "b", None if i % 2 else "down", 0 if i < 8 else 2, i) for i in range(14)], "event_id string, agent_id string, error string, attempt int, s long")
    many = many.withColumn("timestamp", F.timestamp_seconds("s")).drop("s")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    parts = buffer_failures(many, limit=2, max_attempts=3, retry_seconds=30, now=at)
    ids = {k: sorted(r["event_id"] for r in v.collect()) for k, v in parts.items()}
    assert ids == {"passed": ["01", "03", "05", "07", "09", "11", "13"], "retry": ["00", "02"], "overflow": ["04", "06"], "given_up": ["08", "10", "12"]}
    assert {(r["attempt"], str(r["due_at"])) for r in parts["retry"].collect()} == {(1, "2024-01-01 00:00:30")}
    later = buffer_failures(many.where("event_id = '00'"), limit=2, waiting=parts["overflow"].unionByName(parts["retry"].where("event_id = '02'")), now=at)
    assert sorted(r["event_id"] for r in later["retry"].collect()) == ["00", "02"] and sorted(r["event_id"] for r in later["overflow"].collect()) == ["04", "06"]
    assert alert_fanout(r, [("webhook", "a"), ("webhook", "b")]).select("handler").distinct().first()[0] == "b"
    with pytest.raises(ValueError):
        on_error(r, "ignore")


def test_triggered_lookup(spark):
    e = spark.createDataFrame([("1", "k", '{"t":"x"}'), ("2", "k", '{"t":"y"}'), ("3", "none", '{"t":"x"}')], "event_id string, key string, payload string")
    look = spark.createDataFrame([("k", 2, "second"), ("k", 1, "first")], "key string, lookup_no int, result string")
    got = sorted((r["event_id"], r["ord"], r["payload"]) for r in triggered_lookup(e, look, {"field": "payload.t", "match": "x"}, "key").collect())
    assert got == [("1", 0, '{"t":"x"}'), ("1", 1, "first"), ("2", 0, '{"t":"y"}'), ("3", 0, '{"t":"x"}')]
    assert triggered_lookup(e, look, None, "key").count() == 3


@pytest.mark.parametrize("bound", [10_000_000, 0])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_both_ways(spark, how, bound):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(60)], "id int, k string")
    right = spark.sql("SELECT * FROM VALUES ('hot', 1), ('k3', 2) AS t(k, v)")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound or -1)
    got = lookup_join(left, right, ["k"], how)
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ("BroadcastHashJoin" in plan) == bool(bound)
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).select(*got.columns).collect()))


@pytest.mark.parametrize(
    "status,body,wait,strict,lenient",
    [
        (200, '{"approved":true}', 60, True, True),
        (200, '{"approved":true}', 61, False, True),
        (200, '{"approved":"true"}', 1, False, False),
        (200, "{}", 1, False, False),
        (500, '{"approved":true}', 1, False, True),
        (200, "oops", 1, False, True),
        (None, None, None, False, True),
    ],
)
def test_approvals(spark, status, body, wait, strict, lenient):
    q = spark.createDataFrame([("r", 1000)], "request_id string, s long").select("request_id", F.timestamp_seconds("s").alias("request_ts"))
    rows = [] if status is None else [("r", 1000 + wait, status, body)]
    a = spark.createDataFrame(rows, "request_id string, s long, status int, body string").select(
        "request_id", F.timestamp_seconds("s").alias("reply_ts"), "status", "body"
    )
    assert approval_outcome(q, a).first()["is_approved"] is strict
    assert approval_outcome(q, a, auto_deny=False).first()["is_approved"] is lenient
    assert approval_outcome(q, a, has_url=False, auto_deny=False).first()["is_approved"] is False


def test_entitlements(spark):
    users = spark.createDataFrame([(1, ["admin"], "k1", 0), (2, ["viewer", "ghost"], "k2", 1), (3, ["custom"], "k2", 2), (4, ["ghost"], None, 3), (5, [], None, 4)], "user_id int, roles array<string>, api_key string, user_no int")
    roles = spark.createDataFrame([("admin", ["admin"]), ("viewer", ["read"]), ("custom", ["write", "read"])], "name string, permissions array<string>")
    asked = spark.createDataFrame([(1, 1, "write"), (2, 2, "write"), (3, 2, "read"), (4, 9, "read")], "request_id int, user_id int, wanted string")
    got = {r["request_id"]: r["is_granted"] for r in has_permission(asked, users, roles).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}
    assert {r["user_id"]: r["permissions"] for r in effective_permissions(users, roles).collect()} == {1: ["admin"], 2: ["read"], 3: ["read", "write"], 4: [], 5: []}
    keys = spark.createDataFrame([("k2",), ("zz",)], "api_key string")
    assert {r["api_key"]: r["user_id"] for r in user_by_key(keys, users).collect()} == {"k2": 2, "zz": None}
    tenants = spark.createDataFrame([("t", True, ["m1"]), ("u", True, None), ("off", False, None)], "id string, enabled boolean, models array<string>")
    req = spark.createDataFrame([("t", "m1"), ("t", "m2"), ("u", "m2"), ("off", "m1"), ("new", "m1")], "tenant_id string, model string")
    out = {(r["tenant_id"], r["model"]): r["is_allowed"] for r in tenant_access(req, tenants, "model", "models").collect()}
    assert out == {("t", "m1"): True, ("t", "m2"): False, ("u", "m2"): True, ("off", "m1"): False, ("new", "m1"): False}


def test_audit(spark):
    log = spark.createDataFrame([(i, f"2024-01-{i:02d}", "a" if i % 2 else "b") for i in range(1, 21)], "seq int, timestamp string, actor string")
    assert [r["seq"] for r in audit_query(log, {"actor": "a"}, "2024-01-03", "2024-01-11", limit=3).collect()] == [7, 9, 11]
    assert [r["seq"] for r in audit_query(log, newest=2).collect()] == [19, 20]


def test_agent_bench(spark):
    rows = [("a", i, float(l), 100, None) for i, l in enumerate([10, 20, 30, 40])] + [("b", 9, 5.0, 0, "y" * 130), ("b", 8, 5.0, 0, "first")]
    s = spark.createDataFrame(rows, "bridge string, seq int, latency_ms double, tokens_used int, error string")
    got = {r["bridge"]: r for r in bench_summary(s).collect()}
    a, b = got["a"], got["b"]
    assert (a["avg_latency_ms"], a["p50_latency_ms"], a["p95_latency_ms"], a["tokens_per_second"], a["avg_tokens_per_request"]) == (25.0, 20.0, 40.0, 4000.0, 100)
    assert (b["errors"], b["iterations"], b["avg_latency_ms"], b["total_tokens"]) == (2, 2, 0.0, 0)
    assert [r["bridge"] for r in bench_ranking(bench_summary(s)).collect()] == ["a", "b"]
    assert bench_winners(bench_summary(s)).first()["fastest"] == "a"
    e = bench_errors(s).first()
    assert (e["failures"], e["first_error"]) == ("2/2 failed", "first")


def test_metrics(spark):
    e = spark.createDataFrame([("1", "s", 0, 1), ("2", "s", 0, 9)], "event_id string, source_id string, timestamp int, v int")
    log = decision_log(e, [("low", F.col("v") < 5), ("next", F.lit(True))])
    assert {r["filter"]: (r["events_in"], r["events_out"], r["drop_rate"]) for r in filter_metrics(log).collect()} == {"low": (2, 1, 0.5), "next": (1, 1, 0.0)}
    lat = spark.createDataFrame([("1", 0, 100.0), ("2", 1, 200.0)], "event_id string, timestamp int, latency_ms double")
    assert avg_latency(lat).first()[0] == 150 and avg_latency(lat.where("false")).first()[0] == 0
    marks = spark.createDataFrame([(1, 1), (2, 1), (3, -1)], "at int, step int")
    assert {r["at"]: r["inflight"] for r in inflight(marks, ["at"]).collect()} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("pieces,key_rows", [(1024, 1_000_000), (3, 1_000_000), (3, 0)])
def test_ordered_concat_any_size(spark, monkeypatch, pieces, key_rows):
    monkeypatch.setattr(streams, "PIECES", pieces)
    monkeypatch.setattr(ordered, "MAX_KEY_ROWS", key_rows)
    rows = [("r", i, f"{i},") for i in range(20)] + [("q", 0, "z")]
    out = {r["k"]: r["text"] for r in ordered_concat(spark.createDataFrame(rows, "k string, i int, t string").repartition(4), ["k"], ["i"], "t").collect()}
    assert out == {"r": "".join(f"{i}," for i in range(20)), "q": "z"}


def test_streams(spark):
    chunks = [("r", 0, "text", "Hel", None), ("r", 1, "usage", None, 5), ("r", 2, "text", "lo", None), ("r", 3, "usage", None, 50), ("r", 4, "done", None, None), ("e", 0, "done", None, None)]
    got = {r["response_id"]: (r["content"], r["tokens_used"]) for r in assemble_stream(spark.createDataFrame(chunks, "response_id string, seq int, type string, text string, tokens_used int")).collect()}
    assert got == {"r": ("Hello", 50), "e": ("", 0)}
    body = spark.createDataFrame([("x", 'event: a\ndata: {"k":1}\ndata:nospace\ndata: [DONE]\ndata:   \n'), ("n", None)], "id string, body string")
    assert [(r["id"], r["data"]) for r in sse_data(body).collect()] == [("x", '{"k":1}')]
    nd = spark.createDataFrame([("x", '{"a":1}\n\n{bad\n {"b":2} \n{"c":3} x')], "id string, body string")
    assert [r["record"] for r in ndjson_lines(nd).collect()] == ['{"a":1}', '{"b":2}']
    talk = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "ai", "a2"), (1, 3, "user", "q2"), (2, 0, "user", "only")], "conv_id int, turn int, role string, text string")
    out = {r["conv_id"]: r["content"] for r in last_assistant(talk).collect()}
    assert out[1] == "a2" and json.loads(out[2]) == {"role": "user", "text": "only"}


def test_joins_reject_other_types(spark):
    with pytest.raises(ValueError):
        joins.lookup_join(spark.range(1), spark.range(1), ["id"], "full_outer")
