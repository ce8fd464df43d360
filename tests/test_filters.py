"""Stateless filters on small inline events."""

import json

import pytest
from pyspark.sql import functions as F

from sieveline.functions.json import is_json, is_json_array, is_json_nested
from sieveline.functions.paths import event_key, path_present, path_text, truthy
from sieveline.functions.redact import redact_fields
from sieveline.functions.text import describe_action, trim_all
from sieveline.functions.urls import url_guard
from sieveline.operators.rules import (
    filter_chain,
    priority_predicate,
    project_for_agent,
    rule_predicate,
    rules_predicate,
    tenant_isolation,
    trigger_predicate,
    with_metadata_text,
)
from sieveline.schema import EVENT_SCHEMA

ROWS = [
    ("1", "net", "DATA", 1, '{"ip":"192.168.0.9","port":22,"tags":["a","b"],"n":null}'),
    ("2", "net", "ALERT", 3, '{"ip":"10.0.0.1","port":443,"flag":false}'),
    ("3", "app", "ERROR", None, '{"msg":"disk full","port":"22","o":{"b":1,"a":2}}'),
    ("4", "app", "DATA", 5, "[1,2]"),
]


@pytest.fixture(scope="module")
def events(spark):
    rows = [(i, s, None, t, p, body, None, None) for i, s, t, p, body in ROWS]
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def ids(df):
    return sorted(r["event_id"] for r in df.collect())


def one(events, column, event_id="1"):
    return events.where(F.col("event_id") == event_id).select(column.alias("v")).first()["v"]


def test_paths(events):
    assert one(events, path_text("payload.tags.1")) == "b"
    assert one(events, path_text("payload.n")) == "null"
    assert one(events, path_text("payload.n.x")) is None
    assert one(events, path_text("payload.absent")) is None
    assert one(events, path_text("payload.__proto__")) is None
    assert one(events, path_text("payload.o"), "3") == '{"a":2,"b":1}'
    assert one(events, path_text("payload.1"), "4") == "2"
    assert one(events, path_present("payload.n")) is True
    assert one(events, path_present("payload.absent")) is False
    assert one(events, event_key(["payload.ip", "payload.port"])) == "192.168.0.9|22"
    assert one(events, event_key(["payload.absent", "source_id"])) == "|net"


@pytest.mark.parametrize(
    "rule,want",
    [
        ({"field": "payload.ip", "regex": r"^192\.168\."}, ["1"]),
        ({"field": "payload.port", "in": [22, 443]}, ["1", "2", "3"]),
        ({"field": "payload.port", "not_in": [443]}, ["1", "3"]),
        ({"field": "payload.msg", "match": "disk"}, ["3"]),
        ({"field": "payload.msg", "match": ""}, ["3"]),
        ({"field": "payload.n"}, ["1"]),
        ({"field": "payload.n", "match": "ul"}, ["1"]),
        ({"field": "payload.flag", "in": [False]}, ["2"]),
        ({"field": "payload.ip", "match": "10.", "regex": "192"}, ["2"]),
    ],
)
def test_rules(events, rule, want):
    assert ids(events.where(rule_predicate(rule))) == want


def test_rule_modes(events):
    assert len(ids(events.where(rules_predicate([], "all")))) == 4
    assert ids(events.where(rules_predicate([], "any"))) == []
    both = [{"field": "payload.port", "in": [22]}, {"field": "source_id", "in": ["app"]}]
    assert ids(events.where(rules_predicate(both))) == ["3"]
    assert ids(events.where(rules_predicate(both, "any"))) == ["1", "3", "4"]


def test_priorities(events):
    assert ids(events.where(priority_predicate(2, 5, True))) == ["1", "2", "3"]
    assert ids(events.where(priority_predicate(2, 5, False))) == ["1", "2", "3", "4"]
    # The high test comes first where the ranges overlap.
    assert ids(events.where(priority_predicate(5, 3, True))) == ["1", "2", "3", "4"]


def test_triggers(events):
    assert ids(events.where(trigger_predicate({"field": "payload.flag"}))) == []
    assert ids(events.where(trigger_predicate({"field": "payload.ip"}))) == ["1", "2"]
    assert ids(events.where(trigger_predicate({"field": "payload.ip", "match": "", "regex": "^10"}))) == ["2"]
    assert ids(events.where(truthy("payload.o"))) == ["3"]


def test_chain_order_and_projection(events):
    chain = filter_chain([lambda d: d.where("source_id = 'app'"), lambda d: d.limit(1)])
    assert len(ids(events.transform(chain))) == 1
    text = one(events, project_for_agent(), "3")
    assert text.startswith("New event received:\n\n")
    body = json.loads(text.split("\n\n", 1)[1])
    assert body["payload"]["msg"] == "disk full" and "raw" not in body and "priority" not in body


def test_tenants(spark, events):
    tenants = spark.createDataFrame([("net", True), ("app", False)], "id string, enabled boolean")
    with_meta = events.withColumn("metadata", F.lit('{"tenant_id":"old","n":1}'))
    out = with_meta.transform(tenant_isolation(tenants, F.col("source_id"))).collect()
    assert sorted(r["event_id"] for r in out) == ["1", "2"]
    assert json.loads(out[0]["metadata"]) == {"tenant_id": "net", "n": 1}
    assert json.loads(one(events, with_metadata_text(F.col("metadata"), "a", F.lit("b")))) == {"a": "b"}


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://example.com/x", "ok"),
        ("ftp://example.com", "protocol"),
        ("nonsense", "invalid"),
        ("http://localhost:80/", "host"),
        ("http://LOCALHOST/", "host"),
        ("http://[::1]/", "host"),
        ("http://10.9.8.7/", "private"),
        ("http://172.31.0.1/", "private"),
        ("http://172.32.0.1/", "ok"),
        ("http://169.254.169.254/latest", "private"),
        ("http://0.9.9.9/", "private"),
        ("http://127.0.0.2/", "ok"),
        ("http://10.example.com/", "ok"),
        ("http://2130706433/", "host"),
        ("http://0x7f000001/", "host"),
        ("http://127.1:80", "host"),
        ("http://0/", "host"),
        ("http://010.1/", "ok"),
        ("http://0xa.1/", "private"),
        ("http://user@192.168.0.1\\x", "private"),
        ("http://1.2.3.4.5/", "invalid"),
        ("http://09.1/", "invalid"),
        ("http://x:99999/", "invalid"),
        ("http://", "invalid"),
        ("http://a_b.example/a b|c", "ok"),
        (" https://example.com ", "ok"),
    ],
)
def test_url_guard(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(url_guard(F.col("u"))).first()[0] == want


@pytest.mark.parametrize(
    "text,valid",
    [
        ('{"a":1}', True), ("[]", True), ('"x"', True), ("12", True), ("null", True), (" [1] \n", True),
        ("42 errors", False), ('{"a":1} x', False), ("1,2", False), ("1],[2", False), ('1,"b":2', False),
        ('1},{"b":2', False), ("", False), ("  ", False), ("{", False), ("tru", False), ('{"a":1}{"b":2}', False),
    ],
)
def test_is_json(spark, text, valid):
    row = spark.createDataFrame([(text,)], "t string").select(
        is_json(F.col("t")).alias("j"), is_json_array(F.col("t")).alias("a"), is_json_nested(F.col("t")).alias("n")
    ).first()
    assert row["j"] is valid
    assert row["a"] is (valid and text.strip().startswith("["))
    assert row["n"] is (valid and text.strip()[:1] in ("[", "{"))


def test_redaction_and_texts(spark):
    doc = {"token": "abcdefgh", "x": {"password": "abc", "list": ["secret", {"apiKey": 'q"uoted long'}]}, "secret": ["keep"], "url": 5, "note": '"token":"abcdefgh"'}
    got = spark.createDataFrame([(json.dumps(doc),)], "d string").select(redact_fields(F.col("d"))).first()[0]
    assert json.loads(got) == {
        "token": "abcd***", "x": {"password": "***", "list": ["secret", {"apiKey": 'q"uo***'}]}, "secret": ["keep"], "url": 5, "note": '"token":"abcdefgh"'
    }
    row = spark.createDataFrame([("p" * 501, " \t x ﻿")], "p string, s string").select(
        describe_action(F.lit("t"), F.col("p")).alias("d"), trim_all(F.col("s")).alias("s")
    ).first()
    assert row["d"] == "[Approval Required]\nAction: t\nPayload: " + "p" * 500 + "... [truncated]"
    assert row["s"] == "x"


def test_url_guard_works_out_each_part_once(spark):
    plan = spark.createDataFrame([("http://a",)], "u string").select(url_guard(F.col("u")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") < 15 and plan.count("transform(") < 10
