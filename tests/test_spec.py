"""Specifications: checks, defaults, filters, and one full run."""

import json
import shutil
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveline.operators.scoring import record_scorer, score, score_in_budget
from sieveline.plans import live
from sieveline.plans import spec as sp
from sieveline.schema import EVENT_SCHEMA

AGENT = {"runtime": "direct-llm", "model": "p/m", "system_prompt": "Look."}
BASE = {"sources": [{"id": "s", "adapter": "native/log-tailer"}], "agent": AGENT}


@pytest.mark.parametrize(
    "change",
    [
        {"sources": []},
        {"sources": [{"id": "s", "adapter": "unheard-of"}]},
        {"agents": [AGENT]},
        {"agent": None},
        {"agent": {**AGENT, "model": ""}},
        {"agent": {**AGENT, "sources": "s"}},
        {"agent": None, "agents": []},
        {"agent": None, "agents": [{**AGENT, "id": "x"}, {**AGENT, "id": "x"}]},
        {"filters": "dedup"},
        {"filters": [{"type": "unheard-of"}]},
        {"behavior": {"on_llm_unreachable": "panic"}},
    ],
)
def test_bad_specs(change):
    with pytest.raises(sp.SpecError):
        sp.compile_spec({**BASE, **change})


def test_defaults():
    one = sp.normalize_spec(BASE)
    assert one["agents"][0]["id"] == "default" and one["filters"] == []
    many = sp.normalize_spec({"sources": BASE["sources"], "agents": [AGENT, {**AGENT, "id": "named"}, AGENT]})
    assert [a["id"] for a in many["agents"]] == ["agent-0", "named", "agent-2"]


@pytest.fixture(scope="module")
def events(spark):
    rows = [(f"{i:03d}", "s" if i % 3 else "t", "DATA", [1, 3, 5, None][i % 4], f'{{"data":"line {i % 7}","n":{i}}}') for i in range(60)]
    return spark.createDataFrame(rows, "event_id string, source_id string, event_type string, priority int, payload string").select(
        "event_id", "source_id", F.timestamp_seconds(F.col("event_id").cast("long") * 2).alias("timestamp"), "event_type", "priority", "payload",
        F.lit(None).cast("string").alias("metadata"), F.lit(None).cast("string").alias("raw"),
    )


@pytest.mark.parametrize(
    "filters,count",
    [
        ([], 60),
        ([{"type": "rate-limiter", "max_events_per_minute": 10}], 20),
        ([{"type": "dedup", "window_seconds": 10, "key_fields": ["payload.data"]}], 60),
        ([{"type": "dedup", "window_seconds": 15, "key_fields": ["payload.data"]}], 32),
        ([{"type": "content-filter", "mode": "any", "rules": [{"field": "payload.data", "regex": "line [01]"}]}], 18),
        ([{"type": "priority-router", "drop_low_priority": True}], 45),
        ([{"type": "windowed-aggregation", "max_batch_size": 25, "window_seconds": 600}], 3),
        ([{"type": "windowed-aggregation", "max_batch_size": 25}, {"type": "content-filter", "rules": [{"field": "payload.batch_size", "in": [25]}]}], 2),
        ([{"type": "adaptive-sampling", "base_rate": 1.0}], 60),
    ],
)
def test_filter_types(events, filters, count):
    plan = sp.compile_spec({**BASE, "filters": filters})
    out = plan.filtered({"s": events})
    assert out.count() == count
    assert set(out.columns) == set(EVENT_SCHEMA.names)


def test_custom_filter_and_missing_source(events):
    sp.register_filter("odd-only", lambda c: lambda df: df.where(F.get_json_object("payload", "$.n").cast("int") % 2 == 1))
    plan = sp.compile_spec({**BASE, "filters": [{"type": "odd-only"}]})
    assert plan.filtered({"s": events}).count() == 30
    with pytest.raises(sp.SpecError):
        plan.filtered({})
    with pytest.raises(sp.SpecError):
        sp.register_filter("dedup", lambda c: None)


def test_full_run(events):
    calls = events.sparkSession.sparkContext.accumulator(0)

    def scorer(pdf):
        calls.add(len(pdf))
        out = pdf[["event_id"]].copy()
        out["content"] = '```json:actions\n[{"type":"webhook","payload":{}}]\n```'
        out["tokens"], out["latency_ms"] = 100, 1.0
        out["error"] = pdf["event_id"].map(lambda e: "down" if e == "001" else None)
        return out

    agents = [
        {**AGENT, "id": "all", "token_budget": {"max_per_hour": 950}, "actions": [{"type": "webhook", "name": "hook"}]},
        {**AGENT, "id": "only-t", "sources": ["t"]},
    ]
    out = sp.compile_spec({"sources": BASE["sources"], "agents": agents}).run({"s": events}, scorer)
    assert calls.value == 11 + 20  # none behind the budget
    # 11 calls fit into 950 tokens, one of which failed and costs nothing.
    assert out["passed"].where("agent_id = 'all'").count() == 10
    assert out["over_budget"].count() == 49
    assert out["passed"].where("agent_id = 'only-t'").count() == 20
    assert out["unrouted"].count() == 0
    assert out["alerts"].count() == 1
    assert {r["handler"] for r in out["actions"].collect()} == {"hook"} and out["actions"].count() == 30
    prompts = sp.compile_spec(BASE).requests(events).first()
    assert prompts["system_prompt"] == "Look." and prompts["agent_id"] == "default" and prompts["max_per_hour"] is None


def test_one_failing_event_fails_alone(events):
    def picky(pdf):
        if (pdf["event_id"] == "007").any():
            raise RuntimeError("seven")
        return pd.DataFrame({"content": pdf["event_id"], "tokens": 1, "latency_ms": 1.0, "error": None})

    out = score(events.select("event_id").withColumns({"agent_id": F.lit("a"), "prompt": F.lit("p")}), picky).collect()
    assert [r["event_id"] for r in out if r["error"]] == ["007"] and all(r["content"] == r["event_id"] for r in out if not r["error"])


def test_scorer_errors_are_rows(events):
    def broken(pdf):
        raise RuntimeError("no agent")

    asked = events.select("event_id").withColumns({"agent_id": F.lit("a"), "prompt": F.lit("p")})
    out = score(asked, broken).collect()
    assert len(out) == 60 and {r["error"] for r in out} == {"no agent"}


def test_record_scorers_are_asked_once_per_request(events, tmp_path):
    def picky(request):
        with open(tmp_path / f"{request['event_id']}-{time.time_ns()}", "x"):
            pass
        if request["event_id"] == "007":
            raise RuntimeError("seven")
        return {"content": request["event_id"], "tokens": 1, "latency_ms": 1.0, "error": None}

    out = score(events.select("event_id").withColumns({"agent_id": F.lit("a"), "prompt": F.lit("p")}), record_scorer(picky)).collect()
    assert [(r["event_id"], r["content"], r["error"]) for r in out if r["error"]] == [("007", None, "seven")]
    assert len(out) == 60 and all(r["content"] == r["event_id"] for r in out if not r["error"])
    assert len(list(tmp_path.iterdir())) == 60


def test_calls_are_spread_over_tasks(events):
    asked = events.select("event_id").withColumns({"agent_id": F.lit("a"), "prompt": F.lit("p")}).coalesce(1)
    assert score(asked).rdd.getNumPartitions() > 1


def test_live_run_of_files_without_a_table_given(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    spec = {
        "sources": [{"id": "s", "adapter": "native/log-tailer", "path": str(logs)}],
        "filters": [{"type": "content-filter", "rules": [{"field": "payload.level", "in": ["error"]}]}, {"type": "dedup", "key_fields": ["payload.msg"], "window_seconds": 600}],
        "agent": {**AGENT, "token_budget": {"max_per_hour": 25}, "actions": [{"type": "webhook"}]},
    }
    plan = sp.compile_spec(spec)

    def scorer(pdf):
        return pd.DataFrame({"content": '```json:actions\n[{"type":"webhook","payload":{}}]\n```', "tokens": 10, "latency_ms": 1.0, "error": None}, index=pdf.index)

    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for i in range(3):  # started anew for each file; state and budget go on
        lines = [f'{{"level":"error","msg":"m{i}"}}', f'{{"level":"error","msg":"m{i}"}}', '{"level":"info","msg":"x"}', "plain text", '{"level":"error","msg":"m0"}']
        (logs / f"{i}.log").write_text("\n".join(lines))
        live.start_spec(plan, spark, out, ck, scorer=scorer).awaitTermination()
    replies = spark.read.parquet(out + "/replies").collect()
    assert sorted(json.loads(r["payload"])["msg"] for r in replies) == ["m0", "m1", "m2"]
    assert all(r["is_sent"] for r in replies) and spark.read.parquet(out + "/actions").count() == 3
    (logs / "4.log").write_text('{"level":"error","msg":"late"}')
    live.start_spec(plan, spark, out, ck, scorer=scorer).awaitTermination()
    assert [json.loads(r["payload"])["msg"] for r in spark.read.parquet(out + "/replies").where("not is_sent").collect()] == ["late"]
    assert plan.filtered({}).count() == 4  # the same files as a table
    with pytest.raises(sp.SpecError):
        live.stream_filter({"type": "no-such-filter"})


def test_live_budgets_need_no_earlier_replies_and_batches_run_once(spark, tmp_path):
    rows = [(f"{i:03d}", "s", 60 * i, "DATA", 3, f'{{"n":{i}}}', None, None) for i in range(24)]
    df = spark.createDataFrame(rows, "event_id string, source_id string, s long, event_type string, priority int, payload string, metadata string, raw string")
    df = df.withColumn("timestamp", F.timestamp_seconds(F.col("s") + 1_700_000_000 // 3600 * 3600)).select(*live.COLUMNS)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def every(n):
        seen.add(1)
        return True

    plan = sp.compile_spec({"sources": [{"id": "s"}], "agents": [{**AGENT, "id": "capped", "token_budget": {"max_per_hour": 100}}, {**AGENT, "id": "free"}]})
    feed, out, ck = (str(tmp_path / n) for n in ("feed", "out", "ck"))
    scorer = record_scorer(lambda r: {"content": r["event_id"], "tokens": 10, "latency_ms": 0.0, "error": "down" if r["event_id"] == "003" else None})
    sent = []
    for half in range(2):
        for k in range(6):  # two events a micro-batch
            lo = 12 * half + 2 * k
            df.where(F.col("event_id").cast("int").between(lo, lo + 1)).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(feed).where(every("event_id"))
        live.start_spec(plan, spark, out, ck, {"s": stream}, scorer).awaitTermination()
        replies = spark.read.parquet(out + "/replies")
        sent += [r["event_id"] for r in replies.where("is_sent and agent_id = 'capped'").collect()]
        assert replies.where("is_sent and agent_id = 'free'").count() == 12
        shutil.rmtree(out + "/replies")
    assert sorted(sent) == [f"{i:03d}" for i in range(11)]  # one failed call costs nothing
    assert seen.value == 24
    assert [tuple(r) for r in spark.read.parquet(out + "/budgets").where("batch_id = 11").select("agent_id", "_used").collect()] == [("capped", 100)]


def test_failed_requests_are_asked_again_with_a_later_micro_batch(spark, tmp_path):
    rows = [(f"{i}", "s", 60 * i, "DATA", 3, f'{{"n":{i}}}', None, None) for i in range(8)]
    df = spark.createDataFrame(rows, "event_id string, source_id string, s long, event_type string, priority int, payload string, metadata string, raw string")
    df = df.withColumn("timestamp", F.timestamp_seconds("s")).select(*live.COLUMNS)
    behavior = {"on_llm_unreachable": "buffer_limited", "retry_limit": 2, "max_attempts": 3, "retry_seconds": 0}
    plan = sp.compile_spec({"sources": [{"id": "s"}], "agent": {**AGENT, "token_budget": {"max_per_hour": 1000}}, "behavior": behavior})
    # 0 fails once, 1 always; 2 to 5 fail in one micro-batch, which is more than the queue holds.
    fails = {"0": 1, "1": 9, "2": 1, "3": 1, "4": 1, "5": 1}
    scorer = record_scorer(lambda r: {"content": r["event_id"], "tokens": 1, "latency_ms": 0.0, "error": "down" if r["attempt"] < fails.get(r["event_id"], 0) else None})
    feed, out, ck = (str(tmp_path / n) for n in ("feed", "out", "ck"))
    for lo, hi in ((0, 1), (2, 2), (3, 5), (6, 6), (7, 7)):
        df.where(F.col("event_id").cast("int").between(lo, hi)).coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    live.start_spec(plan, spark, out, ck, {"s": stream}, scorer).awaitTermination()
    told = spark.read.parquet(out + "/replies").collect()
    assert sorted((r["event_id"], r["attempt"]) for r in told if r["error"] is None) == [("0", 1), ("2", 1), ("3", 1), ("4", 1), ("6", 0), ("7", 0)]
    assert [r["event_id"] for r in spark.read.parquet(out + "/overflow").collect()] == ["5"]
    assert [(r["event_id"], r["attempt"]) for r in spark.read.parquet(out + "/given_up").collect()] == [("1", 3)]


def test_budget_skips_to_rows_with_another_cap(spark):
    rows = [("a", f"{i:02d}", i, 30 if i < 6 else 60, "p") for i in range(12)]
    df = spark.createDataFrame(rows, "agent_id string, event_id string, s long, max_per_hour long, prompt string").withColumn("timestamp", F.timestamp_seconds("s"))
    for scorer in (record_scorer(lambda r: {"content": r["prompt"], "tokens": 10, "latency_ms": 0.0, "error": None}), lambda f: f.assign(content="p", tokens=10, latency_ms=0.0, error=None)):
        got = {r["event_id"]: (r["is_sent"], r["tokens_before"], r["content"]) for r in score_in_budget(df.drop("s"), scorer).collect()}
        assert [i for i in sorted(got) if got[i][0]] == ["00", "01", "02", "06", "07", "08"]
        assert got["04"] == (False, 30, None) and got["07"] == (True, 40, "p") and got["11"] == (False, 60, None)


def test_windowed_aggregation_runs_live(spark, tmp_path):
    rows = [(f"{i}", "s" if i < 7 else "t", 10 * i, "DATA", 1 + i % 3, f'{{"n":{i}}}', None, None) for i in range(9)]
    df = spark.createDataFrame(rows, "event_id string, source_id string, s long, event_type string, priority int, payload string, metadata string, raw string")
    df.withColumn("timestamp", F.timestamp_seconds("s")).select(*live.COLUMNS).coalesce(1).write.parquet(str(tmp_path / "feed"))
    spec = {"sources": [{"id": "s"}], "filters": [{"type": "windowed-aggregation", "window_seconds": 1, "max_batch_size": 3, "summary_prompt": "Sum up."}], "agent": AGENT}
    stream = spark.readStream.schema(df.withColumn("timestamp", F.timestamp_seconds("s")).select(*live.COLUMNS).schema).parquet(str(tmp_path / "feed"))
    query = live.start_spec(sp.compile_spec(spec), spark, str(tmp_path / "out"), str(tmp_path / "ck"), {"s": stream}, trigger={"processingTime": "1 second"})
    try:
        # In event time every event is behind the window of the one before; the last ones leave by the clock.
        schema = "event_id string, payload string, batch_id int"
        for _ in range(90):
            if (tmp_path / "out" / "replies").exists() and spark.read.schema(schema).parquet(str(tmp_path / "out" / "replies")).count() == 9:
                break
            time.sleep(1)
    finally:
        query.stop()
    got = [json.loads(r["payload"]) for r in spark.read.parquet(str(tmp_path / "out" / "replies")).collect()]
    assert sorted(e["payload"]["n"] for b in got for e in b["events"]) == list(range(9))
    assert all(b["batch_size"] == 1 and b["window_prompt"] == "Sum up." for b in got)


def test_a_changed_specification_on_an_old_checkpoint(spark, tmp_path):
    rows = [(f"{i}", "s", 10 * i, "DATA", 3, f'{{"n":{i % 3},"k":"{"ab"[i % 2]}"}}', None, None) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id string, source_id string, s long, event_type string, priority int, payload string, metadata string, raw string")
    df = df.withColumn("timestamp", F.timestamp_seconds("s")).select(*live.COLUMNS)
    feed, out, ck = (str(tmp_path / n) for n in ("feed", "out", "ck"))

    def run(lo, hi, filters):
        df.where(F.col("event_id").cast("int").between(lo, hi)).coalesce(1).write.mode("append").parquet(feed)
        plan = sp.compile_spec({"sources": [{"id": "s"}], "filters": filters, "agent": AGENT})
        live.start_spec(plan, spark, out, ck, {"s": spark.readStream.schema(df.schema).parquet(feed)}).awaitTermination()
        return sorted(int(r["event_id"]) for r in spark.read.parquet(out + "/replies").collect())

    rule = lambda k: {"type": "content-filter", "rules": [{"field": "payload.k", "in": k}]}
    dedup = {"type": "dedup", "key_fields": ["payload.n"], "window_seconds": 1000}
    assert run(0, 3, [rule(["a"]), dedup]) == [0, 2]
    # Another rule, one filter more and a longer window: what was seen stays known.
    assert run(4, 9, [rule(["a", "b"]), {"type": "priority-router"}, {**dedup, "window_seconds": 2000}]) == [0, 2, 4]
    for other in ([rule(["a"]), {**dedup, "key_fields": ["payload.k"]}], [rule(["a"])], [{"type": "rate-limiter"}, dedup]):
        with pytest.raises(sp.SpecError, match="dedup|rate-limiter"):
            run(10, 11, other)
