"""Streaming twins over several micro-batches against the batch operators."""

import json
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveline.operators.scoring import spent_in_hours
from sieveline.operators.stateful import adaptive_rate, batch_members, dedup_window, rate_limit_sliding
from sieveline.plans import live
from sieveline.session import scratch_path
from sieveline.streaming import batches
from sieveline.streaming import stateful as st
from sieveline.streaming.batches import batch_ends, batch_events_stream
from sieveline.streaming.documents import new_suggestions_stream
from sieveline.streaming.replies import assemble_live, whole_reply
from sieveline.streaming.sinks import run_actions, write_outbox

SCHEMA = "event_id string, source_id string, timestamp timestamp, event_type string, priority int, payload string"


@pytest.fixture(scope="module")
def table(spark):
    """Events in four files whose times do not overlap, so that arrival order is event order."""
    rnd = random.Random(4)
    times = sorted(rnd.sample(range(100_000), 240))
    rows = [(f"{i:04d}", rnd.choice(["a", "b"]), t, "DATA", rnd.choice([1, 3, None]), f'{{"m":"{rnd.choice("xy")}"}}') for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "event_id string, source_id string, ms long, event_type string, priority int, payload string").select(
        "event_id", "source_id", F.timestamp_millis("ms").alias("timestamp"), "event_type", "priority", "payload"
    )
    return df.orderBy("event_id")


def land(spark, table, cut):
    path = scratch_path(spark, "feed")
    for lo in range(0, 240, cut):
        table.where(F.col("event_id").cast("int").between(lo, lo + cut - 1)).coalesce(1).write.mode("append").parquet(path)
    return path


def drain(spark, stream):
    path = scratch_path(spark, "out")
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def feed(spark, table, cut=60):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(land(spark, table, cut))


def ids(df):
    return sorted(r["event_id"] for r in df.select("event_id").collect())


def test_dedup_arrival(spark, table):
    got = drain(spark, feed(spark, table).transform(st.dedup_stream(["payload.m"], 5)))
    assert ids(got) == ids(table.transform(dedup_window(["payload.m"], 5)))


def test_rate_limit_ordered(spark, table):
    # Rows behind the last watermark stay held; all others are decided as in batch.
    got = drain(spark, feed(spark, table).transform(st.rate_limit_stream(2, 5, ["source_id"], mode="ordered", delay="1 second")))
    want = table.transform(rate_limit_sliding(2, 5, ["source_id"]))
    limit = table.agg(F.max("timestamp") - F.expr("interval 1 second")).first()[0]
    assert ids(got) == ids(want.where(F.col("timestamp") <= F.lit(limit)))


def test_batches_and_rates(spark, table):
    got = drain(spark, feed(spark, table, 120).transform(st.batch_members_stream(9, 7, ["source_id"])))
    want = table.transform(batch_members(9, 7, ["source_id"]))
    key = lambda df: sorted((r["event_id"], r["batch_no"], r["is_flush"]) for r in df.collect())
    assert key(got) == key(want)
    rates = dict(base_rate=0.5, min_rate=0.1, max_rate=1.0, window_seconds=5, high_velocity=2.4, low_velocity=2.0, partition_by=[])
    stream = drain(spark, feed(spark, table, 120).transform(st.adaptive_sample_stream(**rates)))
    batch = {r["event_id"]: r["sample_rate"] for r in table.transform(adaptive_rate(**rates)).collect()}
    seen = stream.collect()
    assert len(seen) > 50
    for r in seen:
        assert r["sample_rate"] == pytest.approx(batch[r["event_id"]], abs=1e-9)
    urgent = ids(table.where("priority <= 2"))
    assert set(urgent) <= {r["event_id"] for r in seen}


def test_approximate_dedup_and_windows_compile(spark, table):
    got = drain(spark, feed(spark, table, 120).transform(st.dedup_stream_approximate(["payload"], 1000)))
    assert len(got.collect()) == 2
    w = drain(spark, feed(spark, table, 120).transform(st.window_summary_stream("10 seconds", delay="1 second")))
    assert w.agg(F.sum("batch_size")).first()[0] <= 240


def test_approval_stream(spark):
    base = scratch_path(spark, "approvals")
    spark.createDataFrame([("r1", 1_000_000), ("r2", 1_000_010), ("r4", 1_000_010), ("r5", 1_000_010), ("r3", 1_005_000)], "request_id string, s long").select(
        "request_id", F.timestamp_seconds("s").alias("request_ts")).coalesce(1).write.parquet(base + "/q")
    spark.createDataFrame([("r1", 1_000_020, 200, '{"approved":true}'), ("r2", 1_000_500, 200, '{"approved":true}'), ("r4", 1_000_020, 200, '{"approved":"true"}'), ("r5", 1_000_020, 200, '{"approved":false}'), ("r5", 1_000_030, 200, '{"approved":true}'), ("r9", 1_005_000, 200, "{}")], "request_id string, s long, status int, body string").select(
        "request_id", F.timestamp_seconds("s").alias("reply_ts"), "status", "body").coalesce(1).write.parquet(base + "/a")
    q = spark.readStream.schema("request_id string, request_ts timestamp").parquet(base + "/q")
    a = spark.readStream.schema("request_id string, reply_ts timestamp, status int, body string").parquet(base + "/a")
    rows = drain(spark, st.approval_stream(q, a)).collect()
    got = {r["request_id"]: r["is_approved"] for r in rows}
    got.pop("r5")  # two replies in one batch: one row, whichever came first
    # Text isn't the boolean true; r3 can still be answered.
    assert got == {"r1": True, "r2": False, "r4": False} and len(rows) == 4


def test_outbox_is_written_once_and_actions_run(spark):
    path = scratch_path(spark, "replies")
    text = '```json:actions\n[{"type":"hook","payload":{"n":1}},{"type":"bad"}]\n```'
    spark.createDataFrame([("1", text)], "event_id string, content string").write.parquet(path)
    stream = spark.readStream.schema("event_id string, content string").parquet(path)
    out, ck = scratch_path(spark, "outbox"), scratch_path(spark, "outbox-ck")
    for _ in range(2):
        write_outbox(stream, [("hook", "h")], out, ck, {"hook": lambda r: r["action_payload"]}).awaitTermination()
    got = {r["type"]: (r["success"], r["response"], r["handler"]) for r in spark.read.parquet(out).collect()}
    assert got == {"hook": (True, '{"n":1}', "h"), "bad": (False, None, None)}
    assert run_actions(spark.createDataFrame([], "type string"), {}).count() == 0


def test_state_of_a_key_ends_with_its_window(spark):
    path = scratch_path(spark, "keys")
    for i in range(4):  # four batches, far apart in time, with new keys in each
        spark.range(50).select(
            F.concat(F.lit(f"{i}-"), F.col("id").cast("string")).alias("event_id"), F.lit("s").alias("source_id"),
            F.timestamp_seconds(F.lit(i * 1000) + F.col("id") % 5).alias("timestamp"), F.lit("DATA").alias("event_type"), F.lit(1).alias("priority"),
            F.concat(F.lit('{"m":"'), F.lit(f"{i}-"), F.col("id").cast("string"), F.lit('"}')).alias("payload"),
        ).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path).transform(st.dedup_stream(["payload.m"], 5, mode="ordered", delay="1 second"))
    q = stream.writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(rows) < 200 and rows[-1] <= 110


def test_unknown_mode(table):
    with pytest.raises(ValueError):
        table.transform(st.rate_limit_stream(mode="sometimes"))


def test_batch_borders_in_any_cut():
    rng = random.Random(5)
    for _ in range(400):
        us = sorted(rng.randrange(60) for _ in range(rng.randrange(1, 30)))
        window, limit = rng.randrange(1, 15), rng.randrange(1, 7)
        want, start = [], None
        for t in us:
            if start is None or len(want[-1]) == limit or t >= start + window:
                want.append([])
                start = t
            want[-1].append(t)
        got, open_, start, held, at = [], [], None, 0, 0
        while at < len(us):
            part = us[at : at + rng.randrange(1, 8)]
            at += len(part)
            for lo, hi, start, leaves in batch_ends(np.array(part), start, held, window, limit):
                open_ += part[lo:hi]
                held = len(open_)
                if leaves:
                    got.append(open_)
                    open_, held = [], 0
        assert got + ([open_] if open_ else []) == want


def test_members_are_not_lost_over_micro_batches(spark, table):
    stream = feed(spark, table, 60).transform(batch_events_stream(["source_id"], 9, 4, mode="ordered", delay="1 second"))
    rows = drain(spark, stream).collect()
    limit = table.agg((F.max(F.unix_millis("timestamp")) - 1000).alias("w")).first()["w"]
    want, open_ = [], {}
    for r in sorted(table.collect(), key=lambda r: (r["timestamp"], r["event_id"])):
        at = round(r["timestamp"].timestamp() * 1000)
        batch = open_.get(r["source_id"])
        if batch is None or len(batch[1]) == 4 or at >= batch[0] + 9000:
            batch = open_[r["source_id"]] = (at, [])
            want.append(batch)
        batch[1].append((r["event_id"], at))
    closed = [[e for e, _ in m] for start, m in want if start + 9000 <= limit or (len(m) == 4 and m[-1][1] <= limit)]
    got = [[e["event_id"] for e in json.loads(r["payload"])["events"]] for r in rows]
    assert sorted(got) == sorted(closed) and len(got) > 20
    with pytest.raises(ValueError):
        batch_events_stream([])


def test_replies_wait_for_missing_chunks():
    chunks = [(2, "done", None, None), (0, "text", "a", None), (0, "text", "again", None), (0, "usage", None, 5), (1, "text", "b", None)]
    assert whole_reply(chunks) == ("ab", 5, True)
    assert whole_reply(chunks[:4]) == ("a", 5, False)
    assert whole_reply([(0, "text", "a", None), (1, "usage", None, 3), (2, "usage", None, None)]) == ("a", 3, False)
    assert whole_reply([(0, "done", None, None)]) == ("", 0, True)


def test_an_idle_reply_leaves_unfinished(spark):
    path, out = scratch_path(spark, "chunks"), scratch_path(spark, "out")
    rows = [("r", 0, "text", "half", None), ("s", 1, "done", None, None), ("s", 0, "text", "whole", None)]
    spark.createDataFrame(rows, "response_id string, seq long, type string, text string, tokens_used long").coalesce(1).write.parquet(path)
    stream = assemble_live(spark.readStream.schema("response_id string, seq long, type string, text string, tokens_used long").parquet(path), idle_seconds=1)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "ck")).trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            got = {r["response_id"]: (r["content"], r["is_whole"]) for r in spark.read.schema("response_id string, content string, is_whole boolean").parquet(out).collect()}
            if len(got) == 2:
                break
            time.sleep(1)
    finally:
        q.stop()
    assert got == {"r": ("half", False), "s": ("whole", True)}


def test_suggestions_are_seeded_forgotten_and_found_again(spark):
    path = scratch_path(spark, "snapshots")
    polls = [[("d", 1, ["a"]), ("e", 1, None)], [("d", 3, ["c", None]), ("d", 2, ["a", "b"])], [("d", 2, ["z"]), ("d", 4, ["a", "c"]), ("e", 2, ["x"])]]
    for rows in polls:
        spark.createDataFrame(rows, "doc_id string, poll int, suggestion_ids array<string>").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("doc_id string, poll int, suggestion_ids array<string>").option("maxFilesPerTrigger", 1).parquet(path)
    got = sorted(tuple(r) for r in drain(spark, new_suggestions_stream(stream)).collect())
    assert got == [("d", 2, "b"), ("d", 3, "c"), ("d", 4, "a"), ("e", 2, "x")]


STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def plain_session(spark):
    """A session that names no state store: Spark's default can't hold several variables."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    yield spark
    spark.conf.set(STORE, before)


def test_replies_need_no_setting_of_the_session(plain_session):
    path = scratch_path(plain_session, "chunks")
    rows = [("a", 0, "text", "hi", None), ("a", 1, "done", None, None)]
    plain_session.createDataFrame(rows, "response_id string, seq long, type string, text string, tokens_used long").coalesce(1).write.parquet(path)
    stream = plain_session.readStream.schema("response_id string, seq long, type string, text string, tokens_used long").parquet(path)
    assert [r["content"] for r in drain(plain_session, assemble_live(stream)).collect()] == ["hi"]


def test_batches_need_no_setting_of_the_session(plain_session, table):
    stream = feed(plain_session, table, 240).transform(batch_events_stream(["source_id"], 10, 20, mode="ordered"))
    assert drain(plain_session, stream).count() > 0


def test_suggestions_need_no_setting_of_the_session(plain_session):
    path, fields = scratch_path(plain_session, "snapshots"), "doc_id string, poll long, suggestion_ids array<string>"
    plain_session.createDataFrame([("d", 1, ["a"]), ("d", 2, ["a", "b"])], fields).coalesce(1).write.parquet(path)
    stream = plain_session.readStream.schema(fields).parquet(path)
    assert [r["suggestion_id"] for r in drain(plain_session, new_suggestions_stream(stream)).collect()] == ["b"]


class _Kept:
    """A value state outside of Spark that counts what it is asked."""

    def __init__(self):
        self.value, self.calls = None, []

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value


def _alone(fold):
    from pyspark.sql import types as T

    names = ["event_id", "priority", st.KEY, st.TIME]
    processor = st._Processor(fold, T.StructType([T.StructField(n, T.StringType()) for n in names]), False)
    processor.state = _Kept()
    return processor, lambda rows: pd.DataFrame(rows, columns=names)


def test_rejected_rows_end_in_the_state_processor():
    processor, frame = _alone(st._Accept(10, 1))
    rows = frame([("b", None, "k", 0), ("a", 1.0, "k", 0), ("c", 2.0, "k", 9_000_000), ("d", 3.0, "k", 10_000_000)])
    got = pd.concat(processor.handleInputRows(("k",), iter([rows]), None))
    assert got["event_id"].tolist() == ["a", "d"] and got["is_accepted"].all()
    assert processor.state.calls == ["get", "update"]
    assert list(processor.handleInputRows(("k",), iter([rows]), None)) == []


def test_chunks_of_a_key_are_not_put_together():
    processor, frame = _alone(st._Accept(10, 2))
    rows = [(f"{(i * 37) % 101:03d}" if i % 5 else None, float(i), "k", (i * 53 % 101) // 3 * 1_000_000) for i in range(101)]
    got = list(processor.handleInputRows(("k",), (frame(rows[i : i + 10]) for i in range(0, 101, 10)), None))
    assert len(got) > 1 and all(len(g) <= 10 for g in got)
    want, accepted = [], []
    for r in sorted(rows, key=lambda r: (r[3], r[0] is None, r[0] or "")):
        if sum(t > r[3] - 10_000_000 for t in accepted) < 2:
            accepted.append(r[3])
            want.append(r[1])
    assert sorted(pd.concat(got)["priority"]) == sorted(want)

    processor, frame = _alone(st._Batch(10, 4))
    got = pd.concat(processor.handleInputRows(("k",), (frame(rows[i : i + 10]) for i in range(0, 101, 10)), None))
    whole, _ = _alone(st._Batch(10, 4))
    one = pd.concat(whole.handleInputRows(("k",), iter([frame(rows)]), None))
    assert got.sort_values("priority")["batch_no"].tolist() == one.sort_values("priority")["batch_no"].tolist()


def test_rows_without_a_time_are_decided_last():
    for cut in (1, 3):
        processor, frame = _alone(st._Batch(10, 2))
        rows = frame([("b", 1.0, "k", 5.0), ("c", 2.0, "k", None), ("a", 3.0, "k", None), ("d", 4.0, "k", 1.0)])
        got = pd.concat(processor.handleInputRows(("k",), iter([rows[:cut], rows[cut:]]), None))
        assert got.set_index("event_id")["batch_no"][["d", "b"]].tolist() == [0, 0] and got["batch_no"].tolist().count(0) == 2


def test_what_agents_used_is_grouped_in_tasks_of_its_own(spark):
    replies = spark.createDataFrame(
        [(f"agent-{i % 3}", "2024-01-01 0%d:00:00" % (i % 2), 10, True, None, 100) for i in range(60)],
        "agent_id string, timestamp string, tokens long, is_sent boolean, error string, max_per_hour long",
    ).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    few = live.in_one_file(spent_in_hours(replies))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and plan.index("SinglePartition") < plan.index("HashAggregate")
    assert few.rdd.getNumPartitions() == 1
    assert sorted((r.agent_id, r._used) for r in few.collect()) == [(f"agent-{i}", 100) for i in range(3) for _ in range(2)]


class _Store:
    """State variables of one key outside of Spark; ``most`` is the largest write."""

    def __init__(self):
        self.values, self.timers, self.most = {}, set(), 0

    def _variable(self, name):
        store = self

        class Variable:
            exists = lambda _: name in store.values
            get = lambda _: iter(store.values[name]) if isinstance(store.values[name], list) else store.values[name]
            clear = lambda _: store.values.pop(name, None)
            getValue = lambda _, place: store.values[name][place]
            removeKey = lambda _, place: store.values[name].pop(place)

            def update(self, value):
                store.values[name] = value

            def put(self, rows):
                store.most = max(store.most, len(rows))
                store.values[name] = list(rows)

            def appendList(self, rows):
                store.most = max(store.most, len(rows))
                store.values.setdefault(name, []).extend(rows)

            def updateValue(self, place, value):
                store.values.setdefault(name, {})[place] = value

        return Variable()

    def getValueState(self, name, _):
        return self._variable(name)

    getListState = getValueState

    def getMapState(self, name, *_):
        return self._variable(name)

    def registerTimer(self, at):
        self.timers.add(at)


class _Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getCurrentProcessingTimeInMs = lambda: ms


def _batched(rows, window, limit):
    want = []
    for r in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or "")):
        if not want or len(want[-1]) == limit or r[0] >= want[-1][0][0] + window:
            want.append([])
        want[-1].append(r)
    return want


@pytest.mark.parametrize("ordered", [True, False])
def test_waiting_events_of_a_key_are_not_put_together(ordered, monkeypatch):
    monkeypatch.setattr(batches, "RUN_ROWS", 900, raising=False)
    monkeypatch.setattr(batches, "BLOCK_ROWS", 100, raising=False)
    rng, store = random.Random(8), _Store()
    processor = batches._Batches(3_000_000, 7, ordered)
    processor.init(store)
    rows = [(rng.randrange(600) * 1_000_000, rng.choice([None, f"{i:05d}"]), "s", "DATA", rng.choice([None, 1]), f"p{i}") for i in range(6000)]
    frames = lambda part: (pd.DataFrame(part[i : i + 200], columns=batches.NAMES) for i in range(0, len(part), 200))
    got = []
    if ordered:
        for part, watermark in ((rows[:4000], 0), (rows[4000:5950], 0), (rows[5950:], 0), ([], 200_000), ([], 200_500), ([], 700_000)):
            if part:
                got += processor.handleInputRows(("s",), frames(part), _Clock(watermark))
            elif any(t <= watermark for t in store.timers):
                store.timers = {t for t in store.timers if t > watermark}
                got += processor.handleExpiredTimer(("s",), _Clock(watermark), None)
        assert not store.values.get("blocks") and not store.values.get("waiting") and not store.values.get("runs")
    else:
        got += processor.handleInputRows(("s",), frames(rows), _Clock(5))
        assert store.timers == {3005}
        got += processor.handleExpiredTimer(("s",), _Clock(3005), None)
    found = pd.concat(got, ignore_index=True)
    assert found["batch_no"].tolist() == list(range(len(found)))
    want = _batched(rows, 3_000_000, 7)
    assert [[e["event_us"] for e in b] for b in found["events"]] == [[r[0] for r in b] for b in want]
    assert sorted(e["payload"] for b in found["events"] for e in b) == sorted(r[5] for r in rows)
    assert [e["event_id"] for b in found["events"] for e in b] == [r[1] for b in want for r in b]
    # Neither was the key in one value of the state, nor each batch in a frame of its own.
    assert store.most <= 100 and max(map(len, got)) < 300 and len(got) < len(found) / 5


def test_many_events_of_a_key_in_a_micro_batch(spark):
    path, rng = scratch_path(spark, "many"), random.Random(6)
    rows = [(f"{i:05d}", "a" if i % 9 else "b", rng.randrange(3_000_000), "DATA", rng.choice([1, None]), "{}") for i in range(7000)]
    table = spark.createDataFrame(rows, "event_id string, source_id string, ms long, event_type string, priority int, payload string")
    table = table.select("event_id", "source_id", F.timestamp_millis("ms").alias("timestamp"), "event_type", "priority", "payload")
    for k in range(2):
        table.where(F.col("event_id").cast("int") % 2 == k).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    # Nothing is late: the watermark is far behind, but for what the batches that have closed need.
    got = drain(spark, stream.transform(batch_events_stream(["source_id"], 30, 6, mode="ordered", delay="40 minutes"))).collect()
    limit, want = max(r[2] for r in rows) - 2_400_000, []
    for source in "ab":
        for b in _batched([(r[2], r[0]) for r in rows if r[1] == source], 30_000, 6):
            if b[0][0] + 30_000 <= limit or (len(b) == 6 and b[-1][0] <= limit):
                want.append([e for _, e in b])
    assert sorted([e["event_id"] for e in json.loads(r["payload"])["events"]] for r in got) == sorted(want) and len(want) > 100
