"""Sources: normalisation, validation, Kafka mapping, captures, polling, registry."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.plans.live import start_spec
from sieveline.plans.spec import compile_spec
from sieveline.session import scratch_path, ship_package
from sieveline.sources import json_blocks as jb
from sieveline.sources import normalize as n
from sieveline.sources.files import read_capture, read_lines
from sieveline.sources.kafka import decode_bus, encode_bus, kafka_events, kafka_options, replay_landed
from sieveline.sources.polling import RAW_SCHEMA, EventFeed, Poller, PollingSource, PollStreamReader, SourceRegistry, poll_status
from sieveline.sources.tail import ByteRange, TailReader, last_line_end, lines_of


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_normalize(spark):
    out = n.normalize_lines(n.non_blank_lines(lines(spark, '{"a":1}', "42 errors", " \t", "plain")), "feed").collect()
    assert [json.loads(r["payload"]) for r in out] == [{"a": 1}, {"data": "42 errors"}, {"data": "plain"}]
    assert {(r["source_id"], r["event_type"], r["priority"]) for r in out} == {("feed", "DATA", 3)}
    assert out[1]["raw"] == "42 errors"


def test_syslog(spark):
    rows = [("f", 0, "Timestamp header"), ("f", 1, "Timestamp kept"), ("f", 2, '{"not":"parsed"}'), ("f", 3, "")]
    df = spark.createDataFrame(rows, "file string, line_no int, value string")
    assert [json.loads(r["payload"])["data"] for r in n.syslog_lines(df, "sys").collect()] == ["Timestamp kept", '{"not":"parsed"}']


def test_validation_and_bus_round_trip(spark):
    good = {"event_id": "1", "source_id": "s", "timestamp": "2024-01-01T00:00:00.000Z", "event_type": "DATA", "payload": {"a": [1]}}
    bad = [
        {**good, "event_id": 1}, {**good, "event_type": "data"}, {**good, "payload": '{"a":1}'}, {**good, "payload": None},
        {k: v for k, v in good.items() if k != "source_id"},
    ]
    texts = [json.dumps(good), *map(json.dumps, bad), "broken {", json.dumps(good) + " x", json.dumps({**good, "event_id": "arr", "payload": [1]})]
    events = decode_bus(lines(spark, *texts))
    assert sorted(r["event_id"] for r in events.collect()) == ["1", "arr"]
    keep, quarantine = n.split_valid(events.withColumn("payload", F.when(F.col("event_id") == "arr", '"text"').otherwise(F.col("payload"))))
    assert keep.count() == 1 and quarantine.count() == 1
    wire = encode_bus(events.where("event_id = '1'"), "raw").first()
    assert wire["key"] == "s" and json.loads(wire["value"])["payload"] == {"a": [1]}
    assert {h["key"]: bytes(h["value"]).decode() for h in wire["headers"]} == {"event_type": "DATA", "priority": "3"}


def test_kafka_options():
    o = kafka_options(
        {"brokers": ["b1:9092", "b2:9092"], "topics": ["x", "y"], "from_beginning": True, "group_id": "g", "ssl": True,
         "sasl": {"mechanism": "scram-sha-256", "username": "u", "password": 'p"w'}}
    )
    assert o["kafka.bootstrap.servers"] == "b1:9092,b2:9092" and o["subscribe"] == "x,y" and o["startingOffsets"] == "earliest"
    assert o["kafka.security.protocol"] == "SASL_SSL" and o["kafka.sasl.mechanism"] == "SCRAM-SHA-256"
    assert 'password="p\\"w"' in o["kafka.sasl.jaas.config"] and o["kafka.group.id"] == "g"
    plain = kafka_options({"brokers": "b:9092", "topic": "t"})
    assert plain["startingOffsets"] == "latest" and "kafka.security.protocol" not in plain
    assert plain["kafka.session.timeout.ms"] == "30000"


def test_kafka_records(spark):
    rows = [("t", 2, 99, None, bytearray(b'{"status":"failed"}'), 1000), ("other", 0, 5, bytearray(b"k"), None, 2000)]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, key binary, value binary, s long").select(
        "*", F.timestamp_seconds("s").alias("timestamp"), F.expr("array(named_struct('key','h','value',cast('v' as binary)))").alias("headers")
    )
    got = {r["event_id"]: r for r in kafka_events(df, "src").collect()}
    meta = json.loads(got["t-2-99"]["metadata"])["kafka"]
    assert meta == {"topic": "t", "partition": 2, "offset": "99", "headers": {"h": "v"}, "timestamp": "1000000"}
    assert json.loads(got["other-0-5"]["payload"]) == {"data": ""}
    assert replay_landed(df, {"id": "s", "topic": "t", "committed": {"t": 99}}).count() == 0
    assert replay_landed(df, {"id": "s", "topic": "t", "committed": {"t": 99}, "from_beginning": True}).count() == 1
    assert replay_landed(df, {"id": "s", "topic": "t", "committed": {"t": {0: 500, 2: 98}}}).count() == 1
    assert replay_landed(df, {"id": "s", "topic": "t", "committed": {"t": {0: 500}}}).count() == 1
    assert replay_landed(df, {"id": "s", "topic": "t", "committed": {"t": {2: 99}}}).count() == 0


def odd_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind < 4:
        return [rng.randrange(100), rng.choice(["a,b", 'x"y', "[{", "back\\", '\\"', "]}", "\u00e9,", "line\nbreak", "", '\\\\",']), None, True][kind]
    if kind < 6:
        return {rng.choice("ab,[") + str(i): odd_value(rng, depth + 1) for i in range(rng.randrange(4))}
    return [odd_value(rng, depth + 1) for _ in range(rng.randrange(5))]


def odd_documents(rng, n):
    """Text of JSON documents over lines, and the values that must come out."""
    text, want = "", []
    for _ in range(n):
        doc = odd_value(rng)
        text += json.dumps(doc, indent=rng.choice([None, 1, 2])) + rng.choice(["\n", "\n\n", " \r\n"])
        want += doc if isinstance(doc, list) else [doc]
    return text, [json.dumps(v) for v in want]


def test_json_values_are_cut_alike_at_any_block_borders():
    rng = random.Random(1)
    for _ in range(1500):
        text, want = odd_documents(rng, rng.randrange(1, 5))
        records = text.encode().split(b",")
        cuts = sorted(rng.sample(range(len(records) + 1), min(len(records), rng.randrange(5))))
        state, out, held = jb.State(), [], []
        for lo, hi in zip([0, *cuts], [*cuts, len(records)], strict=True):
            if lo == hi:
                continue
            cutter, effects, values, middle = jb.Cutter(state), [jb.Effect(False), jb.Effect(True)], [], rng.randrange(lo, hi + 1)
            for part in (records[lo:middle], records[middle:hi]):
                if part:
                    piece = b",".join(part) + b","
                    values += cutter.add(piece)
                    for e in effects:
                        e.add(np.frombuffer(piece, np.uint8))
            if values:
                out += [b"".join(held) + values[0], *values[1:]]
                held = []
            held.append(b"".join(cutter.held))
            state = jb.after(state, (effects[0].summary(), effects[1].summary()))
            assert state == cutter.state
        out.append(b"".join(held))
        assert [json.dumps(json.loads(v)) for v in out if v.strip()] == want


@pytest.mark.parametrize("block", [200, 5000, 1 << 27])
def test_large_captures_are_read_by_blocks(spark, tmp_path, block):
    rng, want = random.Random(block), []
    for name in "abc":
        text, values = odd_documents(rng, 60)
        big = json.dumps([{"n": name + str(i), "t": "x" * rng.randrange(60) + ",["} for i in range(300)])
        (tmp_path / f"{name}.json").write_text(text + big + "\n" + text)
        want += values * 2 + [json.dumps(v) for v in json.loads(big)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        got = read_capture(spark, str(tmp_path))
        assert block > 5000 or got.rdd.getNumPartitions() > 8
        found = [json.dumps(json.loads(r["value"])) for r in got.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(found) == sorted(want)


def test_broken_captures_lose_their_own_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"f": "open\n}\n{"f": 1}\n]] }\n{"f": 2}\n42 errors\nnull\n[1, 2\n')
    assert sorted(r["value"] for r in read_capture(spark, str(tmp_path)).collect()) == ["1", "2", "null", '{"f": 1}', '{"f": 2}']


def test_capture_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"f": 1},\n {"f": 2}\n]')
    (tmp_path / "b.json").write_text('{\n "f": 3\n}')
    (tmp_path / "c.json").write_text('[{"f": 4},')
    got = sorted(json.loads(r["value"])["f"] for r in read_capture(spark, str(tmp_path)).collect())
    assert got == [1, 2, 3, 4]  # what is whole in a file that was cut off
    (tmp_path / "d.json").write_text('[\n{"f": 5}\n]\n[\n{"f": 6}, {"f": 7}\n]\n{\n"f": 8}')
    got = sorted(json.loads(r["value"])["f"] for r in read_capture(spark, str(tmp_path)).collect())
    assert got == [1, 2, 3, 4, 5, 6, 7, 8]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.log").write_text('{"f":1}\nnope\n\n{"f":2}\n')
    assert read_capture(spark, str(tmp_path / "l"), "ek").count() == 2
    assert read_lines(spark, str(tmp_path / "l")).count() == 3


def test_defaults_envelopes_health(spark):
    now = F.timestamp_seconds(F.lit(0))
    rec = spark.createDataFrame([('{"x":1}',), ('{"event_id":"e","payload":{"y":2},"priority":1}',)], "record string")
    out = {r["event_id"]: r for r in n.fill_event_defaults(rec, now=now).collect()}
    assert out["e"]["payload"] == '{"y":2}' and out["e"]["source_id"] == "bench" and out["e"]["priority"] == 1
    assert [r["payload"] for k, r in out.items() if k != "e"] == ['{"x":1}']
    polls = spark.createDataFrame([("resource", 'r"1', '{"a": 1}', None), ("tool", "t", "[1]", None), ("tool", "t", None, "no")], "kind string, name string, data string, error string")
    assert [json.loads(r[0]) for r in polls.select(n.poll_envelope()).collect()] == [
        {"resource": 'r"1', "data": {"a": 1}}, {"tool": "t", "data": [1]}, {"error": "no", "tool": "t"}
    ]
    fresh, cursor = n.poll_once(spark.createDataFrame([(1,), (2,), (3,)], "timestamp int"), F.lit(2))
    assert fresh.count() == 1 and tuple(cursor.first()) == (3, 1)
    _, same = n.poll_once(spark.createDataFrame([(1,)], "timestamp int"), F.lit(2))
    assert tuple(same.first()) == (2, 0)
    pairs = spark.createDataFrame([("error", "connected"), ("connected", "error"), ("degraded", "connected")], "p string, s string")
    assert [r[0] for r in pairs.select(n.composite_status(F.col("p"), F.col("s"))).collect()] == ["error", "degraded", "degraded"]


def test_registry(spark):
    registry = SourceRegistry()
    registry.register(EventFeed, "event texts", ["demo"])
    with pytest.raises(ValueError):
        registry.register(EventFeed)
    assert registry.has("event-feed") and registry.get("event-feed") is EventFeed
    assert [i["name"] for i in registry.search("DEMO")] == ["event-feed"] and registry.search("zzz") == []
    with pytest.raises(KeyError):
        registry.get("nope")


def counting():
    """A poller of texts up to a count kept in a file, whose ranges fail where a file says so, and its source."""

    class Counting(Poller):
        def __init__(self, path):
            self.path = path

        def newest(self):
            with open(f"{self.path}/newest") as f:
                return int(f.read())

        def fetch(self, start, end):
            for i in range(start, end):
                yield f'{{"i":{i}}}'
                if os.path.exists(f"{self.path}/broken-{i}"):
                    raise OSError(f"no page {i}")

    class CountingFeed(PollingSource):
        @classmethod
        def name(cls):
            return "counting-test"

        def poller(self):
            return Counting(self.options["path"])

    return Counting, CountingFeed


def test_polling_stream_fetches_on_executors_and_repeats_what_failed(spark, tmp_path):
    ship_package()
    spark.dataSource.register(counting()[1])
    out, checkpoint, status = (scratch_path(spark, n) for n in ("ticks", "ticks-ck", "ticks-status"))

    def run(newest, broken=()):
        for f in tmp_path.glob("broken-*"):
            f.unlink()
        if newest is not None:
            (tmp_path / "newest").write_text(str(newest))
        for i in broken:
            (tmp_path / f"broken-{i}").write_text("")
        stream = spark.readStream.format("counting-test").option("path", str(tmp_path)).option("step", 3).option("status", status).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted(json.loads(r["value"])["i"] for r in spark.read.schema(RAW_SCHEMA).parquet(out).collect())

    def told():
        return {r["name"]: (r["status"], r["attempt"], r["error"]) for r in poll_status(spark, status).collect()}

    assert run(10, [4]) == [0, 1, 2, 6, 7, 8, 9]  # the whole range 3 to 6 counts as failed
    assert told() == {"range-3-6": ("degraded", 0, "no page 4")}
    assert run(12, [4]) == [0, 1, 2, 6, 7, 8, 9, 10, 11]
    assert told()["range-3-6"] == ("degraded", 1, "no page 4")
    assert run(12) == list(range(12)) and told()["range-3-6"][:2] == ("connected", 2)
    assert run(12) == list(range(12))
    got = spark.read.format("counting-test").option("path", str(tmp_path)).option("start", 2).option("step", 4).load()
    assert got.rdd.getNumPartitions() == 3 and got.count() == 10


def test_a_poll_without_an_answer_keeps_the_cursor(tmp_path):
    reader = PollStreamReader(counting()[0](str(tmp_path)), 0, 5, str(tmp_path / "status"))
    (tmp_path / "newest").write_text("7")
    assert reader.latestOffset() == {"cursor": 7, "again": "[]"}
    (tmp_path / "newest").unlink()
    assert reader.latestOffset() == {"cursor": 7, "again": "[]"}
    assert json.loads((tmp_path / "status" / "newest.json").read_text())["status"] == "degraded"
    (tmp_path / "newest").write_text("9")
    assert reader.latestOffset()["cursor"] == 9
    assert json.loads((tmp_path / "status" / "newest.json").read_text())["status"] == "connected"
    assert [(p.start, p.end) for p in reader.partitions({"cursor": 0, "again": "[]"}, {"cursor": 7, "again": "[[1, 2, 1]]"})] == [(1, 2), (0, 5), (5, 7)]


def test_ranges_of_a_file_give_each_line_once(tmp_path):
    rng = random.Random(3)
    for _ in range(200):
        lines = ["x" * rng.randrange(12) + rng.choice(["", "é", "\r"]) for _ in range(rng.randrange(1, 20))]
        text = ("\n".join(lines) + "\n").encode()
        file = tmp_path / "f.log"
        file.write_bytes(text + b"unfinished")
        end = last_line_end(str(file))
        assert end == len(text)
        first = rng.choice([0, len(lines[0].encode()) + 1])
        cuts = sorted({first, end, *(rng.randrange(first, end + 1) for _ in range(4))})
        got = [line for lo, hi in zip(cuts, cuts[1:], strict=False) for line in lines_of(ByteRange(str(file), lo, hi, first))]
        assert [line.decode() for line, _ in got] == lines[1 if first else 0 :]
        assert all(text[at : at + len(line)] == line for line, at in got)


def test_tail_offsets(tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo")
    (tmp_path / ".hidden").write_text("x\n")
    reader = TailReader({"path": str(tmp_path), "blockbytes": "4", "triggerbytes": "10"})
    a, b = str(tmp_path / "a.log"), str(tmp_path / "b.log")
    start = reader.initialOffset()
    assert start == {"": 0, a: 4} and reader.latestOffset() == start
    (tmp_path / "a.log").write_text("one\ntwo three\n")
    (tmp_path / "b.log").write_text("new\n" * 9)
    end = reader.latestOffset()
    assert end == {"": 0, a: 14, b: 0}  # ten bytes at a time
    assert [(p.start, p.end) for p in reader.partitions(start, end)] == [(4, 8), (8, 12), (12, 14)]
    after = reader.latestOffset()
    assert after == {"": 0, a: 14, b: 8}
    (tmp_path / "a.log").write_text("cut\n")
    cut = reader.latestOffset()
    assert cut[a] == 4
    assert [(p.file, p.start, p.first) for p in reader.partitions(after, cut)][:1] == [(a, 0, 0)]
    (tmp_path / "a.log").write_text("a line beyond any trigger\n")
    (tmp_path / "b.log").unlink()
    assert reader.latestOffset() == {"": 0, a: 26}
    assert TailReader({"path": str(tmp_path), "from": "start"}).initialOffset() == {"": 0}


def test_a_specification_follows_log_files(spark, tmp_path):
    ship_package()
    (tmp_path / "logs").mkdir()
    log = tmp_path / "logs" / "app.log"
    log.write_text('{"level": "old"}\n')
    plan = compile_spec(
        {
            "sources": [{"id": "logs", "adapter": "native/log-tailer", "path": str(tmp_path / "logs"), "follow": True}],
            "filters": [{"type": "content-filter", "rules": [{"field": "payload.level", "in": ["error", "old"]}]}],
            "agent": {"runtime": "direct-llm", "model": "p/m", "system_prompt": "x"},
        }
    )
    for more in ("", '{"level": "error", "n": 1}\n{"level": "info"}\n\n{"level": "er', 'ror", "n": 2}\n'):
        with log.open("a") as f:
            f.write(more)
        start_spec(plan, spark, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "replies")).select("payload").collect()
    assert sorted(json.loads(r[0])["n"] for r in got) == [1, 2]
