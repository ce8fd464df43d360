"""Stateful filters against brute force: expiry borders, global order, hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import ordered
from sieveline.operators.stateful import (
    adaptive_rate,
    adaptive_sample,
    batch_arrival,
    batch_tumbling,
    dedup_window,
    lazy_hours,
    rate_limit_sliding,
    rate_limit_tumbling,
    token_budget,
    velocity,
)

SCHEMA = "event_id string, source_id string, ms long, event_type string, priority int, payload string"


def frame(spark, rows):
    """rows: (id, source, milliseconds, priority, message)"""
    data = [(f"{i:06d}", s, ms, "DATA", p, f'{{"msg":"{m}"}}') for i, s, ms, p, m in rows]
    return spark.createDataFrame(data, SCHEMA).withColumn("timestamp", F.timestamp_millis("ms"))


def random_rows(seed, n=400, span=120_000):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["hot", "hot", "hot", "a"]), rnd.randrange(span), rnd.choice([1, 2, 3, 5, None]), rnd.choice("xyz")) for i in range(n)]


@pytest.fixture(params=["small keys", "hot keys"])
def layout(request, spark, monkeypatch):
    if request.param == "hot keys":
        monkeypatch.setattr(ordered, "MAX_KEY_ROWS", 0)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def in_order(rows):
    return sorted(rows, key=lambda r: (r[2], r[0]))


def passed(df):
    return sorted(int(r["event_id"]) for r in df.select("event_id").collect())


def test_dedup_border(spark, layout):
    # Accepted at 0; 9,999 ms later is a duplicate, 10,000 ms later is not; a
    # duplicate does not extend the window.
    rows = [(0, "s", 0, 3, "m"), (1, "s", 9_999, 3, "m"), (2, "s", 10_000, 3, "m"), (3, "s", 19_999, 3, "m"), (4, "s", 20_001, 3, "m"), (5, "s", 1, 3, "other")]
    assert passed(frame(spark, rows).transform(dedup_window(["payload.msg"], 10))) == [0, 2, 4, 5]


def test_dedup_missing_key(spark, layout):
    rows = [(0, "s", 0, 3, "m"), (1, "s", 10, 3, "n")]
    assert passed(frame(spark, rows).transform(dedup_window(["payload.absent"], 10))) == [0]
    assert passed(frame(spark, rows).transform(dedup_window(["payload.absent"], 10, missing_key="pass"))) == [0, 1]


def test_rate_limit_border(spark, layout):
    # A pass at 0 leaves the look-back exactly 60 s later.
    rows = [(0, "s", 0, 3, "m"), (1, "s", 30_000, 3, "m"), (2, "s", 59_999, 3, "m"), (3, "s", 60_000, 3, "m"), (4, "s", 60_001, 3, "m"), (5, "s", 90_000, 3, "m")]
    assert passed(frame(spark, rows).transform(rate_limit_sliding(2))) == [0, 1, 3, 5]


@pytest.mark.parametrize("by", [[], ["source_id"]])
def test_rate_limit_random(spark, layout, by):
    rows = random_rows(3)
    kept, want = {}, []
    for r in in_order(rows):
        seen = kept.setdefault(r[1] if by else "", [])
        if sum(1 for t in seen if t > r[2] - 5_000) < 3:
            seen.append(r[2])
            want.append(r[0])
    assert passed(frame(spark, rows).transform(rate_limit_sliding(3, 5, by))) == sorted(want)


def test_rate_limit_tumbling(spark):
    rows = [(i, "s", 1000 * i, 3, "m") for i in range(130)]
    assert passed(frame(spark, rows).transform(rate_limit_tumbling(2))) == [0, 1, 60, 61, 120, 121]


@pytest.mark.parametrize("by", [[], ["source_id"]])
def test_velocity_and_rate(spark, layout, by):
    rows = random_rows(5)
    config = dict(base_rate=0.5, min_rate=0.1, max_rate=1.0, window_seconds=10, high_velocity=2.6, low_velocity=2.2, partition_by=by)
    want, times, rate = {}, {}, {}
    for r in in_order(rows):
        k = r[1] if by else ""
        seen = times.setdefault(k, [])
        seen.append(r[2])
        v = sum(1 for t in seen if t >= r[2] - 10_000) / 10
        x = rate.get(k, 0.5)
        if v > 2.6:
            x = max(0.1, 0.8 * x)
        elif v < 2.2:
            x = min(1.0, 1.2 * x)
        rate[k] = x
        want[r[0]] = (v, x)
    got = frame(spark, rows).transform(adaptive_rate(**config)).collect()
    assert len(got) == len(rows)
    for g in got:
        v, x = want[int(g["event_id"])]
        assert g["velocity"] == pytest.approx(v) and g["sample_rate"] == pytest.approx(x, abs=1e-9)
    plain = frame(spark, rows).transform(velocity(10, by)).collect()
    assert {int(g["event_id"]): g["velocity"] for g in plain} == pytest.approx({i: v for i, (v, _) in want.items()})


def test_sampling_passes_urgent(spark):
    rows = [(i, "s", i, p, "m") for i, p in enumerate([1, 2, 3, None, 5])]
    kept = passed(frame(spark, rows).transform(adaptive_sample(base_rate=0.0, min_rate=0.0, max_rate=0.0)))
    assert kept == [0, 1]


def test_batches(spark, layout):
    rows = random_rows(8)
    batches, current, start = [], [], in_order(rows)[0][2]
    for r in in_order(rows):
        current.append(r)
        if r[2] - start >= 7_000 or len(current) >= 20:
            batches.append((current, False))
            current, start = [], r[2]
    if current:
        batches.append((current, True))
    got = {b["batch_no"]: b for b in frame(spark, rows).transform(batch_arrival(window_seconds=7, max_batch_size=20)).collect()}
    assert len(got) == len(batches)
    for i, (members, held) in enumerate(batches):
        assert [int(e["event_id"]) for e in got[i]["events"]] == [m[0] for m in members]
        assert got[i]["priority"] == min(m[3] or 3 for m in members)
        assert got[i]["is_held"] is held
        assert got[i]["source_ids"] == list(dict.fromkeys(m[1] for m in members))


def test_tumbling_batches(spark, layout):
    rows = [(i, "s", 100 * i, 3, "m") for i in range(25)]
    got = frame(spark, rows).transform(batch_tumbling("1 second", 4)).collect()
    assert sorted(b["batch_size"] for b in got) == [1, 2, 2, 4, 4, 4, 4, 4]


def test_budget(spark, layout):
    rows = [(i, "s", 60_000 * i, 3, "m") for i in range(65)]
    df = frame(spark, rows).withColumns({"agent_id": F.lit("a"), "tokens": F.lit(600), "max_per_hour": F.lit(1500)})
    sent = passed(df.transform(token_budget()).where("is_sent"))
    assert sent == [0, 1, 2, 60, 61, 62]
    free = df.withColumn("max_per_hour", F.lit(None).cast("int"))
    assert len(passed(free.transform(token_budget()).where("is_sent"))) == 65


def test_lazy_hours(spark, layout):
    rows = [(0, "s", 600_000, 3, "m"), (1, "s", 4_199_999, 3, "m"), (2, "s", 4_200_000, 3, "m"), (3, "s", 9_000_000, 3, "m")]
    got = {int(r["event_id"]): r["hour_no"] for r in lazy_hours(frame(spark, rows)).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 3}
