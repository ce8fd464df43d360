"""Ordered scans against single-threaded brute force, with keys that span partitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import ordered
from sieveline.operators.ordered import (
    AcceptScan,
    BatchScan,
    ClampScan,
    SumScan,
    apply_scan,
    ordered_layout,
    running_sum,
)


@pytest.fixture()
def many_partitions(spark, monkeypatch):
    # Every key counts as hot, and the range partitions are not coalesced.
    monkeypatch.setattr(ordered, "MAX_KEY_ROWS", 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def make_rows(seed, n, span):
    rnd = random.Random(seed)
    # One key holds most of the rows, a few hold the rest.
    return [
        (i, rnd.choice(["hot"] * 8 + ["a", "b"]), rnd.randrange(span), float(rnd.choice([0.8, 1.2, 1.0])))
        for i in range(n)
    ]


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        groups.setdefault(r[1], []).append(r)
    return groups


def to_df(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, s long, a double").withColumn(
        "timestamp", F.timestamp_seconds("s")
    )


@pytest.mark.parametrize(
    "seed,n,span,window,limit",
    [
        (1, 600, 40_000, 60, 1),
        (2, 600, 900, 60, 1),
        (3, 800, 6_000, 60, 3),
        (4, 800, 60_000, 60, 5),
        (5, 500, 30, 60, 2),
        (6, 900, 3_000, 60, 20),
    ],
)
def test_accept_scan(spark, many_partitions, seed, n, span, window, limit):
    rows = make_rows(seed, n, span)
    want = set()
    for group in by_key(rows).values():
        kept = []
        for r in group:
            if sum(1 for t in kept if t > r[2] - window) < limit:
                kept.append(r[2])
                want.add(r[0])
    layout = ordered_layout(to_df(spark, rows), ["k"], ["id"])
    assert layout.df.select("_part").distinct().count() > 4
    got = apply_scan(layout, AcceptScan(window * 1_000_000, limit)).df.where("_accepted").select("id").collect()
    assert {r[0] for r in got} == want


@pytest.mark.parametrize("seed,n,span,window,limit", [(1, 600, 40_000, 600, 10), (2, 600, 2_000, 60, 7), (3, 700, 90_000, 100, 50)])
def test_batch_scan(spark, many_partitions, seed, n, span, window, limit):
    rows = make_rows(seed, n, span)
    want = set()
    for group in by_key(rows).values():
        start, held = group[0][2], 0
        for r in group:
            held += 1
            if r[2] - start >= window or held >= limit:
                want.add(r[0])
                start, held = r[2], 0
    layout = ordered_layout(to_df(spark, rows), ["k"], ["id"])
    got = apply_scan(layout, BatchScan(window * 1_000_000, limit)).df.where("_flush = 1").select("id").collect()
    assert {r[0] for r in got} == want


@pytest.fixture()
def runs(monkeypatch):
    """Partitions that each further pass looks at."""
    seen, run = [], ordered._run_again
    monkeypatch.setattr(ordered, "_run_again", lambda df, scan, entries: seen.append(len(entries)) or run(df, scan, entries))
    return seen


def one_key(spark, seed, n, span):
    rnd = random.Random(seed)
    times = sorted(rnd.randrange(span) for _ in range(n))
    df = spark.createDataFrame([(i, "hot", t) for i, t in enumerate(times)], "id long, k string, s long")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    layout = ordered_layout(df.withColumn("timestamp", F.timestamp_seconds("s")), ["k"], ["id"])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert layout.df.select("_part").distinct().count() > 50
    return times, layout


@pytest.mark.parametrize("seed,span,window,limit", [(1, 6000, 60, 50), (2, 6000, 60, 7), (3, 900, 4000, 13), (4, 50, 3, 1), (5, 30, 2, 2000), (6, 6000, 0, 5)])
def test_batches_without_pauses_need_one_probe(spark, many_partitions, runs, seed, span, window, limit):
    times, layout = one_key(spark, seed, 6000, span)
    want, start, held = set(), times[0], 0
    for i, t in enumerate(times):
        held += 1
        if t - start >= window or held >= limit:
            want.add(i)
            start, held = t, 0
    got = apply_scan(layout, BatchScan(window * 1_000_000, limit)).df.where("_flush = 1").select("id").collect()
    assert {r[0] for r in got} == want and runs == []


@pytest.mark.parametrize("seed,span,window,limit", [(1, 30_000, 60, 10), (2, 6000, 20, 3), (3, 40_000, 60, 5), (4, 900, 300, 70)])
@pytest.mark.parametrize("table", [200_000, 0])
def test_overloaded_limits_need_one_probe_or_few_runs(spark, many_partitions, runs, monkeypatch, seed, span, window, limit, table):
    monkeypatch.setattr(AcceptScan, "MAX_TABLE", table)
    times, layout = one_key(spark, seed, 12_000, span)
    want, kept = set(), []
    for i, t in enumerate(times):
        if len(kept) < limit or kept[-limit] <= t - window:
            kept.append(t)
            want.add(i)
    got = apply_scan(layout, AcceptScan(window * 1_000_000, limit)).df.where("_accepted").select("id").collect()
    assert {r[0] for r in got} == want
    # Without tables every pass settles a border at least, and guesses more.
    assert runs == [] if table else len(runs) < 64


def test_accept_table_equals_a_run_from_every_entry():
    rng = np.random.default_rng(9)
    for _ in range(2000):
        n, limit, window = int(rng.integers(1, 40)), int(rng.integers(2, 7)), int(rng.integers(0, 25))
        us = np.sort(rng.integers(100, 100 + int(rng.integers(1, 120)), n))
        scan = AcceptScan(window, limit)
        table = scan._table(us)
        for _ in range(10):
            entry = sorted(rng.integers(60, us[0] + 1, int(rng.integers(0, limit + 1))).tolist())
            assert scan._through(table, entry) == scan.step(list(entry), {"_us": us})[1]


def test_exit_table_equals_a_run_from_every_entry():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n, limit, window = int(rng.integers(1, 40)), int(rng.integers(0, 12)), int(rng.integers(0, 30))
        us = np.sort(rng.integers(100, 100 + int(rng.integers(1, 200)), n))
        scan, acc, at = BatchScan(window, limit), None, 0
        acc = scan.unknown()
        while at < n:
            size = int(rng.integers(1, 9))
            acc = scan.absorb(acc, {"_us": us[at : at + size]})
            at += size
        for start in range(60, 101, 3):
            for held in range(max(limit, 1)):
                want = scan.step((start, held), {"_us": us})[1]
                assert scan.resolve(acc, (start, held)) == want
                always = scan.resolve(acc, None)
                assert always is None or always == want


def test_clamp_scan(spark, many_partitions):
    rows = make_rows(9, 500, 10_000)
    df = to_df(spark, rows).withColumn("lo", F.when(F.col("a") < 1, 0.1).otherwise(0.0)).withColumn(
        "hi", F.when(F.col("a") > 1, 1.0).otherwise(float("inf"))
    )
    got = {r["id"]: r["_rate"] for r in apply_scan(ordered_layout(df, ["k"], ["id"]), ClampScan(0.5, "a", "lo", "hi")).df.collect()}
    for group in by_key(rows).values():
        r = 0.5
        for row in group:
            if row[3] < 1:
                r = max(0.1, 0.8 * r)
            elif row[3] > 1:
                r = min(1.0, 1.2 * r)
            assert got[row[0]] == r


def test_clamp_scan_from_zero_and_without_steps(spark, many_partitions):
    # Factors far above 1 on a rate of 0, and runs of rows that change nothing.
    rows = [(i, "hot", i, 1.2 if i < 400 else 1.0) for i in range(600)]
    df = to_df(spark, rows).withColumn("lo", F.lit(0.0)).withColumn("hi", F.lit(float("inf")))
    got = apply_scan(ordered_layout(df, ["k"], ["id"]), ClampScan(0.0, "a", "lo", "hi")).df
    assert {r["_rate"] for r in got.collect()} == {0.0}
    scan = ClampScan(0.3, "a", "lo", "hi")
    acc = scan.absorb(scan.unknown(), {"a": np.ones(5), "lo": np.full(5, 0.1), "hi": np.full(5, 0.25)})
    assert [scan.resolve(acc, e) for e in (None, 0.3, 0.2, 0.0)] == [None, 0.25, 0.2, 0.1]


def test_running_sum_over_hot_key(spark, many_partitions):
    rows = make_rows(11, 500, 10_000)
    got = {r["id"]: (r["_before"], r["_through"]) for r in running_sum(to_df(spark, rows), "s", ["k"], ["s", "id"]).collect()}
    for group in by_key(rows).values():
        total = 0
        for row in group:
            assert got[row[0]] == (total, total + row[2])
            total += row[2]


def test_every_row_survives(spark, many_partitions):
    rows = make_rows(12, 300, 100)
    layout = ordered_layout(to_df(spark, rows), [], ["id"])
    out = apply_scan(layout, SumScan("s")).df
    assert out.count() == 300
    assert np.isclose(out.agg(F.max("_through")).first()[0], sum(r[2] for r in rows))


@pytest.mark.parametrize("seed,span,window,rounds", [(1, 4_000, 20, 0), (2, 700, 3, 0), (3, 150, 60, 3)])
def test_dense_key_needs_few_rounds(spark, many_partitions, monkeypatch, seed, span, window, rounds):
    # No gap of a window anywhere: borders are settled by the step functions.
    rnd = random.Random(seed)
    rows = [(i, "hot", rnd.randrange(span), 1.0) for i in range(3000)]
    kept, want = None, set()
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        if kept is None or r[2] - kept >= window:
            kept = r[2]
            want.add(r[0])
    layout = ordered_layout(to_df(spark, rows), ["k"], ["id"])
    jobs, original = [], type(spark.sparkContext).runJob
    monkeypatch.setattr(type(spark.sparkContext), "runJob", lambda *a, **k: (jobs.append(1), original(*a, **k))[1])
    got = apply_scan(layout, AcceptScan(window * 1_000_000, 1)).df.where("_accepted").select("id").collect()
    assert {r[0] for r in got} == want
    assert len(jobs) <= rounds
