import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import recompression
from sieveline.llm.recompression import WINDOW, hashes, parse, remove_repeats, smallest_over, spans_of, witnesses
from sieveline.session import ship_package

SCHEMA = "doc_id long, text string, print string, n_words int, spans string, start int, first int, rows int"


def brute(rows):
    """Every window of every text."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    low = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - WINDOW + 1):
                s = tuple(w[k : k + WINDOW])
                low[s] = min(low.get(s, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - WINDOW + 1):
            if i is not None and low[tuple(w[k : k + WINDOW])] < i:
                gone |= set(range(k, k + WINDOW))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    ship_package()
    df = spark.createDataFrame([(i, t, "x", 1, "y", 2, 3, 4) for i, t in rows], SCHEMA).repartition(4)
    out = remove_repeats(df)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % min(int(rng.paretovariate(0.6)), 4000)
    passages = [[word() for _ in range(rng.choice([49, 50, 51, 60, 120]))] for _ in range(12)]
    passages += [["x"] * 60, ["a", "b"] * 40, ["a", "b", "c", "c", "c"] * 15, ["y"] * 200]
    rows = []
    for i in range(160):
        own = [word() for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            cut = rng.choice([0, 0, 0, 1, 5, 20])
            own += p[cut : len(p) - rng.choice([0, 0, 1, 9])] + [word() for _ in range(rng.randrange(30))]
        if rng.random() < 0.2:  # periods of many lengths, with other phases and lengths
            own += [str(k % rng.choice([1, 2, 3, 7, 60])) for k in range(rng.randrange(40, 300))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(own)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_equals_brute_force(spark, seed):
    rows = corpus(seed)
    whole = max((t for _, t in rows), key=len)
    rows += [(1000 + k, whole) for k in range(30)] + [(2000, whole.replace(" ", "\n")), (2001, " " + whole + "\n")]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "x"), (None, whole), (7, whole), (7, whole), (5000, "z " * 5000), (5001, "z " * 400)]
    rows += [(5002, "é " + whole), (5003, "\x1c".join(whole.split()))]
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(r[2] > 0 for r in got) > 30


def test_blocks_and_salts_change_nothing(spark, monkeypatch):
    rows = corpus(3)
    own = [hashes([t.encode().split()]) for _, t in rows[:25]]
    want = [{k: v for k, v in enumerate(witnesses(w).view(np.int64).tolist())} for w in own]
    for block, chunk in ((7, 100_000), (64, 1), (200_000, 300), (200_000, 100_000)):
        monkeypatch.setattr(recompression, "BLOCK", block)
        monkeypatch.setattr(recompression, "CHUNK", chunk)
        got = [{} for _ in own]
        for t, key, first, last in zip(*(c.tolist() for c in spans_of(own)), strict=True):
            got[t].update(dict.fromkeys(range(first, last + 1), key))
        assert got == want
    monkeypatch.setattr(recompression, "BLOCK", 64)
    for salts in (1, 50):
        monkeypatch.setattr(recompression, "SALTS", salts)
        assert run(spark, rows) == brute(rows)


def test_common_keys_are_dealt_by_names(spark, monkeypatch):
    rows = corpus(4)[:80]
    monkeypatch.setattr(recompression, "HOT", 2)
    monkeypatch.setattr(recompression, "PACK", 5)
    assert run(spark, rows) == brute(rows)


def test_neighbours_of_a_key_travel_as_one_row():
    words = [f"w{k}" for k in range(WINDOW + 99)] + ["x"] * 90
    ranges = [{"first": 0, "last": 99, "key": 5, "loose": False}, {"first": WINDOW + 99, "last": WINDOW + 139, "key": 0, "loose": True}]
    batch = pa.RecordBatch.from_pylist([{"row": 1, "doc_id": 2, "text": " ".join(words), "ranges": ranges}])
    got = [r for b in recompression._named([batch]) for r in b.to_pylist()]
    assert [(r["first"], r["last"], len(r["w1"]), len(r["w2"])) for r in got] == [(0, 62, 63, 63), (63, 99, 37, 37), (149, 189, 1, 1)]
    assert [r["key"] for r in got] == [5, 5, got[2]["w1"][0]] and len(set(got[0]["w1"] + got[1]["w1"])) == 100


def test_equal_passages_have_equal_witnesses():
    rng = np.random.default_rng(4)
    known = 0
    for _ in range(300):
        size = int(rng.choice([2, 3, 40, 5000]))
        words = lambda n: rng.integers(1, size + 1, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # noqa: B023, E731
        passage, seen = words(WINDOW), set()
        for _ in range(4):
            before = words(rng.integers(0, 90))
            seen.add(int(witnesses(np.concatenate([before, passage, words(rng.integers(0, 90))]))[len(before)]))
        assert len(seen) == 1
        known += 0 not in seen
    assert known > 280


def test_levels_shrink_and_cover_the_text():
    rng = np.random.default_rng(5)
    words = np.repeat(rng.integers(0, 1 << 62, 2000).astype(np.uint64), rng.choice([1, 1, 1, 4], 2000))
    sizes = []
    for _, start, end, _, _ in parse(words):
        assert start[0] == 0 and end[-1] == len(words) and (start[1:] == end[:-1]).all()
        sizes.append(len(start))
    assert sizes[1] < 2000 and all(b < 0.85 * a for a, b in zip(sizes[1:], sizes[2:], strict=False))


def test_smallest_over_ranges():
    rng = np.random.default_rng(6)
    for _ in range(50):
        many = int(rng.integers(1, 60))
        first = rng.integers(0, many, 20)
        last = np.minimum(first + rng.integers(-1, 30, 20), many - 1)
        key = rng.integers(1, 1000, 20).astype(np.uint64)
        want = [min((k for k, a, b in zip(key, first, last, strict=True) if a <= p <= b), default=0) for p in range(many)]
        assert smallest_over(key, first, last, many).tolist() == want


def test_no_rows(spark):
    assert run(spark, []) == []
