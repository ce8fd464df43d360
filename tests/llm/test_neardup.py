import random

import numpy as np
import pytest

from sieveline.llm.components import connected_components
from sieveline.llm.neardup import bucket_edges, link_edges, merge_registers, near_duplicates, registers, shingle_set
from sieveline.session import ship_package

SCHEMA = "doc_id long, text string, n_shingles int, band string, cluster string, kept int"


def brute(rows):
    def own(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {i: own(t) for i, t in rows}
    low = {i: i for i in sets}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            a, b = sets[i], sets[j]
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                low[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(spark, rows):
    ship_package()
    df = near_duplicates(spark.createDataFrame([(i, t, 7, "x", "y", 0) for i, t in rows], SCHEMA))
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return df.collect()


def test_families_chains_and_odd_texts(spark):
    rng = random.Random(7)
    words = ["w%d" % i for i in range(400)]
    rows = []
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([4, 5, 6, 30, 120]))]
        for copy in range(8):
            own = list(base)
            for _ in range(copy if len(base) > 20 else 0):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((family * 100 + copy, " ".join(own)))
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "one"), (5004, "ONE"), (5005, "one two"), (5006, "x " * 50_000), (5007, "X\n" * 30_000)]
    rng.shuffle(rows)
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found(spark, rows)} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found(spark, rows))


def test_one_large_group_of_near_copies_and_of_copies(spark):
    rng = random.Random(3)
    base = ["b%d" % i for i in range(90)]
    rows = [(i, " ".join(base)) for i in range(300)]
    for i in range(300, 700):
        own = list(base)
        own[rng.randrange(90)] = "new%d" % i
        rows.append((i, " ".join(own)))
    assert {r.component_id for r in found(spark, rows)} == {0}


def test_null_and_shared_ids_and_no_rows(spark):
    out = found(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "a b c d e f")])
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in out) == [(-1, None, True), (3, 3, True), (3, 3, True), (9, 3, False)]
    assert found(spark, []) == []


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64)) for _ in range(2))
    both = registers([a, b, np.union1d(a, b)])
    assert (merge_registers(both[0], both[1]) == both[2]).all()
    half = np.union1d(a[:3000], b[:1000])
    r = registers([a, half])
    assert abs((r[0] == r[1]).mean() - 3000 / 5000) < 0.2


@pytest.mark.parametrize("k", [2, 40, 300])
def test_links_inside_a_block_equal_brute_force(k):
    rng = random.Random(k)
    base = [rng.randrange(90) for _ in range(60)]
    texts = []
    for _ in range(k):
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(60)] = rng.randrange(1000)
        texts.append(" ".join(map(str, own)))
    ids = np.array(rng.sample(range(10_000), k))
    a, b = link_edges(ids, [shingle_set(t.encode()) for t in texts])
    got = dict(zip(ids.tolist(), ids.tolist(), strict=True)) | dict(zip(a.tolist(), b.tolist(), strict=True))
    assert got == {i: c for i, (_, c) in brute(list(zip(ids.tolist(), texts, strict=True))).items()}


def test_buckets_join_what_may_link_and_no_strangers():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    near = np.union1d(a[:480], rng.integers(0, 1 << 63, 20).astype(np.uint64))
    far = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    x, y = bucket_edges(np.array([7, 3, 5]), np.array([len(a), len(near), len(far)]), registers([a, near, far]))
    assert (x.tolist(), y.tolist()) == ([7], [3])


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, k) for k in range(2, 30)] + [(50, 50), (61, 60), (60, 61)]
    out = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 100 for i in range(101, 141)} | {k: 1 for k in range(2, 30)} | {61: 60}
    assert {r.a: r.b for r in out} == want and len(out) == len(want)
