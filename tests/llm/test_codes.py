import numpy as np
import pytest

from sieveline.llm import codes
from sieveline.session import ship_package

SCHEMA = "vec_id long, embedding array<double>, label int, code string, q int, error string, part int, n int"


def brute(rows, entries, rounds):
    """(code, error) by row and codebooks, every part against every entry in Python's integers."""
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in rows]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(order[0][1]) // 4
    cut = lambda q, p: q[p * w : (p + 1) * w]
    books = [[cut(q, p) for _, q in order[:entries]] for p in range(4)]

    def nearest(q, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(q, p), c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(4):
            own = {}
            for _, q in kept:
                own.setdefault(nearest(q, p)[1], []).append(cut(q, p))
            new.append([[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else c for e, c in enumerate(books[p])])
        books = new
    found = [[nearest(q, p) for p in range(4)] for _, q in kept]
    return [("".join(f"{e:02x}" for _, e in f), min(sum(d for d, _ in f), 2**63 - 1)) for f in found], books


def run(spark, rows, entries, rounds):
    ship_package()
    df = spark.createDataFrame([(i, v, label, "x", 1, "y", 2, 3) for i, v, label in rows], SCHEMA).repartition(5)
    coded, books = codes.compress_vectors(df, entries=entries, rounds=rounds)
    out = codes.with_label_error(coded)
    assert out.columns == ["vec_id", "label", "code", "error", "label_error"]
    return out.collect(), books


@pytest.mark.parametrize("scale, entries", [(1.0, 70), (3.0e4, 9), (2.0e9, 5)])
def test_codes_equal_brute_force(spark, scale, entries):
    rng = np.random.default_rng(int(scale))
    centres = rng.normal(size=(12, 8))
    rows = [(i, (scale * (centres[i % 12] + 0.2 * rng.normal(size=8))).tolist(), i % 3 or None) for i in range(400)]
    rows += [(1000 + i, [0.0] * 8, 1) for i in range(150)]  # ties and a hot vector
    got, books = run(spark, rows, entries, 4)
    want, own = brute(rows, entries, 4)
    assert books == own
    assert {r.vec_id: (r.code, r.error) for r in got} == {i: w for (i, _, _), w in zip(rows, want, strict=True)}
    by_label = {}
    for r in got:
        by_label[r.label] = by_label.get(r.label, 0) + r.error
    assert all(r.label_error == min(by_label[r.label], 2**63 - 1) for r in got)


def test_bounds_spare_scans_and_change_nothing():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(64, 4)) * 4000
    x = np.floor(centres[rng.integers(0, 64, 3000)] + rng.normal(size=(3000, 4)) * 30)
    history, code = [np.floor(centres)], None
    bounds, stamps = np.zeros((3000, 2)), np.zeros((3000, 2), np.uint8)
    for _ in range(4):
        part = codes.Part(history)
        code, best, bounds, stamps = part.assign(x, code, bounds, stamps)
        d = codes.squares(x, history[-1])
        assert (code == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        history.append(np.array([np.floor(x[code == e].mean(axis=0)) if (code == e).any() else history[-1][e] for e in range(64)]))
    assert part.rescanned < 0.1 * 6000


def test_net_displacement_is_below_the_sum_of_drifts():
    history = [np.array([[0.0, 0.0]]), np.array([[30.0, 40.0]]), np.array([[3.0, 4.0]])]
    assert codes.shift_of(history, history[-1])[:, 0] == pytest.approx([5, 45, 0], rel=1e-4)  # drifts since round 0: 50 + 45


def test_nulls_odd_lengths_repeats_and_no_rows(spark):
    good = [0.1, -0.2, 0.3, 0.4]
    rows = [(1, good, None), (1, good, None), (None, [9.0, 9.0, 9.0, 9.0], 2), (2, None, 2), (3, [1.0, None, 1.0, 1.0], 2)]
    rows += [(4, [1.0, float("nan"), 1.0, 1.0], 2), (5, [float("inf")] * 4, 2), (6, [1.0] * 8, 2), (0, [1.0] * 3, 2), (7, [], 2)]
    got, books = run(spark, rows, 256, 4)
    assert sorted((r.vec_id or -1, r.error, r.label_error) for r in got) == [(-1, 0, 0), (1, 0, 0), (1, 0, 0)]
    assert [len(b) for b in books] == [3] * 4
    assert run(spark, [], 256, 4) == ([], [[], [], [], []])
    assert run(spark, [(1, None, 1)], 256, 4)[0] == []
    huge, _ = run(spark, [(1, [1e300] * 4, 1), (2, [0.0] * 4, 1)], 1, 4)
    assert len(huge) == 2 and all(r.error >= 0 for r in huge)
