"""Mixing, chat formatting, nearest neighbours, and the pipeline."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sieveline.llm import ann, chat
from sieveline.llm.mixing import mix, targets
from sieveline.llm.queries import thread_digests
from sieveline.session import ship_package

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string, size int, target string, copies int"


def mixed(spark, *rows):
    ship_package()
    return mix(spark.createDataFrame([(i, t, s, 1, "t", 2) for i, t, s in rows], DOCS)).toPandas()


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest, weights = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / weights > 3 * sizes[s]]
        if not over:
            return fixed | {s: rest * weight[s] / weights for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_targets_stop_at_three_times_the_source(spark):
    sizes = {"b": 1000, "a": 10, None: 400, "é": 5, "Z": 700, "z": 3}
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in targets(frame).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_meets_targets_with_ties_and_a_hot_source(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([1, 7, 40, 41, 300]), "hot" if i % 3 else rng.choice(["a", "b", None])) for i in range(3000)]
    rows += [(5000, None, "a"), (5001, "", None), (None, "one two", "b"), (7, "again", "a"), (7, "again", "a")]
    out = mixed(spark, *rows)
    assert len(out) == len(rows) and (out.taken <= 3 * out["size"]).all() and (out.taken == out["size"] * out.copies).all()
    by = out.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.taken - by.target) <= np.maximum(0.01 * by.target, 320)).all()
    again = mixed(spark, *rng.sample(rows, len(rows)))
    assert sorted(map(repr, out.values.tolist())) == sorted(map(repr, again.values.tolist()))


def test_mix_of_little(spark):
    assert len(mixed(spark)) == 0
    assert mixed(spark, (1, None, None)).taken.tolist() == [0]
    assert mixed(spark, (1, "a b c", "x")).taken.tolist() == [3]


TEXTS = ["", "</s>", "\\", "\\q</s>", "[INST]x[/INST]", "<<s>s>", "\\\\b", "<</SYS>>\n<s>", "plain é", "\\e"]


def test_escapes_are_reversible_and_leave_no_control_string(spark):
    rng = random.Random(2)
    alphabet = [c for c, _ in chat.ESCAPES] + [c for _, c in chat.ESCAPES] + ["<", "s", ">", "/", "x"]
    texts = TEXTS + ["".join(rng.choices(alphabet, k=8)) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in rows.withColumn("back", chat.unescaped(F.col("e"))).collect():
        assert r.back == r.t and not any(c in r.e for c, _ in chat.ESCAPES[1:])


def test_branches_are_ranked_and_read_back(spark):
    # 1 - 2 - 3, 2 - 4 - 5, 1 - 6; 9 hangs on nothing, 10 and 11 in a cycle.
    rows = [(1, None, "user", "q</s>", 0.0), (2, 1, "assistant", "a[INST]", 1.0), (3, 2, "user", "low", 0.5), (4, 2, "user", "high", 2.0), (5, 4, "assistant", "\\e", None), (6, 1, "assistant", "other", 5.0), (9, 8, "user", "x", 9.0), (10, 11, "user", "x", 9.0), (11, 10, "user", "x", 9.0)]
    frame = spark.createDataFrame([("t", *r) for r in rows] + [("u", 1, None, None, None, None)], "tree string, node long, parent long, role string, text string, score double")
    out = chat.read_back(chat.conversations(frame, None)).collect()
    assert sorted((r.tree, r.branch_rank, r.leaf, r.score, r.n_turns) for r in out) == [("t", 1, 6, 5.0, 2), ("t", 2, 5, 3.0, 4), ("t", 3, 3, 1.5, 3), ("u", 1, 1, 0.0, 1)]
    best = next(r for r in out if r.leaf == 5)
    assert [(t.role, t.text) for t in best.turns] == [("user", "q</s>"), ("assistant", "a[INST]"), ("user", "high"), ("assistant", "\\e")]
    assert best.loss == "a[INST]\\e"
    assert len(chat.conversations(frame).collect()) == 2 and chat.conversations(frame.limit(0)).collect() == []


def test_long_threads_take_few_rounds(spark):
    frame = spark.range(1, 400).select(F.lit("t").alias("tree"), F.col("id").alias("node"), F.expr("nullif(id - 1, 0)").alias("parent"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"), F.lit(1.0).alias("score"))
    (row,) = chat.read_back(chat.conversations(frame)).collect()
    assert row.n_turns == 399 and row.loss == "".join(map(str, range(1, 400)))


def test_digests_of_odd_turns(spark):
    import hashlib

    rows = [(1, 2, "user", None, 0), (1, 1, "assistant", "b", 0), (1, None, None, "c", 0), (1, 1, "assistant", "b", 0), (None, 5, "assistant", "x", 0)]
    out = {r.conv_id: r for r in thread_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, score int")).collect()}
    said = "assistant\nb\nassistant\nb\nuser\n\n\nc\n"
    assert out[1].n_turns == 4 and out[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and out[1].loss_chars == 2
    assert out[None].loss_sha256 == hashlib.sha256(b"x").hexdigest()
    plan = thread_digests(spark.createDataFrame(rows[:1], "conv_id long, turn long, role string, text string, score int"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_nearest(rows, queries, k=5):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], np.float64)
    norms = np.linalg.norm(v, axis=1)
    out = {}
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        scores = v @ v[at] / (norms * norms[at])
        out[q] = [int(ids[i]) for i in sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])) if ids[i] != q][:k]
    return out


def test_recall_of_the_graph_against_brute_force(spark):
    ship_package()
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    out = ann.search_nearest(table, F.col("vec_id") % 50 == 0).collect()
    want = brute_nearest(rows, [i for i, _ in rows if i % 50 == 0])
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = sum(len(set(got[q]) & set(w)) for q, w in want.items())
    assert hits >= 0.97 * sum(map(len, want.values()))
    by = {i: np.array(v, np.float64) for i, v in rows}
    for r in out:
        a, b = by[r.query_id], by[r.vec_id]
        assert r.score == pytest.approx(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), abs=1e-12)


def test_recall_over_several_shards(spark, monkeypatch):
    ship_package()
    monkeypatch.setattr(ann, "SHARD_ROWS", 300)
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(1500)]
    out = ann.search_nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    want = brute_nearest(rows, range(0, 1500, 50))
    assert sum(r.vec_id in want[r.query_id] for r in out) >= 0.97 * 150


def test_equal_vectors_and_odd_ones(spark):
    ship_package()
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(0, 400, 2)] + [(1, [3.0, 2.0, 1.0]), (3, None), (5, [0.0, 0.0, 0.0]), (7, [1.0, None, 1.0]), (9, [float("nan"), 1.0, 1.0]), (11, [float("inf"), 1.0, 1.0]), (None, same), (13, []), (15, [1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string")
    out = ann.search_nearest(frame, F.col("vec_id").isin(0, 100, 1, 3, 5, 15)).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [2, 4, 6, 8, 10], 100: [0, 2, 4, 6, 8], 1: [0, 2, 4, 6, 8]}
    assert ann.search_nearest(frame.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_vectors_of_one_direction_go_by_double_cosine_and_smaller_id(spark, monkeypatch):
    ship_package()
    monkeypatch.setattr(ann, "SHARD_ROWS", 400)
    rng = np.random.default_rng(8)
    base, near = rng.standard_normal((2, 16)).astype(np.float32)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(200)]
    rows += [(200 + i, (base * np.float32(2.0 ** (i % 20))).tolist()) for i in range(40)]  # exact multiples: ties
    rows += [(300 + i, (near * np.float32(1 + 0.37 * i)).tolist()) for i in range(300)]  # within a rounding of each other
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann.search_nearest(frame, F.col("vec_id").isin(200, 239, 300, 450, 7)).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    v = np.array([x for _, x in rows], np.float64)
    for q in got:
        at = next(x for i, x in rows if i == q)
        scores = (v * at).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((np.array(at) ** 2).sum()))
        assert got[q] == [i for _, i in sorted((-s, i) for s, (i, _) in zip(scores.tolist(), rows, strict=True) if i != q)][:5]
    assert got[200] == [201, 202, 203, 204, 205] and got[239] == [200, 201, 202, 203, 204]


def test_pipeline_stages_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][:2] == ["language identification", "toxicity"]
    odd = spark.createDataFrame([(None, "the of and is", None, None, None), (10_001, None, "en", "s", 0), (10_002, "", "en", "s", 0), (10_003, "12 34", "en", "s", 0)], docs.schema)
    out = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, stage(spark, out, SF)
        assert name == "source mixing" or out.columns == docs.columns
        out = out.checkpoint() if spark.sparkContext.getCheckpointDir() else out.cache()
        assert 0 < out.count() <= before.count()
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    assert None in kept and not kept & {10_001, 10_002, 10_003}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
