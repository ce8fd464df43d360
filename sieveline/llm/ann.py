"""Approximate nearest neighbours by cosine: one navigable small-world graph per shard.

Equal vectors are joined first and stand for their smallest ids, as many as a
result can need. Distinct vectors are dealt into shards of bounded size; vectors
of one direction are one node of the shard's hierarchical graph, which is stored
as flat arrays of neighbours. Blocks of queries meet every shard, and each query's
results are merged. Every vector of every node found is scored in double precision
on the original vectors before results are cut.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import stored

NEAREST = 5
SHARD_ROWS = 4096
BLOCK_QUERIES = 512
LINKS = 16  # per node and upper layer; twice as many on the lowest
BUILD_WIDTH, SEARCH_WIDTH = 64, 96
SAME = 1e-6  # unit vectors that differ by no more in any component, some float32 roundings, are one direction


class Graph:
    """A hierarchical navigable small world over unit vectors, in flat arrays."""

    def __init__(self, unit: np.ndarray, levels: np.ndarray) -> None:
        n = len(unit)
        self.unit, self.levels = unit, levels
        self.first = np.concatenate([[0], np.cumsum(levels)])  # rows of a node's upper layers in ``upper``
        self.lowest = np.full((n, 2 * LINKS), -1, np.int32)
        self.upper = np.full((int(levels.sum()), LINKS), -1, np.int32)
        self.entry = -1
        self.seen = np.zeros(n, np.int32)
        self.stamp = 0

    def links(self, node: int, level: int) -> np.ndarray:
        """The node's row of neighbours on a layer; -1 where there is none."""
        return self.lowest[node] if not level else self.upper[self.first[node] + level - 1]

    def search(self, query: np.ndarray, entries: list[tuple[float, int]], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` nearest found on a layer as (similarity, node), nearest first."""
        self.stamp += 1
        best = sorted(entries)
        self.seen[[i for _, i in entries]] = self.stamp
        open_ = [(-s, i) for s, i in entries]
        heapq.heapify(open_)
        while open_:
            s, node = heapq.heappop(open_)
            if len(best) >= width and -s < best[0][0]:
                break
            near = self.links(node, level)
            near = near[near >= 0]
            near = near[self.seen[near] != self.stamp]
            if not len(near):
                continue
            self.seen[near] = self.stamp
            for sim, i in zip((self.unit[near] @ query).tolist(), near.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (sim, i))
                    heapq.heappush(open_, (-sim, i))
                elif sim > best[0][0]:
                    heapq.heapreplace(best, (sim, i))
                    heapq.heappush(open_, (-sim, i))
        return sorted(best, reverse=True)

    def _chosen(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions first: one that is nearer to a chosen one waits."""
        if len(found) <= most:
            return [i for _, i in found]
        ids = np.array([i for _, i in found])
        pairs = self.unit[ids] @ self.unit[ids].T
        nearest = np.full(len(ids), -2.0, np.float32)
        chosen, waiting = [], []
        for k, (sim, _) in enumerate(found):
            if len(chosen) == most:
                break
            if sim > nearest[k]:
                chosen.append(k)
                np.maximum(nearest, pairs[k], out=nearest)
            else:
                waiting.append(k)
        return ids[(chosen + waiting)[:most]].tolist()

    def _link(self, node: int, other: int, level: int) -> None:
        row = self.links(node, level)
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = other
            return
        ids = np.append(row, other)
        sims = self.unit[ids] @ self.unit[node]
        row[:] = self._chosen(sorted(zip(sims.tolist(), ids.tolist(), strict=True), reverse=True), len(row))

    def _descend(self, query: np.ndarray, to: int) -> list[tuple[float, int]]:
        at = [(float(self.unit[self.entry] @ query), self.entry)]
        for level in range(int(self.levels[self.entry]), to, -1):
            at = self.search(query, at, 1, level)
        return at

    def insert(self, node: int) -> None:
        if self.entry < 0:
            self.entry = node
            return
        query, own = self.unit[node], int(self.levels[node])
        at = self._descend(query, own)
        for level in range(min(own, int(self.levels[self.entry])), -1, -1):
            at = self.search(query, at, BUILD_WIDTH, level)
            row = self.links(node, level)
            chosen = self._chosen(at, LINKS)
            row[: len(chosen)] = chosen
            for other in chosen:
                self._link(other, node, level)
        if own > self.levels[self.entry]:
            self.entry = node

    def nearest(self, query: np.ndarray, k: int, width: int = SEARCH_WIDTH) -> list[int]:
        return [i for _, i in self.search(query, self._descend(query, 0), max(width, k), 0)[:k]]


def levels_of(ids: np.ndarray) -> np.ndarray:
    """A layer for each node, the same at every run: geometric in a hash of its id."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    uniform = ((x ^ (x >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.minimum(-np.log(np.maximum(uniform, 1e-300)) / math.log(LINKS), 30).astype(np.int64)


def build(unit: np.ndarray, ids: np.ndarray) -> Graph:
    graph = Graph(unit, levels_of(ids))
    for i in range(len(unit)):
        graph.insert(i)
    return graph


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def _directions(unit: np.ndarray) -> np.ndarray:
    """For each vector the first one of its direction: that within ``SAME`` of it in every component."""
    weights = np.random.default_rng(0).standard_normal(unit.shape[1])
    line = unit.astype(np.float64) @ weights  # vectors of one direction lie close together on it
    order = np.argsort(line, kind="stable")
    reach = 1.01 * SAME * np.abs(weights).sum()
    lows, highs = np.searchsorted(line[order], line - reach), np.searchsorted(line[order], line + reach, "right")
    owner = np.full(len(unit), -1, np.int32)
    for i in range(len(unit)):
        if owner[i] < 0:
            near = order[lows[i] : highs[i]]
            near = near[owner[near] < 0]
            owner[near[np.abs(unit[near] - unit[i]).max(axis=1) <= SAME]] = i
    return owner


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's rows (dim, shard, vec_id, ids, v) as one row of flat arrays."""
    rows = rows.sort_values("vec_id")
    vectors = np.stack(rows["v"].to_numpy()).astype(np.float64)
    unit = _unit(vectors)
    owner = _directions(unit)
    nodes, node = np.unique(owner, return_inverse=True)
    graph = build(unit[nodes], rows["vec_id"].to_numpy(np.int64)[nodes])
    count = np.array([len(i) for i in rows["ids"]], np.int32)
    return pd.DataFrame(
        {
            "dim": [rows["dim"].iloc[0]], "shard": [rows["shard"].iloc[0]], "vectors": [vectors.tobytes()],
            "count": [count.tobytes()], "ids": [np.concatenate(rows["ids"].to_numpy()).astype(np.int64).tobytes()],
            "nodes": [nodes.astype(np.int32).tobytes()], "node": [node.astype(np.int32).tobytes()],
            "levels": [graph.levels.tobytes()], "lowest": [graph.lowest.tobytes()], "upper": [graph.upper.tobytes()], "entry": [graph.entry],
        }
    )


SHARD = "dim int, shard int, vectors binary, count binary, ids binary, nodes binary, node binary, levels binary, lowest binary, upper binary, entry int"


def _searched(nearest: int):
    def search(shards: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s in shards.itertuples() if len(queries) else ():
            vectors = np.frombuffer(s.vectors).reshape(-1, s.dim)
            nodes, node = np.frombuffer(s.nodes, np.int32), np.frombuffer(s.node, np.int32)
            graph = Graph(_unit(vectors[nodes]), np.frombuffer(s.levels, np.int64))
            graph.lowest = np.frombuffer(s.lowest, np.int32).reshape(len(nodes), -1)
            graph.upper = np.frombuffer(s.upper, np.int32).reshape(-1, LINKS)
            graph.entry = s.entry
            members = np.split(np.argsort(node, kind="stable"), np.cumsum(np.bincount(node))[:-1])
            norms = np.sqrt((vectors * vectors).sum(axis=1))
            count = np.frombuffer(s.count, np.int32)
            starts, ids = np.cumsum(count) - count, np.frombuffer(s.ids, np.int64)
            wanted = np.stack(queries["v"].to_numpy()).astype(np.float64)
            units = _unit(wanted)
            for own, v, u in zip(queries["query_id"], wanted, units, strict=True):
                found = np.concatenate([members[k] for k in graph.nearest(u, max(SEARCH_WIDTH, nearest + 1))])
                # Row by row, so that equal rows have equal scores wherever they stand.
                scores = (vectors[found] * v).sum(axis=1) / (norms[found] * np.sqrt((v * v).sum()))
                many = count[found]
                named = ids[np.repeat(starts[found] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                scores = np.repeat(scores, many)
                best = {}
                for k in np.lexsort((named, -scores)):
                    if named[k] != own and named[k] not in best:
                        best[named[k]] = scores[k]
                        if len(best) == nearest:
                            break
                out += [(own, i, x) for i, x in best.items()]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return search


def build_index(vectors: DataFrame, nearest: int = NEAREST, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row of flat arrays for each shard; every valid vector is in one."""
    valid = _valid(vectors, id_column, vector_column)
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    # As many ids of equal vectors as a result can name, and one for the query itself.
    some = valid.withColumn("rank", rank).where(F.col("rank") <= nearest + 1)
    distinct = stored(
        some.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("v")), "vectors"
    )
    shards = distinct.groupBy("dim").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("shards"))
    dealt = distinct.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    # A shard takes many seconds but few bytes: without a number, small partitions would be put into one task.
    tasks = 2 * int(shards.agg(F.sum("shards")).first()[0] or 1)
    spread = dealt.repartition(tasks, "dim", "shard")
    return stored(spread.groupBy("dim", "shard").applyInPandas(_built, SHARD), "graphs")


def _valid(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    v = F.col(vector_column)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def search_nearest(
    vectors: DataFrame, is_query, nearest: int = NEAREST, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """The ``nearest`` other vectors of each query found, by cosine.

    ``is_query`` is a condition on the id column's value. Returns query_id, rank
    (from 1), vec_id, score; ties go to the smaller id; fewer rows where there are
    fewer candidates. Null ids, and vectors that are null, empty, zero or hold
    null or non-finite components, take no part. Vectors meet those of their own
    length. A repeated id counts as often as it occurs with different vectors.
    Other columns are ignored; an empty table gives an empty result.
    """
    index = build_index(vectors, nearest, id_column, vector_column)
    chosen = _valid(vectors.where(is_query), id_column, vector_column).select(
        F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim")
    )
    queries = stored(chosen.dropDuplicates(["query_id", "v"]), "queries")
    shards = index.groupBy("dim").agg(F.count("*").cast("int").alias("shards"))
    blocks = queries.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sent = queries.join(blocks, "dim").join(shards, "dim").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("shard", all_of("shards"))
    held = index.join(blocks, "dim").withColumn("block", all_of("blocks")).drop("blocks")
    keys = ["dim", "shard", "block"]
    found = (
        held.groupBy(*keys)
        .cogroup(sent.select(*keys, "query_id", "v").groupBy(*keys))
        .applyInPandas(_searched(nearest), "query_id long, vec_id long, score double")
    )
    # A repeated query id keeps the better score of a candidate.
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank.cast("int")).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
