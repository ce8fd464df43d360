"""Near-duplicate documents by SetSketch registers, confirmed on full shingle sets.

1. Every text becomes its set of distinct five-word shingles (64-bit hashes).
   Texts with equal sets form a class; one representative goes on.
2. A SetSketch of the set: register i keeps the minimum of exponential variates
   of its elements, truncated to exponentially spaced values. Registers are
   mergeable by maximum (``merge_registers``).
3. Bands of three registers are hashed; classes that share a band are compared
   inside their bucket. The joint likelihood of the counts of larger, smaller
   and equal registers, at the known set sizes, tells whether the most likely
   similarity reaches ``FLOOR``, far below the threshold. Buckets yield spanning
   edges, never all pairs.
4. Components of those edges are candidate clusters. Every pair inside a
   cluster is decided on the full sets, in blocks of bounded size.
5. Components of the confirmed links give the result.

With 40 bands of 3 registers a pair at similarity 0.75 shares no band with a
probability of 3e-10, and is held below ``FLOOR`` with about 1e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import groups, stored
from sieveline.llm.components import connected_components

WORDS = 5
PERCENT = 75
BANDS, BAND_ROWS = 40, 3
REGISTERS = BANDS * BAND_ROWS
BASE, RATE, TOP = 1.001, 50.0, 65535
FLOOR = 0.53
CHUNK = 100_000  # shingles sketched at once: stays in the processor's cache
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 2_000_000
PAIRS = 4_000_000  # pairs counted at once
DENSE = 16  # shingles in more sets than this are counted by matrix products

_rng = np.random.default_rng(20240229)
MULTIPLIERS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = _rng.integers(0, 1 << 63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; fewer words give one shingle, no words none."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < WORDS:
        return mixed((hashes * PLACES[:n]).sum(keepdims=True) + np.uint64(n))
    total = hashes[: n - WORDS + 1] * PLACES[0]
    for k in range(1, WORDS):
        total += hashes[k : n - WORDS + 1 + k] * PLACES[k]
    return np.unique(mixed(total))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of non-empty sets, a row each.

    An element's variate for register i is exponential; its minimum over the set
    is taken on the uniform hash, as the transformation keeps the order.
    """
    x = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    least = np.empty((REGISTERS, len(sets)), np.uint64)
    for i in range(REGISTERS):
        least[i] = np.minimum.reduceat(x * MULTIPLIERS[i], starts)
    waiting = -np.log1p(-np.minimum((least.T.astype(np.float64) + 0.5) / 2.0**64, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(waiting) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge_registers(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(left, right)


def band_keys(regs: np.ndarray) -> np.ndarray:
    cut = regs.reshape(len(regs), BANDS, BAND_ROWS).astype(np.uint64)
    key = (cut * MIX).sum(axis=2) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(key).view(np.int64)


def _share(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that one register is larger, for the share x of the union that causes it, and its derivative."""
    step = (BASE - 1) / BASE
    inner = 1 - x * step
    return -np.log(inner) / np.log(BASE), step / inner / np.log(BASE)


def may_link(n: np.ndarray, regs: np.ndarray, other_n: np.ndarray, other: np.ndarray) -> np.ndarray:
    """True where the likeliest similarity is ``FLOOR`` or more and the sizes allow a link.

    The joint log-likelihood of the similarity is concave, so its maximum lies at
    or above ``FLOOR`` exactly where its slope there isn't negative.
    """
    fits = 100 * np.minimum(n, other_n) >= PERCENT * np.maximum(n, other_n)
    equal = (regs == other).sum(axis=1)
    more = (regs > other).sum(axis=1)
    fewer = REGISTERS - equal - more
    u = n / (n + other_n)
    v = 1 - u
    p, dp = _share(np.maximum(u - v * FLOOR, 1e-9))
    q, dq = _share(np.maximum(v - u * FLOOR, 1e-9))
    slope = -more * v * dp / p - fewer * u * dq / q + equal * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-9)
    return fits & (slope >= 0)


def bucket_edges(ids: np.ndarray, n: np.ndarray, regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member to the smallest id it is joined with inside a bucket.

    A member is compared with those only that aren't joined with it yet; every
    pair that may link ends in one component.
    """
    k = len(ids)
    label = np.arange(k)
    for i in range(k):
        rest = np.flatnonzero(label != label[i])
        if not len(rest):
            break
        rest = rest[may_link(n[i], regs[i], n[rest], regs[rest])]
        if len(rest):
            label[np.isin(label, label[rest])] = label[i]
    _, group = np.unique(label, return_inverse=True)
    least = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    low = least[group]
    far = low != ids
    return ids[far], low[far]


def linked_sets(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the pairs of sets that are linked: 100 * intersection >= 75 * union."""
    k = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(k), n)
    order = np.argsort(x := np.concatenate(sets), kind="stable")
    x, owner = x[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    count = np.diff(np.append(start, len(x)))
    both = np.zeros((k, k))
    for size in range(2, min(DENSE, k) + 1):
        rows = owner[start[count == size][:, None] + np.arange(size)]
        i, j = np.tril_indices(size, -1)
        for at in range(0, len(rows), most := max(1, PAIRS // len(i))):
            part = rows[at : at + most]
            both += np.bincount((part[:, i] * k + part[:, j]).ravel(), minlength=k * k).reshape(k, k)
    wide = np.flatnonzero(count > DENSE)
    for at in range(0, len(wide), 2048):
        part = wide[at : at + 2048]
        dense = np.zeros((len(part), k), np.float32)
        dense[np.repeat(np.arange(len(part)), count[part]), owner[np.concatenate([np.arange(s, s + c) for s, c in zip(start[part], count[part], strict=True)])]] = 1
        both += np.tril(dense.T @ dense, -1)
    both = both + both.T
    return 100 * both >= PERCENT * (n[:, None] + n[None, :] - both)


def link_edges(ids: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning star for each component of the linked sets."""
    linked = linked_sets(sets)
    k = len(ids)
    label = np.full(k, -1)
    for i in range(k):
        if label[i] >= 0:
            continue
        front = np.zeros(k, bool)
        front[i] = True
        while front.any():
            label[front] = i
            front = linked[front].any(axis=0) & (label < 0)
    _, group = np.unique(label, return_inverse=True)
    least = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    low = least[group]
    far = low != ids
    return ids[far], low[far]


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
        at = 0
        while at < len(texts):
            sets: list[np.ndarray] = []
            held = 0
            while at + len(sets) < len(texts) and held < CHUNK:
                sets.append(shingle_set(texts[at + len(sets)].as_py()))
                held += len(sets[-1])
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            regs = registers([sets[i] for i in full]) if len(full) else np.empty((0, REGISTERS), np.uint16)
            keys, row = band_keys(regs), iter(range(len(full)))
            place = [next(row) if m else None for m in n]
            sums = np.array([[s.sum(), mixed(s ^ MIX[0]).sum()] if len(s) else [0, 0] for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(at, len(sets)),
                    pa.array(n),
                    pa.array(sums[:, 0]),
                    pa.array(sums[:, 1]),
                    pa.array([None if p is None else regs[p].tobytes() for p in place], pa.binary()),
                    pa.array([[] if p is None else keys[p] for p in place], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "regs", "bands"],
            )
            at += len(sets)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in groups(batches, ["band"]):
        ids = group.column("doc_id").to_numpy()
        regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), np.uint16).reshape(len(ids), REGISTERS)
        a, b = bucket_edges(ids, group.column("n_shingles").to_numpy(), regs)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=EDGES)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in groups(batches, ["cluster", "left", "right"]):
        sets = [shingle_set(t) for t in group.column("text").cast(pa.binary()).to_pylist()]
        a, b = link_edges(group.column("doc_id").to_numpy(), sets)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=EDGES)


def _blocked(members: DataFrame) -> DataFrame:
    """(cluster, left, right, doc_id): every pair of a cluster's documents meets under one (left, right).

    A cluster of one block meets in (0, 0). Larger ones are dealt into blocks by
    a hash; a document goes to each pair of blocks that has its own.
    """
    sizes = members.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("sum"))
    cut = sizes.withColumn(
        "cut", F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("sum") / BLOCK_SHINGLES)).cast("long")
    ).where("docs > 1")
    own = F.pmod(F.xxhash64("doc_id"), F.col("cut"))
    return (
        members.join(cut.select("cluster", "cut"), "cluster")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
        .where("cut > 2 and own <> other or cut <= 2 and other = 0")
        .select(
            "cluster",
            F.when(F.col("cut") <= 2, F.lit(0)).otherwise(F.least("own", "other")).alias("left"),
            F.when(F.col("cut") <= 2, F.lit(0)).otherwise(F.greatest("own", "other")).alias("right"),
            "doc_id",
        )
    )


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Components of documents whose sets of five-word shingles are at least 0.75 similar.

    Returns a row for each input row: doc_id, n_shingles (size of its set),
    component_id (the smallest doc_id that is reachable, itself included), kept
    (doc_id = component_id). Null and empty texts, and those without words, have
    an empty set and are linked with nothing. Fewer than five words make one
    shingle. Rows with a null id take no part: component_id is null, kept true.
    Rows that share an id count as one document and each keep their row. Other
    columns are ignored; an empty table gives an empty result.
    """
    whole = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    sketch = stored(
        whole.mapInArrow(_sketched, "doc_id long, n_shingles long, d1 long, d2 long, regs binary, bands array<long>"),
        "sketches",
    )
    same = ["n_shingles", "d1", "d2"]
    own = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = stored(
        own.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("regs").alias("regs"), F.first("bands").alias("bands")),
        "classes",
    )
    banded = classes.select(F.explode("bands").alias("band"), F.col("rep").alias("doc_id"))
    buckets = (
        banded.groupBy("band")
        .agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.sum(F.hash("doc_id").cast("long")).alias("y"))
        .where("k > 1")
        .groupBy("k", "x", "y")  # buckets with the same members are looked at once
        .agg(F.min("band").alias("band"))
        .select("band")
    )
    inside = (
        banded.join(buckets, "band")
        .join(classes.select(F.col("rep").alias("doc_id"), "n_shingles", "regs"), "doc_id")
        .select("band", "doc_id", "n_shingles", "regs")
    )
    maybe = inside.repartition("band").sortWithinPartitions("band").mapInArrow(_candidates, "a long, b long")
    clusters = connected_components(maybe)
    members = clusters.select(F.col("a").alias("doc_id"), F.col("b").alias("cluster")).unionAll(
        clusters.select(F.col("b").alias("doc_id"), F.col("b").alias("cluster")).distinct()
    )
    sizes = classes.select(F.col("rep").alias("doc_id"), "n_shingles")
    blocked = _blocked(members.join(sizes, "doc_id"))
    met = blocked.join(whole, "doc_id").select("cluster", "left", "right", "doc_id", "text")
    keys = ["cluster", "left", "right"]
    links = met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_confirmed, "a long, b long")
    found = connected_components(links)
    reached = classes.select(*same, "rep").join(
        found.select(F.col("a").alias("rep"), F.col("b").alias("low")), "rep", "left"
    ).select(*same, F.coalesce("low", "rep").alias("component"))
    return (
        sketch.select("doc_id", *same)
        .join(reached, same, "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("c"))
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
