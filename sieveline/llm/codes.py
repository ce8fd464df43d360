"""Vector code compression: product codes by k-means with norm-of-sum bounds.

Each of ``PARTS`` equal parts of a vector gets the index of its nearest codebook
entry, over integers, so that every run gives the same codes. An assignment pass
over Spark keeps, for each part, bounds on the distance to groups of entries,
each with the stamp of the round it was measured in. The driver holds the history
of all codebooks; a bound is moved to the present by the true net displacement of
its entries since its stamp, the norm of the sum of all their steps, never the sum
of the steps' norms. Where the own entry, measured exactly, stays below a group's
bound, the group isn't looked at; otherwise it is rescanned exactly.

Means come from sums that are kept between rounds: a pass sends the difference
made by parts that changed their entry, at most one row per task and entry. The
driver sees codebooks and their sums only, whose size doesn't depend on the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import forget, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
GROUP = 32  # entries that share a bound
EXACT = 1 << 21  # up to this size of components squared distances are exact in doubles
SLACK = 1e-5  # more than the rounding of square roots and of 32-bit bounds

KEPT = "vec_id {id}, label {label}, q array<long>"
STATE = "codes binary, bounds binary, stamps binary"
DELTA = "part int, entry int, n long, sums array<decimal(38,0)>"
NAMES = ["vec_id", "label", "q", "codes", "bounds", "stamps", "part", "entry", "n", "sums"]
ADDED = [pa.binary()] * 3 + [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))]


def integers(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(vec_id, label, q) of the rows that take part; q holds floor(1024 * x), stopping at the range of long."""
    x = F.col(vector_column)
    whole = x.isNotNull() & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    kept = vectors.where(whole & (F.size(x) > 0) & (F.size(x) % PARTS == 0)).select(
        F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"),
        F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("q"),
    )
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "q").select(F.size("q")).first()
    return kept.where(F.size("q") == (first[0] if first else 0))


def numbers(column: pa.Array, size: int) -> np.ndarray:
    """A column of arrays as a matrix: doubles where they are exact, Python's integers beyond."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    small = not flat.size or max(abs(int(flat.min())), abs(int(flat.max()))) <= EXACT
    return flat.astype(np.float64) if small else flat.astype(object)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    kind = np.float64 if x.dtype == np.float64 and entries.dtype == np.float64 and x.shape[1] <= 256 else object
    x, entries = x.astype(kind), entries.astype(kind)
    return (x * x).sum(axis=1)[:, None] - 2 * x.dot(entries.T) + (entries * entries).sum(axis=1)[None, :]


def shift_of(history: list[np.ndarray], now: np.ndarray) -> np.ndarray:
    """Net displacement of every entry since each round of the history, rounded up."""
    step = [np.sqrt(np.array(((now - then) ** 2).sum(axis=1), np.float64)) for then in history]
    return np.array(step).reshape(len(history), len(now)) * (1 + SLACK)


class Part:
    """Assignment of one part's rows to one codebook, given the earlier codebooks."""

    def __init__(self, history: list[np.ndarray]) -> None:
        self.now, self.stamp = history[-1], len(history) - 1
        self.groups = -(-len(self.now) // GROUP)
        self.shift = shift_of(history, self.now)
        pad = np.zeros((len(history), self.groups * GROUP))
        pad[:, : len(self.now)] = self.shift
        self.group_shift = pad.reshape(len(history), self.groups, GROUP).max(axis=2)  # the most that any entry of a group moved
        self.rescanned = 0

    def own(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Exact squared distance to the entry that a row has."""
        entries = self.now.astype(x.dtype) if x.dtype == object or self.now.dtype != object else self.now
        return ((x.astype(entries.dtype) - entries[code]) ** 2).sum(axis=1)

    def assign(self, x: np.ndarray, code: np.ndarray | None, bounds: np.ndarray, stamps: np.ndarray):
        """New codes, squared distances, bounds and stamps. Without codes everything is scanned."""
        rows, new = len(x), code is None
        code = np.zeros(rows, np.int64) if new else code.astype(np.int64)
        best = self.own(x, code)
        radius = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
        old, old_best = code.copy(), best.copy()
        bounds, stamps = bounds.astype(np.float64), stamps.copy()
        found = []
        for g in range(self.groups):
            low = bounds[:, g] - self.group_shift[np.minimum(stamps[:, g], self.stamp), g]
            need = np.ones(rows, bool) if new else radius >= low
            at = np.flatnonzero(need)
            self.rescanned += len(at)
            if not len(at):
                continue
            d = squares(x[at], self.now[g * GROUP : (g + 1) * GROUP])
            place = d.argmin(axis=1)
            least = d[np.arange(len(at)), place]
            d[np.arange(len(at)), place] = np.inf
            second = d.min(axis=1) if d.shape[1] > 1 else np.full(len(at), np.inf)
            place = place + g * GROUP
            closer = (least < best[at]) | ((least == best[at]) & (place < code[at]))
            code[at[closer]], best[at[closer]] = place[closer], least[closer]
            found.append((g, at, place, least, second))
        for g, at, place, least, second in found:
            other = np.where(place == code[at], second, least).astype(np.float64)  # the nearest entry besides the own one
            bounds[at, g], stamps[at, g] = np.sqrt(other) * (1 - SLACK), self.stamp
        moved = np.flatnonzero(old != code)
        home = old[moved] // GROUP
        # An entry that was left counts for its group again, which may not have been scanned.
        back = bounds[moved, home] - self.group_shift[np.minimum(stamps[moved, home], self.stamp), home]
        bounds[moved, home] = np.minimum(back, np.sqrt(old_best[moved].astype(np.float64)) * (1 - SLACK))
        stamps[moved, home] = self.stamp
        return code, best, bounds, stamps


def _differences(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, held: dict[int, list]) -> None:
    """Add to ``held`` what the sums and counts of entries change by."""
    for code, sign in ((old, -1), (new, 1)):
        if code is None or not len(code):
            continue
        order = np.argsort(code, kind="stable")
        entries, start = np.unique(code[order], return_index=True)
        sums = np.add.reduceat(x[order], start, axis=0)
        for e, n, s in zip(entries.tolist(), np.diff(np.append(start, len(code))).tolist(), sums, strict=True):
            have = held.setdefault(e, [0, [0] * x.shape[1]])
            have[0] += sign * n
            have[1] = [a + sign * int(b) for a, b in zip(have[1], s, strict=True)]


def _pass(history: list[list[np.ndarray]], dim: int, last: bool):
    """An assignment pass: rows with their new state, and rows (part, entry, n, sums) with what sums change by.

    The last pass yields codes and errors instead.
    """
    width = dim // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [Part(h) for h in history]
        groups = parts[0].groups if parts else 0
        held: list[dict] = [{} for _ in range(PARTS)]
        kinds: list[pa.DataType] = []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            kinds = batch.schema.types[:3] + ADDED
            x = numbers(batch.column(2), dim)
            first = batch.num_columns == 3
            if first:
                codes, bounds, stamps = None, np.zeros((n, PARTS, groups)), np.zeros((n, PARTS, groups), np.uint8)
            else:
                codes, bounds, stamps = (
                    np.frombuffer(b"".join(batch.column(k).to_pylist()), kind).reshape(n, PARTS, -1)
                    for k, kind in ((3, np.uint8), (4, np.float32), (5, np.uint8))
                )
            new, errors, new_bounds, new_stamps = [], [], [], []
            for p, part in enumerate(parts):
                own = x[:, p * width : (p + 1) * width]
                before = None if first else codes[:, p, 0].astype(np.int64)
                code, best, b, s = part.assign(own, before, bounds[:, p], stamps[:, p])
                if not last:
                    moved = np.arange(n) if first else np.flatnonzero(before != code)
                    _differences(own[moved], None if first else before[moved], code[moved], held[p])
                for into, value in ((new, code), (errors, best), (new_bounds, b), (new_stamps, s)):
                    into.append(value)
            code = np.stack(new, axis=1).astype(np.uint8)
            if last:
                most = (1 << 63) - 1
                error = [min(int(e), most) for e in sum(e.astype(object) for e in errors)]
                text = [row.tobytes().hex() for row in code]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])
                continue
            b = np.nextafter(np.stack(new_bounds, axis=1).astype(np.float32), np.float32(-np.inf))
            s = np.stack(new_stamps, axis=1).astype(np.uint8)
            state = [pa.array([row.tobytes() for row in a], pa.binary()) for a in (code, b, s)]
            yield _rows([batch.column(0), batch.column(1), batch.column(2), *state], kinds)
        sums = [(p, e, k, [Decimal(v) for v in s]) for p in range(PARTS) for e, (k, s) in sorted(held[p].items())]
        if sums:
            yield _rows([None] * 6 + list(zip(*sums, strict=True)), kinds)

    return run


def _rows(columns: list, kinds: list[pa.DataType]) -> pa.RecordBatch:
    """A batch of state rows or of sums; the columns of the other kind are null."""
    size = len(next(c for c in columns if c is not None))
    columns = columns + [None] * (len(kinds) - len(columns))
    arrays = [pa.nulls(size, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=NAMES)


def _means(now: list[np.ndarray], totals: dict[tuple[int, int], list]) -> list[np.ndarray]:
    """Every entry that is used becomes the floor of its parts' mean."""
    out = [c.astype(object) for c in now]
    for (p, e), (n, sums) in totals.items():
        if n:
            out[p][e] = [s // n for s in sums]
    return [_compact(c) for c in out]


def _compact(book: np.ndarray) -> np.ndarray:
    small = not book.size or max(abs(int(v)) for v in book.ravel()) <= EXACT
    return book.astype(np.float64 if small else object)


def compress_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, label, code, error) of each row that takes part, and the final codebooks by part and entry.

    Rows whose vector is null or holds null or non-finite components are dropped,
    and so are vectors whose length isn't that of the row with the smallest id, or
    isn't a positive multiple of four. Codebooks start from the smallest ids (ties
    by vector); null ids come last there, so they start codebooks only where
    other ids are too few. Fewer rows than entries make smaller codebooks.
    Repeated ids keep a row each. Floors and errors stop at the range of long.
    Other columns are ignored; an empty table gives no rows and empty codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: between 1 and 256 entries")
    spark = vectors.sparkSession
    kept = integers(vectors, id_column, vector_column, label_column)
    start = [r["q"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()]  # 256 rows at most
    id_kind, label_kind = dict(kept.dtypes)["vec_id"], dict(kept.dtypes)["label"]
    shape = KEPT.format(id=id_kind, label=label_kind)
    result = f"vec_id {id_kind}, label {label_kind}, code string, error long"
    if not start:
        return spark.createDataFrame([], result), [[] for _ in range(PARTS)]
    dim = len(start[0])
    width = dim // PARTS
    now = [_compact(np.array([row[p * width : (p + 1) * width] for row in start], object)) for p in range(PARTS)]
    history = [[c] for c in now]
    totals: dict[tuple[int, int], list] = {}
    schema = f"{shape}, {STATE}, {DELTA}"
    state, table = kept, None
    for _ in range(rounds):
        whole = stored(state.mapInArrow(_pass(history, dim, False), schema), "codes")
        changed = (
            whole.where("part is not null")
            .select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
            .groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        )
        for r in changed.collect():  # one row per component of a codebook
            have = totals.setdefault((r["part"], r["entry"]), [0, [0] * width])
            have[1][r["at"]] += int(r["s"])
            if r["at"] == 0:
                have[0] += r["n"]
        now = _means(now, totals)
        for h, c in zip(history, now, strict=True):
            h.append(c)
        if table is not None:
            forget(table)  # its successor is written
        table = whole
        state = whole.where("part is null").select("vec_id", "label", "q", "codes", "bounds", "stamps")
    coded = stored(state.mapInArrow(_pass(history, dim, True), result), "codes")
    if table is not None:
        forget(table)
    return coded, [[[int(v) for v in entry] for entry in c] for c in now]


def codebooks_digest(books: list[list[list[int]]]) -> str:
    """Lower-case hex SHA-256 of all components, joined by commas in order of part, entry and position."""
    return hashlib.sha256(",".join(str(v) for part in books for entry in part for v in entry).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add label_error: errors summed over equal labels, nulls together, stopping at the range of long."""
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    total = coded.groupBy(F.col("label").alias("of")).agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error")
    )
    return coded.join(total, F.col("label").eqNullSafe(F.col("of"))).drop("of")
