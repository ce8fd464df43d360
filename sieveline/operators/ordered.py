"""Ordered scans that stay balanced when one key holds most of the rows.

A stateful filter must see the rows of a key in time order.  Where the largest
key has been counted and is small, a hash shuffle on the key and a sort within
the task do; the scan then streams over the sorted rows.  A key beyond
``MAX_KEY_ROWS`` must not end up in a single task, so then the rows are
range-partitioned on (key, order columns) instead: every task gets an equally
large, contiguous run of the sorted data, and a hot key simply spans many
tasks.  What crosses a partition border is one small state per partition:

1. the layout is range-partitioned, sorted and checkpointed once;
2. a probe pass emits one summary row per partition: how the partition
   transforms the state it is entered with;
3. the summaries are chained in partition order, which gives every partition
   its entry state (one small value per partition, not per row);
4. the apply pass streams each partition through the scan with that state.

Scans differ only in their state.  Sums and clamps compose in closed form, so
step 3 is one pass.  The greedy scans (accept, batch) have *reset points* where
the state no longer depends on anything earlier, or a table of exits by entry.
A partition with neither is run again with its entry state, all such partitions
at once from guessed entries first, then border by border until all borders are
known.  Nothing is approximated in any case.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.session import checkpoint_root

KEY, TIME, PART = "_key", "_us", "_part"

# A key with more rows than this is spread over several tasks.
MAX_KEY_ROWS = 1_000_000

_SUMMARY = "part int, first_key string, last_key string, payload binary"


def key_column(partition_by: Sequence[str | Column]) -> Column:
    """One sortable text per key; JSON text keeps ('a|b','c') and ('a','b|c') apart."""
    if not partition_by:
        return F.lit("")
    cols = [F.col(c) if isinstance(c, str) else c for c in partition_by]
    return F.to_json(F.array(*[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols]))


def largest_key(df: DataFrame, keys: Sequence[str | Column]) -> int:
    """Rows of the largest key; counts are combined before the shuffle."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return per_key.agg(F.max("_n")).first()[0] or 0


@dataclass(frozen=True)
class Ordered:
    """Rows sorted by key and order within their partitions.

    ``spans`` tells that a key may continue in the next partition.
    """

    df: DataFrame
    spans: bool

    def with_columns(self, columns: dict[str, Column]) -> Ordered:
        return replace(self, df=self.df.withColumns(columns))


def ordered_layout(
    df: DataFrame,
    partition_by: Sequence[str | Column],
    order_by: Sequence[str | Column],
    time_col: str | None = "timestamp",
) -> Ordered:
    """Sort by (key, order), over as many tasks as the largest key needs.

    In the spanning layout the checkpoint pins the sampled range borders, so
    that the probe and the apply pass see the same partitions even after an
    executor is lost.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    df = df.withColumn(KEY, key_column(partition_by))
    if time_col is not None:
        df = df.withColumn(TIME, F.coalesce(F.unix_micros(F.col(time_col)), F.lit(0)))
        order = [F.col(TIME), *order]
    if largest_key(df, [KEY]) <= MAX_KEY_ROWS:
        rows = df.repartition(KEY).sortWithinPartitions(F.col(KEY), *order).withColumn(PART, F.lit(0))
        return Ordered(rows, spans=False)
    checkpoint_root(df.sparkSession)
    rows = (
        df.repartitionByRange(F.col(KEY), *order)
        .sortWithinPartitions(F.col(KEY), *order)
        .withColumn(PART, F.spark_partition_id())
        .checkpoint(eager=True)
    )
    return Ordered(rows, spans=True)


class Scan:
    """State machine over the ordered rows of one key."""

    columns: Sequence[str] = ()
    outputs: Sequence[tuple[str, pa.DataType]] = ()

    def start(self, key: str) -> Any:
        raise NotImplementedError

    def step(self, state: Any, cols: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], Any]:
        """Run over a run of rows of one key; return outputs and the exit state."""
        raise NotImplementedError

    # -- behaviour with an unknown entry state -------------------------------
    def unknown(self) -> Any:
        """Accumulator for a run of rows whose entry state is not known yet."""
        raise NotImplementedError

    def absorb(self, acc: Any, cols: dict[str, np.ndarray]) -> Any:
        raise NotImplementedError

    def pack(self, acc: Any) -> Any:
        """What of the accumulator the summary row has to carry."""
        return acc

    def resolve(self, acc: Any, entry: Any) -> Any:
        """Exit state for ``entry`` (None: not known yet), or None if the exit
        depends on it in a way only another run over the rows can tell."""
        raise NotImplementedError


class SumScan(Scan):
    """Running sum of integers before and including each row."""

    def __init__(self, value: str, before: str = "_before", through: str = "_through"):
        self.columns = (value,)
        self.outputs = ((before, pa.int64()), (through, pa.int64()))

    def start(self, key):
        return 0

    def step(self, state, cols):
        v = cols[self.columns[0]].astype(np.int64)
        through = np.cumsum(v) + state
        return {self.outputs[0][0]: through - v, self.outputs[1][0]: through}, int(through[-1])

    def unknown(self):
        return 0

    def absorb(self, acc, cols):
        return acc + int(cols[self.columns[0]].astype(np.int64).sum())

    def resolve(self, acc, entry):
        return None if entry is None else entry + acc


class ClampScan(Scan):
    """r := min(hi, max(lo, a*r)) per row, for factors a >= 0.

    A run of rows is summarised by what it makes of the least and the greatest
    possible rate, step by step as in a plain pass.  Each step keeps the order of
    rates, rounding included, so once both meet, every entry has that exit.  A run
    without any factor but 1 is a clamp between the two.  Any other is run again
    with its true entry: results never depend on how rows are laid out.
    """

    BOUND = 1e308

    outputs = (("_rate", pa.float64()),)

    def __init__(self, first: float, factor: str, lo: str, hi: str):
        self.first = float(first)
        self.columns = (factor, lo, hi)

    def start(self, key):
        return self.first

    def step(self, state, cols):
        a, lo, hi = (cols[c].astype(np.float64) for c in self.columns)
        out = np.empty(len(a))
        r = float(state)
        for i, (x, y, z) in enumerate(zip(a.tolist(), lo.tolist(), hi.tolist())):
            r = min(z, max(y, x * r))
            out[i] = r
        return {"_rate": out}, r

    def unknown(self):
        return (-self.BOUND, self.BOUND, False)

    def absorb(self, acc, cols):
        lo, hi, moved = acc
        arrays = [cols[c].astype(np.float64).tolist() for c in self.columns]
        for x, y, z in zip(*arrays):
            moved = moved or x != 1.0
            lo, hi = min(z, max(y, x * lo)), min(z, max(y, x * hi))
        return (lo, hi, moved)

    def resolve(self, acc, entry):
        lo, hi, moved = acc
        if lo == hi:
            return lo
        return None if entry is None or moved else min(hi, max(lo, entry))


class AcceptScan(Scan):
    """Greedy sliding limit: accept iff fewer than ``limit`` rows were accepted
    in the look-back (t - window, t].  ``limit=1`` is windowed deduplication.

    The state is the last ``limit`` accepted times.  Reset point: a row whose
    whole look-back consists of rows that are accepted whatever came before,
    which is the case when no row of that look-back has more than ``limit``
    rows in its own one.

    With ``limit=1`` the exit is moreover a step function of the time from which
    the first row may be accepted: one step per row of the first window, and
    steps merge as their accept chains meet.

    With a higher limit, number the accepted rows: the n-th is the later of the row
    behind the one before and the first row a window after the (n - limit)-th. Both
    keep the order of rows, and the later of two rows stays the later one. So the n-th
    accepted row of any entry is the latest, over its first ``limit`` accepted rows j,
    of what a run that starts with an empty state at row j accepts as its (n - j)-th.
    The summary holds those runs' ends for each row that can be among the first.
    """

    MAX_CHAINS, MAX_STEPS = 1_000_000, 4096
    MAX_ROWS, MAX_WORK, MAX_TABLE = 4_000_000, 500_000_000, 200_000

    columns = (TIME,)
    outputs = (("_accepted", pa.bool_()),)

    def __init__(self, window_us: int, limit: int):
        self.window, self.limit = int(window_us), int(limit)

    def start(self, key):
        return []

    def step(self, state, cols):
        us = cols[TIME]
        n = len(us)
        out = np.zeros(n, dtype=bool)
        if self.limit <= 0:
            return {"_accepted": out}, []
        recent = list(state)[-self.limit :]
        times = us.tolist()
        i = 0
        while i < n:
            if len(recent) >= self.limit:
                free_at = recent[-self.limit] + self.window
                if times[i] < free_at:
                    i = int(np.searchsorted(us, free_at, side="left"))
                    continue
            out[i] = True
            recent.append(times[i])
            if len(recent) > 4 * self.limit + 64:
                del recent[: -self.limit]
            i += 1
        return {"_accepted": out}, recent[-self.limit :]

    def unknown(self):
        # ``tail``: every row later than ``seen_from``, as far as a look-back of
        # a look-back can still reach.
        none = np.empty(0, np.int64)
        return {
            "tail": none, "seen_from": None, "last": None, "known": None,
            "first": None, "from": none, "at": none, "closed": False, "rows": [],
        }

    def _follow(self, acc, us: np.ndarray) -> None:
        """Carry the accept chain of every possible entry through these rows."""
        if acc["from"] is None:
            return
        if acc["first"] is None:
            acc["first"] = int(us[0])
        if not acc["closed"]:
            # An entry can block at most a window beyond the first row.
            end = int(np.searchsorted(us, acc["first"] + self.window, side="right"))
            acc["closed"] = end < len(us)
            starts = np.unique(us[: end + 1])
            if len(acc["from"]):
                starts = starts[starts > acc["from"][-1]]
            acc["from"] = np.concatenate([acc["from"], starts])
            acc["at"] = np.concatenate([acc["at"], starts])
        at = acc["at"]
        while True:
            nxt = np.searchsorted(us, at + self.window, side="left")
            moved = nxt < len(us)
            if not moved.any():
                break
            at[moved] = us[nxt[moved]]
        if acc["closed"]:
            ends = np.append(at[1:] != at[:-1], True)
            acc["from"], acc["at"] = acc["from"][ends], at[ends]
        if len(acc["from"]) > self.MAX_CHAINS:
            acc["from"] = acc["at"] = None  # too dense: run again instead

    def pack(self, acc):
        few = acc["from"] is not None and len(acc["from"]) <= self.MAX_STEPS and self.limit == 1
        steps = {"from": acc["from"], "at": acc["at"]} if few else {"from": None, "at": None}
        table = self._table(np.concatenate(acc["rows"])) if self.limit > 1 and acc["known"] is None and acc["rows"] else None
        return {"last": acc["last"], "known": acc["known"], "closed": acc["closed"], "table": table, **steps}

    def _table(self, us: np.ndarray) -> dict[str, np.ndarray] | None:
        """Runs from an empty state at each row that an entry may accept first: numbers of accepted rows and the last times.

        None where the table would be too large; the rows are run again instead.
        """
        n, limit = len(us), self.limit
        k = min(int(np.searchsorted(us, us[0] + self.window, side="left")) + limit, n)
        most = min(n, limit * (int(us[-1] - us[0]) // max(self.window, 1) + 2))
        if k * most > self.MAX_WORK or 2 * limit * k > 50 * self.MAX_TABLE:
            return None
        free = np.append(np.searchsorted(us, us + self.window, side="left"), n)
        ring = np.full((2 * limit, k), -1)
        at, number, count = np.arange(k), 0, np.zeros(k, np.int64)
        while (inside := at < n).any():
            ring[number % (2 * limit), inside] = at[inside]
            count += inside
            number += 1
            at = np.minimum(at + 1, n)
            if number >= limit:
                # A run that has left the rows stays outside.
                before = np.where(inside, ring[(number - limit) % (2 * limit)], n)
                at = np.maximum(at, free[before])
        order = (count[None, :] + np.arange(2 * limit)[:, None]) % (2 * limit)  # the oldest of the last accepted rows first
        rows = np.take_along_axis(ring, order, axis=0)
        ends, group = np.unique(np.where(rows < 0, np.iinfo(np.int64).min, us[rows]), axis=1, return_inverse=True)
        if ends.size > self.MAX_TABLE:
            return None
        return {"n": n, "times": us[:k].copy(), "count": count, "group": group.reshape(-1), "ends": ends}

    def _through(self, table: dict[str, np.ndarray], entry: list[int]) -> list[int]:
        """Exit state behind the rows of a table."""
        limit, times = self.limit, table["times"]
        held = [None] * (limit - len(entry)) + list(entry[-limit:])
        first: list[int] = []
        for e in held:
            free = 0 if e is None else int(np.searchsorted(times, e + self.window, side="left"))
            at = max(first[-1] + 1 if first else 0, free)
            if at >= table["n"]:
                break
            first.append(at)
        if not first:
            return entry
        x, j = np.array(first), np.arange(1, len(first) + 1)
        count, ends = table["count"][x], table["ends"][:, table["group"][x]]
        last = int((j + count - 1).min())
        if len(first) < limit:
            last = min(last, len(first))
        out = [e for e in held[max(last, 0) :] if e is not None]
        for number in range(max(last - limit + 1, 1), last + 1):
            place = number - j - (count - 2 * limit)
            fits = (place >= 0) & (number >= j)
            out.append(int(ends[place[fits], np.flatnonzero(fits)].max()))
        return out

    def absorb(self, acc, cols):
        us = cols[TIME]
        acc["last"] = int(us[-1])
        if self.limit == 1 and acc["known"] is None:
            self._follow(acc, us)
        if self.limit <= 0:
            acc["known"] = []
        if acc["known"] is not None:
            acc["known"] = self.step(acc["known"], cols)[1]
            return acc
        if self.limit > 1 and acc["rows"] is not None:
            acc["rows"].append(us)
            if sum(map(len, acc["rows"])) > self.MAX_ROWS:
                acc["rows"] = None
        if acc["seen_from"] is None:
            acc["seen_from"] = int(us[0])
        joined = np.concatenate([acc["tail"], us])
        found = self._find_reset(joined, acc["seen_from"])
        if found is not None:
            state, pos = found
            acc["known"] = self.step(state, {TIME: joined[pos:]})[1] if pos < len(joined) else state
            acc["tail"] = np.empty(0, np.int64)
            return acc
        horizon = acc["last"] - 2 * self.window
        keep = joined[np.searchsorted(joined, horizon, side="left") :]
        acc["seen_from"] = max(acc["seen_from"], horizon)
        if len(keep) > 4_000_000:
            # A burst: stop looking back across it.  At worst no reset point is
            # found here and the partition is run again with its true entry.
            keep, acc["seen_from"] = keep[-1:], acc["last"]
        acc["tail"] = keep
        return acc

    def _find_reset(self, us: np.ndarray, seen_from: int):
        # A gap of a full window leaves no live state at all.
        gaps = np.flatnonzero(np.diff(us) >= self.window)
        if len(gaps):
            return [], int(gaps[0]) + 1
        if self.limit == 1:
            return None
        n = len(us)
        lo = np.searchsorted(us, us - self.window, side="right")
        doubtful = (np.arange(n) - lo + 1) > self.limit
        doubtful |= us < seen_from + self.window
        total = np.concatenate([[0], np.cumsum(doubtful)])
        hits = np.flatnonzero(total[np.arange(n) + 1] == total[lo])
        if not len(hits):
            return None
        i = int(hits[0])
        return us[lo[i] : i + 1].tolist(), i + 1

    def resolve(self, acc, entry):
        if acc["known"] is not None:
            return acc["known"]
        if entry and len(entry) >= self.limit and acc["last"] < entry[-self.limit] + self.window:
            return entry  # the whole run is rejected
        if acc["table"] is not None:
            return None if entry is None else self._through(acc["table"], entry)
        steps = acc["from"]
        if steps is None or not len(steps):
            return None
        if entry is None:
            # Once all chains have met, the exit is the same for every entry.
            return [int(acc["at"][0])] if acc["closed"] and len(steps) == 1 else None
        j = int(np.searchsorted(steps, entry[-1] + self.window, side="left")) if entry else 0
        return [int(acc["at"][j])] if j < len(steps) else entry


class BatchScan(Scan):
    """Count-or-time batching: append, then flush if ``t - start >= window`` or
    the batch holds ``limit`` rows; the flushing row belongs to its batch and
    its time starts the next one.  Marks flushing rows.

    An unknown entry only decides which of the first ``limit`` rows flushes first;
    from there on the run is the same for every entry. So a run of rows is
    summarised by an exit table: the exit state for each possible first flush.
    Chains of flushes from different rows merge, which keeps the table short.
    """

    columns = (TIME,)
    outputs = (("_flush", pa.int64()),)

    def __init__(self, window_us: int, limit: int, origin_us: int | None = None):
        self.window, self.limit, self.origin = int(window_us), int(limit), origin_us

    def start(self, key):
        return (self.origin, 0)

    def step(self, state, cols):
        us = cols[TIME]
        n = len(us)
        start, held = state
        if start is None:
            start = int(us[0])
        out = np.zeros(n, dtype=np.int64)
        i = 0
        while i < n:
            by_count = i + max(self.limit - held, 1) - 1
            by_time = max(int(np.searchsorted(us, start + self.window, side="left")), i)
            j = min(by_count, by_time)
            if j >= n:
                return {"_flush": out}, (start, held + n - i)
            out[j] = 1
            start, held, i = int(us[j]), 0, j + 1
        return {"_flush": out}, (start, held)

    def _exits(self, us: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state behind the rows for each place of a first flush; chains that meet go on as one."""
        n, rows = len(us), np.arange(len(us))
        by_time = np.searchsorted(us, us + self.window, side="left")
        following = np.minimum(rows + max(self.limit, 1), np.maximum(by_time, rows + 1))
        live, back = np.unique(at, return_inverse=True)
        while (moves := following[live] < n).any():
            live, merged = np.unique(np.where(moves, following[live], live), return_inverse=True)
            back = merged[back]
        return us[live[back]], n - 1 - live[back]

    def unknown(self):
        # An entry of the table stands for first flushes from ``place`` up to the next entry's
        # place; ``before`` is the time of the row before its place.
        none = np.empty(0, np.int64)
        return {"n": 0, "first": None, "last": 0, "place": none, "before": none, "start": none, "held": none}

    def absorb(self, acc, cols):
        us = cols[TIME].astype(np.int64)
        n, most = len(us), max(self.limit, 1)
        start, held = acc["start"].copy(), acc["held"] + n
        at = np.minimum(np.maximum(most - acc["held"], 1) - 1, np.searchsorted(us, acc["start"] + self.window, side="left"))
        inside = at < n
        new = np.arange(min(n, max(most - acc["n"], 0)))  # rows that may be the first to flush
        exits = self._exits(us, np.append(at[inside], new)) if inside.any() or len(new) else (start[:0], held[:0])
        known = int(inside.sum())
        start[inside], held[inside] = exits[0][:known], exits[1][:known]
        start, held = np.append(start, exits[0][known:]), np.append(held, exits[1][known:])
        place = np.append(acc["place"], acc["n"] + new)
        before = np.append(acc["before"], np.append(acc["last"], us)[new])
        keep = np.append(True, (start[1:] != start[:-1]) | (held[1:] != held[:-1]))
        table = {"place": place[keep], "before": before[keep], "start": start[keep], "held": held[keep]}
        first = int(us[0]) if acc["first"] is None else acc["first"]
        return {"n": acc["n"] + n, "first": first, "last": int(us[-1]), **table}

    def resolve(self, acc, entry):
        if entry is None:
            # One exit, whichever row flushes first, once a row must have flushed by count.
            sure = acc["n"] >= max(self.limit, 1) and len(acc["start"]) == 1
            return (int(acc["start"][0]), int(acc["held"][0])) if sure else None
        start, held = entry
        start = acc["first"] if start is None else start  # the key begins here
        by_count, end = max(self.limit - held, 1) - 1, start + self.window
        if by_count >= acc["n"] and acc["last"] < end:
            return (start, held + acc["n"])  # nothing flushes
        in_time = 1 + int(np.searchsorted(acc["before"][1:], end, side="left"))  # entries that time lets be reached
        k = min(int(np.searchsorted(acc["place"], by_count, side="right")), in_time) - 1
        return (int(acc["start"][k]), int(acc["held"][k]))


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int]]:
    keys = batch.column(KEY)
    codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield keys[lo].as_py(), lo, hi


def _arrays(batch: pa.RecordBatch, names: Sequence[str]) -> dict[str, np.ndarray]:
    return {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}


def _probe(scan: Scan, entries: dict[int, tuple[str, Any]] | None = None):
    """Per partition: first and last key, and the last key's exit (or transform)."""

    def run(batches):
        part = first_key = last_key = None
        acc, state, known = None, None, False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cols = _arrays(batch, scan.columns)
            if part is None:
                part = batch.column(PART)[0].as_py()
            for key, lo, hi in _segments(batch):
                piece = {n: a[lo:hi] for n, a in cols.items()}
                if first_key is None:
                    first_key = last_key = key
                    if entries is not None:
                        known, state = True, entries[part][1]
                    else:
                        acc = scan.unknown()
                elif key != last_key:
                    last_key, known, acc = key, True, None
                    state = scan.start(key)
                if known:
                    state = scan.step(state, piece)[1]
                else:
                    acc = scan.absorb(acc, piece)
        if part is not None:
            payload = pickle.dumps((known, state if known else scan.pack(acc)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([first_key]),
                    pa.array([last_key]),
                    pa.array([payload], pa.binary()),
                ],
                names=["part", "first_key", "last_key", "payload"],
            )

    return run


#: Passes from guessed entries go on while the last one settled this share of the partitions it ran.
PRODUCTIVE = 0.1


def entry_states(layout: DataFrame, scan: Scan) -> dict[int, tuple[str, Any]]:
    """Entry state of every partition that continues its predecessor's key.

    The driver holds one summary per partition, never rows. Partitions whose exit
    depends on their entry in a way that the summary can't tell are run again, all at
    once: those whose entry isn't known start from the last exit of their predecessor
    for a guess. A partition is settled once it ran from its true entry, so guesses that
    prove right settle it, too; states that are forgotten within a partition make nearly
    all of them right at the second pass. Where passes settle little, as under a steady
    overload that never forgets, the rest is run border by border.
    """
    needed = layout.select(PART, KEY, *scan.columns)
    rows = needed.mapInArrow(_probe(scan), _SUMMARY).collect()
    summaries = {r["part"]: (r["first_key"], r["last_key"], *pickle.loads(r["payload"])) for r in rows}
    order = sorted(summaries)
    tried: dict[int, list[tuple[Any, Any]]] = {}  # exits of runs by their entries, one per pass
    passes, before = 0, 0
    while True:
        entries: dict[int, tuple[str, Any]] = {}
        due: dict[int, tuple[str, Any]] = {}
        guesses: dict[int, tuple[str, Any]] = {}
        last_key, state, guess = None, None, None  # state None: not known yet
        for p in order:
            first_key, this_last, known, value = summaries[p]
            continues = first_key == last_key
            entry = state if continues else scan.start(first_key)
            assumed = entry if entry is not None else guess
            if continues:
                entries[p] = (first_key, entry)
            if known:
                state = value
            else:
                state = scan.resolve(value, entry)
                ran = next((out for start, out in reversed(tried.get(p, ())) if _same(start, assumed)), None)
                if state is None and entry is not None:
                    state = ran
                    if state is None:
                        due[p] = (first_key, entry)
                guess = ran
                if state is None and ran is None and entry is None:
                    guesses[p] = (first_key, assumed if assumed is not None else scan.start(first_key))
                    guess = tried[p][-1][1] if p in tried else None
            if state is not None:
                guess = state
            last_key = this_last
        if not due:
            return entries
        open_ = len(guesses) + len(due)
        wide = passes < 2 or before - open_ >= PRODUCTIVE * before
        again = {**guesses, **due} if wide else due
        passes, before = passes + 1, open_
        for r in _run_again(needed, scan, again):
            tried.setdefault(r["part"], []).append((again[r["part"]][1], pickle.loads(r["payload"])[1]))


def _same(a: Any, b: Any) -> bool:
    return b is not None and bool(a == b)


def _run_again(needed: DataFrame, scan: Scan, entries: dict[int, tuple[str, Any]]) -> list:
    """Summaries of some partitions alone, run from the given entries."""
    again = needed.mapInArrow(_probe(scan, entries), _SUMMARY).rdd
    return needed.sparkSession.sparkContext.runJob(again, list, sorted(entries))


_SPARK_TYPE = {pa.int64(): T.LongType(), pa.float64(): T.DoubleType(), pa.bool_(): T.BooleanType()}


def apply_scan(ordered: Ordered, scan: Scan) -> Ordered:
    """Append the scan's outputs to the rows, keeping partitions and order."""
    layout = ordered.df
    entries = entry_states(layout, scan) if ordered.spans else {}
    # Only borders inside a key carry state; the rest start fresh anyway.
    shared = layout.sparkSession.sparkContext.broadcast(entries)
    schema = T.StructType(
        [f for f in layout.schema.fields] + [T.StructField(n, _SPARK_TYPE[t]) for n, t in scan.outputs]
    )

    def run(batches):
        current = state = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cols = _arrays(batch, scan.columns)
            pieces: dict[str, list[np.ndarray]] = {n: [] for n, _ in scan.outputs}
            for key, lo, hi in _segments(batch):
                if key != current:
                    part = batch.column(PART)[lo].as_py()
                    border = shared.value.get(part) if current is None else None
                    state = border[1] if border is not None and border[0] == key else scan.start(key)
                    current = key
                out, state = scan.step(state, {n: a[lo:hi] for n, a in cols.items()})
                for n in pieces:
                    pieces[n].append(out[n])
            arrays = list(batch.columns)
            names = list(batch.schema.names)
            for n, t in scan.outputs:
                arrays.append(pa.array(np.concatenate(pieces[n]), type=t))
                names.append(n)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return replace(ordered, df=layout.mapInArrow(run, schema))


def running_sum(
    df: DataFrame,
    value: str,
    partition_by: Sequence[str | Column],
    order_by: Sequence[str | Column],
    before: str = "_before",
    through: str = "_through",
) -> DataFrame:
    """Exact running sum of integers per key in the given order.

    Small keys use a window function; with a hot key the sum runs as an
    ordered scan over many tasks.
    """
    if largest_key(df, partition_by) <= MAX_KEY_ROWS:
        w = Window.partitionBy(*partition_by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(through, F.sum(F.col(value).cast("long")).over(w)).withColumn(
            before, F.col(through) - F.col(value)
        )
    layout = ordered_layout(df, partition_by, order_by, time_col=None)
    return apply_scan(layout, SumScan(value, before, through)).df.drop(KEY, PART)
