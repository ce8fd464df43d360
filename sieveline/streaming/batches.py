"""Live batches of events: a batch leaves when it is full or when its window ends.

A key's batch opens with an event. It takes what comes within its window, up to its
size; then it leaves, by the event that fills it, by one behind the window, or by a
timer, so no later event is needed. State: the open batch's start, size and number, and
a list of its members that is only appended to and read once, when the batch leaves.

``mode="ordered"`` decides in event time once the watermark has passed; its results
don't depend on how events fall into micro-batches. Events that wait for the watermark are a
second list, which is appended to on arrival and looked at when a timer fires. ``mode="arrival"``
decides events as they come; its timer is the wall clock.

Where a micro-batch holds many events of a key, they become sorted runs of packed blocks:
entries of a map in the state, or of a temporary file in ``arrival`` mode. Runs are merged
with one block of each in memory, so neither a task nor a value of the state holds a key's events.
"""

from __future__ import annotations

import tempfile
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sieveline.operators.ordered import key_column
from sieveline.operators.stateful import batch_events
from sieveline.schema import DEFAULT_PRIORITY
from sieveline.streaming.stateful import _by_time, keep_state_in_rocksdb

_MICROS = 1_000_000
MEMBER = "event_us bigint, event_id string, source_id string, event_type string, priority int, payload string"
NAMES = [c.split()[0] for c in MEMBER.split(", ")]
OUTPUT = f"batch_key string, batch_no bigint, events array<struct<{MEMBER.replace(' ', ':').replace(',:', ',')}>>"
ARROW = pa.schema([(n, {"event_us": pa.int64(), "priority": pa.int32()}.get(n, pa.string())) for n in NAMES])

# Events that are sorted at once, and those of a block; runs and blocks of large events end at the bytes.
RUN_ROWS, RUN_BYTES = 100_000, 64 << 20
BLOCK_ROWS, BLOCK_BYTES = 1_000, 1 << 20


def batch_ends(us: np.ndarray, start: int | None, held: int, window: int, limit: int) -> Iterator[tuple[int, int, int, bool]]:
    """Runs (first, last + 1, start, whether the batch leaves with them) of sorted times that go into one batch each.

    A run that is empty closes the open batch alone.
    """
    at, n = 0, len(us)
    while at < n:
        if not held:
            start = int(us[at])
        behind = int(np.searchsorted(us, start + window, side="left"))
        stop = max(min(at + limit - held, behind), at)
        yield at, stop, start, stop - at + held >= limit or behind < n
        if stop - at + held >= limit or behind < n:
            held = 0
        else:
            held += stop - at
        at = stop


def _table(rows: pd.DataFrame) -> pa.Table:
    return pa.Table.from_pandas(rows[NAMES], schema=ARROW, preserve_index=False)


def _sorted(parts: list[pa.Table]) -> pa.Table:
    rows = pa.concat_tables(parts).combine_chunks()
    return rows.take(pa.array(_by_time(rows["event_us"].to_numpy(), rows["event_id"])))


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ARROW, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


class _File:
    """Blocks of one micro-batch, in a temporary file of the task."""

    def __init__(self):
        self.file, self.places = tempfile.TemporaryFile(), {}

    def put(self, place: tuple, block: bytes) -> None:
        self.places[place] = (self.file.seek(0, 2), len(block))
        self.file.write(block)

    def take(self, place: tuple) -> bytes:
        at, size = self.places[place]
        self.file.seek(at)
        return self.file.read(size)

    def drop(self, place: tuple) -> None:
        del self.places[place]


class _State:
    """Blocks that wait for the watermark, in the state."""

    def __init__(self, blocks):
        self.blocks = blocks

    def put(self, place: tuple, block: bytes) -> None:
        self.blocks.updateValue(place, (block,))

    def take(self, place: tuple) -> bytes:
        return self.blocks.getValue(place)[0]

    def drop(self, place: tuple) -> None:
        self.blocks.removeKey(place)


class _Run:
    """Sorted events: blocks in a store, one of them in memory, or those in memory alone.

    The first ``offset`` events of the block are gone; ``next_us`` is at most the time of the next one.
    """

    def __init__(self, number: int | None, block: int, offset: int, blocks: int, next_us: int, rows: pa.Table | None = None):
        self.number, self.block, self.offset, self.blocks, self.next_us = number, block, offset, blocks, next_us
        self.rows = rows
        if rows is not None:
            self._index()

    def _index(self) -> None:
        self.us = self.rows["event_us"].to_numpy()
        self.next_us = int(self.us[0])

    def _key(self, k: int) -> tuple:
        event_id = self.rows["event_id"][k].as_py()
        return int(self.us[k]), event_id is None, event_id or ""

    def fill(self, store) -> None:
        if self.rows is None:
            self.rows = pa.ipc.open_stream(store.take((self.number, self.block))).read_all().slice(self.offset)
            self._index()

    def end(self) -> tuple | None:
        """Place of the last event in memory, if there are more blocks."""
        return self._key(len(self.us) - 1) if self.block + 1 < self.blocks else None

    def upto(self, end: tuple, store) -> pa.Table:
        lo, hi = (int(np.searchsorted(self.us, end[0], side=side)) for side in ("left", "right"))
        n = lo + bisect_right(range(lo, hi), end, key=self._key)
        found = self.rows.slice(0, n)
        if n < len(self.us):
            self.rows, self.offset = self.rows.slice(n), self.offset + n
            self._index()
        else:
            self.rows = None
            if self.number is not None:
                store.drop((self.number, self.block))
            self.block, self.offset = self.block + 1, 0
        return found


def _runs(chunks: Iterator[pa.Table], first: int, store) -> list[_Run]:
    """Sorted runs of a key's events, numbered from ``first``; a few events stay in memory."""

    def write(parts: list[pa.Table]) -> _Run:
        rows = _sorted(parts)
        step = max(1, min(BLOCK_ROWS, len(rows) * BLOCK_BYTES // max(rows.nbytes, 1)))
        number, blocks = first + len(runs), range(0, len(rows), step)
        for block, at in enumerate(blocks):
            store.put((number, block), _packed(rows.slice(at, step)))
        return _Run(number, 0, 0, len(blocks), rows["event_us"][0].as_py())

    runs, parts, n, size = [], [], 0, 0
    for chunk in chunks:
        parts.append(chunk)
        n, size = n + len(chunk), size + chunk.nbytes
        if n >= RUN_ROWS or size >= RUN_BYTES:
            runs.append(write(parts))
            parts, n, size = [], 0, 0
    if parts and not runs and n <= BLOCK_ROWS and size <= BLOCK_BYTES:
        return [_Run(None, 0, 0, 1, 0, _sorted(parts))]
    return [*runs, write(parts)] if parts else runs


def _merged(runs: list[_Run], until: int, store) -> Iterator[pa.Table]:
    """Events of the runs in order of time and id, up to a time, in pieces. The runs go on behind them."""
    live = [r for r in runs if r.next_us <= until]
    while live:
        for r in live:
            r.fill(store)
        live = [r for r in live if r.next_us <= until]
        # What is still in the store comes after the last event in memory of its run.
        end = min([(until, True, ""), *[e for r in live if (e := r.end())]])
        parts = [p for r in live if len(p := r.upto(end, store))]
        if parts:
            yield _sorted(parts)
        live = [r for r in live if r.block < r.blocks and r.next_us <= until]


class _Batches(StatefulProcessor):
    def __init__(self, window: int, limit: int, ordered: bool):
        self.window, self.limit, self.ordered = window, max(limit, 1), ordered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start bigint, held bigint, batch_no bigint, timer bigint")
        self.members = handle.getListState("members", MEMBER)
        if self.ordered:
            self.waiting = handle.getListState("waiting", MEMBER)
            self.runs = handle.getListState("runs", "run bigint, block bigint, start bigint, blocks bigint, next_us bigint")
            self.store = _State(handle.getMapState("blocks", "run bigint, block bigint", "rows binary"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chunks = (_table(r) for r in rows)
        if self.ordered:
            # Nothing is decided before the watermark is told to have passed.
            earliest = self._wait(chunks)
            self.handle.registerTimer(max(earliest // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        else:
            store = _File()
            found = _runs(chunks, 0, store)
            yield from self._take(key, _merged(found, np.iinfo(np.int64).max, store), timerValues.getCurrentProcessingTimeInMs())

    def _wait(self, chunks: Iterator[pa.Table]) -> int:
        """Put events aside; the time of the first."""
        held = [_Run(*r) for r in self.runs.get()] if self.runs.exists() else []
        fresh = _runs(chunks, max((r.number for r in held), default=-1) + 1, self.store)
        if fresh[0].rows is not None:
            self.waiting.appendList(_tuples(fresh[0].rows))
        else:
            self.runs.appendList([_place(r) for r in fresh])
        return min(r.next_us for r in fresh)

    def _due(self, now: int) -> Iterator[pa.Table]:
        """Waiting events up to the watermark, in order; the rest goes on waiting."""
        few = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        many = [_Run(*r) for r in self.runs.get()] if self.runs.exists() else []
        listed = [_Run(None, 0, 0, 1, 0, _sorted([_listed(few)]))] if few else []
        yield from _merged([*listed, *many], now * 1000, self.store)
        rest = [r for r in listed if r.rows is not None]
        if sum(len(r.rows) for r in rest) < len(few):
            self.waiting.put(_tuples(rest[0].rows)) if rest else self.waiting.clear()
        left = [r for r in many if r.block < r.blocks]
        if many:
            self.runs.put([_place(r) for r in left]) if left else self.runs.clear()
        if rest or left:
            self.handle.registerTimer(min(r.next_us for r in [*rest, *left]) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.ordered:
            state = self.open.get() if self.open.exists() else None
            if state and state[1] and state[3] <= timerValues.getCurrentProcessingTimeInMs():
                yield self._leave(key, state[2])
                self.open.update((0, 0, state[2] + 1, 0))
            return
        now = timerValues.getCurrentWatermarkInMs()
        yield from self._take(key, self._due(now), now)
        state = self.open.get() if self.open.exists() else None
        if state and state[1] and state[0] + self.window <= now * 1000:
            yield self._leave(key, state[2])
            self.open.update((0, 0, state[2] + 1, 0))

    def _take(self, key, pieces: Iterator[pa.Table], now: int) -> Iterator[pd.DataFrame]:
        """Batches that leave with the events, which come in order; the open one's members go to the state at the end."""
        before = start, held, number, timer = self.open.get() if self.open.exists() else (0, 0, 0, 0)
        opened, known, fresh = False, held > 0, []
        for rows in pieces:
            events, found = rows.to_pylist(), []
            for lo, hi, start, leaves in batch_ends(rows["event_us"].to_numpy(), start, held, self.window, self.limit):
                opened = opened or not held
                fresh += events[lo:hi]
                held += hi - lo
                if leaves:
                    found.append((number, [*self._members(), *fresh] if known else fresh))
                    number, held, opened, known, fresh = number + 1, 0, False, False, []
            if found:
                yield _batches(key, found)
        if fresh:
            self.members.appendList([tuple(e.values()) for e in fresh])
        if held and opened:
            # The end of the window: in event time, or by the clock from now on.
            timer = (start + self.window) // 1000 + 1 if self.ordered else now + self.window // 1000
            self.handle.registerTimer(timer)
        if (after := (int(start), held, number, int(timer))) != tuple(before):
            self.open.update(after)

    def _members(self) -> list[dict]:
        """Members of the open batch, which leaves with them."""
        members = [dict(zip(NAMES, m, strict=True)) for m in self.members.get()] if self.members.exists() else []
        self.members.clear()
        return members

    def _leave(self, key, number: int) -> pd.DataFrame:
        return _batches(key, [(number, self._members())])

    def close(self) -> None:
        pass


def _batches(key, found: list[tuple[int, list[dict]]]) -> pd.DataFrame:
    return pd.DataFrame({"batch_key": [key[0]] * len(found), "batch_no": [n for n, _ in found], "events": [e for _, e in found]})


def _place(run: _Run) -> tuple:
    return run.number, run.block, run.offset, run.blocks, run.next_us


def _tuples(rows: pa.Table) -> list[tuple]:
    return list(zip(*[rows[n].to_pylist() for n in NAMES], strict=True))


def _listed(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


def batch_events_stream(
    partition_by: Sequence[str | Column],
    window_seconds: float = 60,
    max_batch_size: int = 50,
    prompt: str = "Analyze the following batch of events",
    mode: str = "arrival",
    delay: str = "1 minute",
    source_id: str = "aggregation",
):
    """Each batch as one canonical event. Events without a time count as of now.

    ``partition_by`` must name a key: a key's batches are the work of one task.
    """
    if not partition_by:
        raise ValueError("live batches need a key")
    if mode not in ("arrival", "ordered"):
        raise ValueError(f"unknown mode: {mode}")

    def run(df: DataFrame) -> DataFrame:
        at = F.coalesce(F.col("timestamp"), F.current_timestamp())
        slim = df.transform(keep_state_in_rocksdb).withColumn("timestamp", at).select("timestamp", key_column(partition_by).alias("batch_key"), F.unix_micros("timestamp").alias("event_us"), *NAMES[1:])
        if mode == "ordered":
            slim = slim.withWatermark("timestamp", delay)
        found = slim.groupBy("batch_key").transformWithStateInPandas(
            statefulProcessor=_Batches(round(window_seconds * _MICROS), max_batch_size, mode == "ordered"),
            outputStructType=OUTPUT, outputMode="append", timeMode="EventTime" if mode == "ordered" else "ProcessingTime",
        )
        event = lambda e: F.struct(
            F.timestamp_micros(e["event_us"]).alias("timestamp"), *[e[n].alias(n) for n in NAMES[1:]]
        )
        sources = F.array_distinct(F.transform("events", lambda e: e["source_id"]))
        batches = found.withColumn("events", F.transform("events", event)).select(
            "batch_key", "batch_no", F.lit(source_id).alias("source_id"), F.lit("DATA").alias("event_type"),
            F.array_min(F.transform("events", lambda e: F.coalesce(e["priority"], F.lit(DEFAULT_PRIORITY)))).alias("priority"),
            F.size("events").cast("long").alias("batch_size"), F.lit(prompt).alias("window_prompt"), "events",
            F.to_json(F.struct(F.lit(True).alias("aggregated"), F.size("events").alias("event_count"), sources.alias("source_ids"))).alias("metadata"),
        )
        return batch_events(batches, ["batch_key", "batch_no"])

    return run
