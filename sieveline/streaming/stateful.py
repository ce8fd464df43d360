"""Streaming twins of the stateful filters, on ``transformWithState``.

They run the same scans as the batch operators, with the scan's state kept in
the state store under the group's key.

``mode="arrival"`` decides every row in the micro-batch it arrives in, ordered
by event time within that batch.  ``mode="ordered"`` holds rows until the
watermark has passed them, so that rows arriving out of order across
micro-batches are decided in event-time order, as in batch.

How many rows of a key a micro-batch can hold is bounded by the source's
admission options (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).
"""

from __future__ import annotations

import pickle
import tempfile
import zlib
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sieveline.functions.numbers import hash_sample
from sieveline.functions.paths import key_parts
from sieveline.operators.ordered import TIME as SCAN_TIME
from sieveline.operators.ordered import AcceptScan, BatchScan, key_column
from sieveline.operators.routing import webhook_verdict

_MICROS = 1_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(df: DataFrame) -> DataFrame:
    """State of several variables needs the RocksDB store, which isn't a session's default."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df


# The worker turns rows into named tuples, which lose names with a leading underscore.
KEY, TIME = "group_key", "event_us"
NO_TIME = np.iinfo(np.int64).min  # what a null time becomes as an integer


class _Accept:
    """Times of the last accepted rows."""

    schema = "times array<bigint>"
    outputs = {"is_accepted": T.BooleanType()}

    def __init__(self, seconds: float, limit: int):
        self.seconds = seconds
        self.scan = AcceptScan(round(seconds * _MICROS), limit)

    def start(self) -> tuple:
        return ([],)

    def step(self, state: tuple, us: np.ndarray) -> tuple[dict[str, Any], tuple]:
        out, times = self.scan.step(list(state[0]), {SCAN_TIME: us})
        return {"is_accepted": out["_accepted"]}, ([int(t) for t in times],)

    def expires(self, state: tuple) -> int:
        """Time (micros) from which the state decides like no state."""
        return (state[0][-1] if state[0] else 0) + round(self.seconds * _MICROS) + 1


class _Batch:
    """Start and size of the open batch, and its number."""

    schema = "start bigint, held bigint, batch_no bigint"
    outputs = {"batch_no": T.LongType(), "is_flush": T.BooleanType()}

    def __init__(self, seconds: float, limit: int):
        self.seconds = seconds
        self.scan = BatchScan(round(seconds * _MICROS), limit)

    def start(self) -> tuple:
        return (None, 0, 0)

    def step(self, state, us):
        start, held, no = state
        out, (start, held) = self.scan.step((start, int(held)), {SCAN_TIME: us})
        flush = out["_flush"]
        numbers = no + np.cumsum(flush) - flush
        return {"batch_no": numbers, "is_flush": flush == 1}, (int(start), int(held), int(no + flush.sum()))


class _Rate:
    """Sampling rate in force and the times inside the velocity look-back."""

    schema = "rate double, times array<bigint>"
    outputs = {"velocity": T.DoubleType(), "sample_rate": T.DoubleType()}

    def __init__(self, base: float, low_rate: float, high_rate: float, seconds: float, high: float, low: float):
        self.base, self.min, self.max = base, low_rate, high_rate
        self.window, self.seconds, self.high, self.low = round(seconds * _MICROS), float(seconds), high, low

    def start(self) -> tuple:
        return (float(self.base), [])

    def step(self, state, us):
        rate, before = float(state[0]), np.asarray(state[1], dtype=np.int64)
        known = np.concatenate([before, us])
        n = np.arange(len(before) + 1, len(known) + 1) - np.searchsorted(known, us - self.window, side="left")
        velocity, rates = n / self.seconds, np.empty(len(us))
        for i, v in enumerate(velocity.tolist()):
            if v > self.high:
                rate = max(self.min, 0.8 * rate)
            elif v < self.low:
                rate = min(self.max, 1.2 * rate)
            rates[i] = rate
        kept = known[known >= known[-1] - self.window]
        return {"velocity": velocity, "sample_rate": rates}, (rate, [int(t) for t in kept])


def _chain(head: pd.DataFrame, rest: pd.DataFrame, chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield head
    yield rest
    yield from chunks


def _by_time(us: np.ndarray, ids: np.ndarray | pa.ChunkedArray) -> np.ndarray:
    """Places in order of time and id, nulls last; ids are looked at where times are equal only."""
    us = np.where(us == NO_TIME, np.iinfo(np.int64).max, us)
    order = np.argsort(us, kind="stable")
    same = us[order[1:]] == us[order[:-1]]
    if not same.any():
        return order
    tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
    places = order[tied]
    texts = (ids.take(pa.array(places)) if isinstance(ids, pa.ChunkedArray) else pa.array(ids[places], pa.string(), from_pandas=True)).to_pylist()
    by = sorted(range(len(tied)), key=lambda k: (us[places[k]], texts[k] is None, texts[k] or ""))
    order[tied] = places[by]
    return order


class _Processor(StatefulProcessor):
    def __init__(self, fold, row_schema: T.StructType, ordered: bool):
        self.fold, self.row_schema, self.ordered = fold, row_schema, ordered
        self.names = row_schema.names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.fold.schema)
        if self.ordered:
            self.buffer = handle.getListState("buffer", self.row_schema)

    def _decide(self, us: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
        """Outputs for rows of a key with these times and ids, in the order given."""
        order = _by_time(us, ids)
        state = self.state.get()
        outputs, state = self.fold.step(self.fold.start() if state is None else tuple(state), us[order])
        self.state.update(state)
        if self.ordered and hasattr(self.fold, "expires"):
            self.handle.registerTimer(self.fold.expires(state) // 1000 + 1)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return {name: np.asarray(values)[back] for name, values in outputs.items()}

    def _told(self, rows: pd.DataFrame, outputs: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        """The rows with their outputs; those that aren't accepted end here."""
        accepted = outputs.get("is_accepted")
        if accepted is not None and not accepted.all():
            rows, outputs = rows[accepted], {name: values[accepted] for name, values in outputs.items()}
        if len(rows):
            yield rows.assign(**outputs)

    def _run(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        yield from self._told(rows, self._decide(rows[TIME].to_numpy(dtype=np.int64), rows["event_id"].to_numpy()))

    def _run_chunks(self, chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The same for a key's rows in chunks: of all but one, only times and ids are in memory."""
        head = next(chunks)[self.names]
        rest = next(chunks, None)
        if rest is None:
            yield from self._run(head)
            return
        times, ids, packed = [], [], 0
        with tempfile.TemporaryFile() as file:
            for chunk in _chain(head, rest, chunks):
                times.append(chunk[TIME].to_numpy(dtype=np.int64))
                ids.append(pa.array(chunk["event_id"], pa.string(), from_pandas=True))
                part = zlib.compress(pickle.dumps(chunk[self.names], pickle.HIGHEST_PROTOCOL), 1)
                pickle.dump(part, file, pickle.HIGHEST_PROTOCOL)
                packed += 1
            del head, rest, chunk
            outputs = self._decide(np.concatenate(times), pa.chunked_array(ids))
            file.seek(0)
            at = 0
            for k in range(packed):
                end, part = at + len(times[k]), pickle.load(file)
                own, at = {name: values[at:end] for name, values in outputs.items()}, end
                if "is_accepted" not in own or own["is_accepted"].any():
                    yield from self._told(pickle.loads(zlib.decompress(part)), own)

    def _release(self, rows: pd.DataFrame, timer_values) -> Iterator[pd.DataFrame]:
        watermark = timer_values.getCurrentWatermarkInMs() * 1000
        due = rows[TIME] <= watermark
        held = rows[~due]
        self.buffer.put([tuple(r) for r in held.astype(object).where(held.notna(), None).to_numpy()]) if len(held) else self.buffer.clear()
        if len(held):
            self.handle.registerTimer(int(held[TIME].min()) // 1000 + 1)
        if due.any():
            yield from self._run(rows[due])

    def _held(self) -> list[pd.DataFrame]:
        kept = [tuple(r) for r in self.buffer.get()] if self.buffer.exists() else []
        return [pd.DataFrame(kept, columns=self.names)] if kept else []

    def handleInputRows(self, key, rows, timerValues):
        if not self.ordered:
            yield from self._run_chunks(iter(rows))
            return
        merged = pd.concat([*self._held(), *[r[self.names] for r in rows]], ignore_index=True)
        yield from self._release(merged, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self._held()
        if held:
            yield from self._release(held[0], timerValues)
        elif self.state.exists() and hasattr(self.fold, "expires"):
            # No row at or before the watermark is left to come: a state that has run out is forgotten.
            if self.fold.expires(tuple(self.state.get())) <= timerValues.getCurrentWatermarkInMs() * 1000:
                self.state.clear()

    def close(self) -> None:
        pass


def _run(df: DataFrame, fold, keys: Sequence[str | Column], mode: str, delay: str) -> DataFrame:
    if mode not in ("arrival", "ordered"):
        raise ValueError(f"unknown mode: {mode}")
    carried = df.transform(keep_state_in_rocksdb).withColumns({KEY: key_column(keys), TIME: F.unix_micros("timestamp")})
    if mode == "ordered":
        carried = carried.withWatermark("timestamp", delay)
    # Timestamps travel as micros: state rows stay plain numbers and text.
    slim = carried.drop("timestamp") if mode == "arrival" else carried
    row_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in slim.schema.fields if f.name != "timestamp"])
    out_schema = T.StructType(row_schema.fields + [T.StructField(n, t, True) for n, t in fold.outputs.items()])
    decided = slim.groupBy(KEY).transformWithStateInPandas(
        statefulProcessor=_Processor(fold, row_schema, mode == "ordered"),
        outputStructType=out_schema,
        outputMode="append",
        timeMode="EventTime" if mode == "ordered" else "None",
    )
    added = list(fold.outputs)
    return decided.withColumn("timestamp", F.timestamp_micros(TIME)).select(*df.columns, *added)


def dedup_stream(
    key_fields: Sequence[str] = ("payload",), window_seconds: float = 30, mode: str = "arrival", delay: str = "1 minute"
):
    return lambda df: _run(df, _Accept(window_seconds, 1), key_parts(key_fields), mode, delay).where("is_accepted").drop("is_accepted")


def dedup_stream_approximate(key_columns: Sequence[str], window_seconds: float = 30):
    """Spark's own watermark-based deduplication: cheaper, but a key is freed by
    the progress of the watermark instead of its own accept time."""
    return lambda df: df.withWatermark("timestamp", f"{window_seconds} seconds").dropDuplicatesWithinWatermark(list(key_columns))


def rate_limit_stream(
    max_events: int = 60, window_seconds: float = 60, partition_by: Sequence[str] = (), mode: str = "arrival", delay: str = "1 minute"
):
    return lambda df: _run(df, _Accept(window_seconds, max_events), list(partition_by), mode, delay).where("is_accepted").drop("is_accepted")


def adaptive_sample_stream(
    base_rate: float = 0.5,
    min_rate: float = 0.1,
    max_rate: float = 1.0,
    window_seconds: float = 60,
    high_velocity: float = 100,
    low_velocity: float = 10,
    partition_by: Sequence[str] = (),
    mode: str = "arrival",
    delay: str = "1 minute",
):
    fold = _Rate(base_rate, min_rate, max_rate, window_seconds, high_velocity, low_velocity)

    def run(df: DataFrame) -> DataFrame:
        rated = _run(df, fold, list(partition_by), mode, delay)
        urgent = F.coalesce(F.col("priority") <= 2, F.lit(False))
        return rated.where(urgent | (hash_sample(F.col("event_id")) < F.col("sample_rate")))

    return run


def batch_members_stream(
    window_seconds: float = 60, max_batch_size: int = 50, partition_by: Sequence[str] = (), mode: str = "arrival", delay: str = "1 minute"
):
    """Adds ``batch_no`` and ``is_flush``; ``summarize_batches`` folds them per batch downstream."""
    return lambda df: _run(df, _Batch(window_seconds, max_batch_size), list(partition_by), mode, delay)


def window_summary_stream(window: str = "1 minute", partition_by: Sequence[str] = ("source_id",), delay: str = "1 minute"):
    """Aligned windows with Spark's own windowed aggregation."""

    def run(df: DataFrame) -> DataFrame:
        slot = F.window("timestamp", window)
        return (
            df.withWatermark("timestamp", delay)
            .groupBy(slot.alias("w"), *partition_by)
            .agg(F.count("*").alias("batch_size"), F.min(F.coalesce("priority", F.lit(3))).alias("priority"))
            .select(F.col("w.start").alias("window_start"), *partition_by, "batch_size", "priority")
        )

    return run


def approval_stream(requests: DataFrame, replies: DataFrame, timeout_seconds: int = 60, auto_deny: bool = True, delay: str = "1 minute") -> DataFrame:
    """Requests with their first reply, or without one once the timeout has passed the watermark.

    One row per request: later replies to a request are dropped before the join.
    """
    q = requests.withWatermark("request_ts", delay).alias("q")
    r = replies.withWatermark("reply_ts", delay).dropDuplicatesWithinWatermark(["request_id"]).alias("r")
    in_time = F.expr(
        f"q.request_id = r.request_id AND r.reply_ts >= q.request_ts AND r.reply_ts <= q.request_ts + interval {timeout_seconds} seconds"
    )
    joined = q.join(r, in_time, "left_outer")
    verdict = webhook_verdict(F.col("r.request_id").isNotNull(), F.col("r.status"), F.col("r.body"), auto_deny)
    return joined.select(F.col("q.request_id").alias("request_id"), verdict.alias("is_approved"))
