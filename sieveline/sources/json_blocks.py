"""JSON documents of any size, read in parallel by blocks of their files.

Files hold JSON documents one after another, each over as many lines as it likes; of
an array every element is a value of its own. Spark splits the files at commas, so a
task reads the text of a block, and no line is too long. Whether a comma or a bracket is
structure depends on what stands before the block: on an open string, the depth, and
the bracket that opened the document. The first pass sums up how a block changes
these; the sums are chained per file; the second pass cuts the values out. A value
across blocks is put together from its parts.

A line break ends an open string, as JSON doesn't allow one inside; so a broken
document spoils its own lines at most. Brackets that close nothing are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_QUOTE, _BACKSLASH, _LINE, _COMMA = (ord(c) for c in '"\\\n,')
_ARRAY = ord("[")


@dataclass(frozen=True)
class State:
    """What a block is entered with: inside a string, the depth, and the bracket that opened the document."""

    in_string: bool = False
    depth: int = 0
    top: int = 0


def structure(data: np.ndarray, in_string: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Masks of the characters outside strings, of opening and of closing brackets among them, and whether a string stays open."""
    quote = data == _QUOTE
    back = data == _BACKSLASH
    if back.any():
        place = np.where(back, -1, np.arange(len(data)))
        plain = np.append(-1, np.maximum.accumulate(place)[:-1])  # the last character before that is no backslash
        quote &= (np.arange(len(data)) - 1 - plain) % 2 == 0
    through = np.cumsum(quote)
    line = data == _LINE
    base = np.maximum.accumulate(np.where(line, through, -1))
    begun = np.where(base < 0, int(in_string), -base)  # quotes of the current line only
    inside = ((through - quote + begun) % 2).astype(bool) & ~line
    outside = ~inside & ~quote
    opens = outside & ((data == _ARRAY) | (data == ord("{")))
    closes = outside & ((data == ord("]")) | (data == ord("}")))
    stays = bool((through[-1] + begun[-1]) % 2) if len(data) else in_string
    return outside, opens, closes, stays


class Effect:
    """How a block changes the state, for one answer to whether it begins inside a string."""

    def __init__(self, in_string: bool) -> None:
        self.in_string, self.delta, self.low, self.top = in_string, 0, 0, 0

    def add(self, data: np.ndarray) -> None:
        _, opens, closes, self.in_string = structure(data, self.in_string)
        step = opens.astype(np.int64) - closes
        level = self.delta + np.cumsum(step)
        low = min(self.low, int(level.min()))
        # The last bracket that opens a document if the lowest level is depth 0.
        at = np.flatnonzero(opens & (level - step == low))
        if len(at):
            self.top = int(data[at[-1]])
        elif low < self.low:
            self.top = 0
        self.delta, self.low = int(level[-1]), low

    def summary(self) -> tuple[bool, int, int, int]:
        return self.in_string, self.delta, self.low, self.top


def after(state: State, effects: tuple[tuple, tuple]) -> State:
    """The state behind a block with these effects, outside and inside a string."""
    in_string, delta, low, top = effects[state.in_string]
    depth = state.depth + delta - min(0, state.depth + low)
    return State(in_string, depth, (top if state.depth + low <= 0 else state.top) if depth else 0)


class Cutter:
    """Cuts the values out of a block's text, given its entry state."""

    def __init__(self, state: State) -> None:
        self.state, self.held, self.has_cut = state, [], False

    def add(self, data: bytes) -> list[bytes]:
        """The values that end in this text, the first of them begun earlier, perhaps before the block."""
        text = np.frombuffer(data, np.uint8)
        outside, opens, closes, stays = structure(text, self.state.in_string)
        step = opens.astype(np.int64) - closes
        level = self.state.depth + np.cumsum(step)
        depth = level - np.minimum(0, np.minimum.accumulate(level))
        before = np.append(self.state.depth, depth[:-1])
        first = opens & (before == 0)
        place = np.maximum.accumulate(np.where(first, np.arange(len(text)), -1))
        top = np.where(place < 0, self.state.top, text[np.maximum(place, 0)])
        of_array = top == _ARRAY
        last = closes & (before == 1)
        comma = outside & (text == _COMMA)
        gone = (outside & ((text == _LINE) | comma | closes) & (before == 0)) | (comma & (before == 1) & of_array) | ((first | last) & of_array)
        begin, end = np.flatnonzero(first & ~of_array), np.flatnonzero(last & ~of_array) + 1
        drop = np.flatnonzero(gone)
        ends, starts = np.concatenate([drop, begin, end]), np.concatenate([drop + 1, begin, end])
        order = np.lexsort((starts, ends))
        self.state = State(stays, int(depth[-1]), int(top[-1]) if depth[-1] else 0)
        out, at = [], 0
        for stop, go in zip(ends[order].tolist(), starts[order].tolist(), strict=True):
            self.held.append(data[at:stop])
            out.append(b"".join(self.held))
            self.held, at = [], go
        self.held.append(data[at:])
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """(file, block, text) of runs of records (value, file, block); a record's comma is put back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(0).cast(pa.binary()).to_pylist()
        blocks = batch.column(2).to_numpy()
        files = batch.column(1).dictionary_encode()
        cuts = np.flatnonzero(np.diff(blocks) | np.diff(files.indices.to_numpy())) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
            yield files[lo].as_py(), int(blocks[lo]), b",".join(values[lo:hi]) + b","


_EFFECT = "in_string boolean, delta long, low long, top int"
_SUMMARY = f"file string, block long, outside struct<{_EFFECT}>, inside struct<{_EFFECT}>"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row():
        each = [dict(zip(("in_string", "delta", "low", "top"), e.summary(), strict=True)) for e in effects]
        kind = pa.struct([("in_string", pa.bool_()), ("delta", pa.int64()), ("low", pa.int64()), ("top", pa.int32())])
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]]), pa.array([now[1]], pa.int64()), *(pa.array([e], kind) for e in each)], names=["file", "block", "outside", "inside"]
        )

    now, effects = None, []
    for file, block, text in _blocks(batches):
        if now != (file, block):
            if now is not None:
                yield row()
            now, effects = (file, block), [Effect(False), Effect(True)]
        for e in effects:
            e.add(np.frombuffer(text, np.uint8))
    if now is not None:
        yield row()


_PART = "file string, block long, kind int, has_cut boolean, value binary"
WHOLE, HEAD, TAIL = 0, 1, 2


def _cut(entries, blocks_of):
    """Values of each block, whole ones and the parts at its borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, values: list[bytes]) -> pa.RecordBatch:
            n = len(values)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([now[0]] * n, pa.string()), pa.array([now[1]] * n, pa.int64()), pa.array([kind] * n, pa.int32()),
                    pa.array([cutter.has_cut] * n, pa.bool_()), pa.array(values, pa.binary()),
                ],
                names=["file", "block", "kind", "has_cut", "value"],
            )

        def end() -> Iterator[pa.RecordBatch]:
            rest = b"".join(cutter.held)
            if single:
                yield rows(WHOLE, [rest])
            else:
                yield rows(TAIL if cutter.has_cut else HEAD, [rest])

        now, cutter, single = None, None, True
        for file, block, text in _blocks(batches):
            if now != (file, block):
                if now is not None:
                    yield from end()
                now = (file, block)
                cutter = Cutter(entries.value.get(now, State()))
                single = file not in blocks_of.value
            values = cutter.add(text)
            if values and not cutter.has_cut:
                cutter.has_cut = True
                if not single:
                    yield rows(HEAD, values[:1])
                    values = values[1:]
            if values:
                yield rows(WHOLE, values)
        if now is not None:
            yield from end()

    return run


def read_json_values(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the text of every JSON document in the files, of arrays the text of every element.

    Texts are trimmed and not checked: what stands between values comes out as it
    is. Empty values are left out. The driver holds a few numbers per block of files with several blocks.
    """
    pieces = spark.read.option("lineSep", ",").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    sums = pieces.mapInArrow(_summed, _SUMMARY)
    several = Window.partitionBy("file")
    shared = sums.withColumn("n", F.count("*").over(several)).where("n > 1").orderBy("file", "block").toLocalIterator()
    entries: dict[tuple[str, int], State] = {}
    files: set[str] = set()
    state = State()
    for r in shared:
        if r["file"] not in files:
            files.add(r["file"])
            state = State()
        entries[r["file"], r["block"]] = state
        state = after(state, (tuple(r["outside"]), tuple(r["inside"])))
    sc = spark.sparkContext
    cut = _cut(sc.broadcast(entries), sc.broadcast(files))
    parts = pieces.mapInArrow(cut, _PART)
    whole = parts.where(F.col("kind") == WHOLE).select("file", "value")
    if files:
        # Parts of a value share the number of blocks with a cut before them.
        border = parts.where(F.col("kind") != WHOLE)
        cuts = F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("block", "kind"))
        joined = border.withColumn("no", cuts).groupBy("file", "no").agg(
            F.array_sort(F.collect_list(F.struct("block", "kind", "value"))).alias("parts")
        )
        text = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["value"]))
        whole = whole.unionByName(joined.select("file", text.alias("value")))
    trimmed = F.regexp_replace(F.col("value").cast("string"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return whole.select("file", trimmed.alias("value")).where("value <> ''")
