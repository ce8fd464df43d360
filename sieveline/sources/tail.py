"""Following files that grow, as a streaming source.

    spark.dataSource.register(FileTail)
    lines = spark.readStream.format("file-tail").option("path", "/shared/logs").load()

The offset is the position behind the last whole line of every file. A micro-batch
is planned as byte ranges, read by executors; a line belongs to the range that it starts in.
A last line without its break waits. Files that exist when the query starts are
followed from their end (``from=start``: from their start), files that come later from
their start. A file that is shorter than it was has been cut off or replaced, and starts again.
The path must be one that the driver and all executors can open.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, file string, position long"
BLOCK_BYTES = 16 << 20
TRIGGER_BYTES = 4 << 30
_STEP = 1 << 16


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    end: int
    first: int  # where the micro-batch begins in the file: a line starts there


def files_of(path: str) -> list[str]:
    """Files below a folder, that match a pattern, or the file itself."""
    path = path.removeprefix("file://")
    found = glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path)
    return sorted(f for f in found if os.path.isfile(f) and not os.path.basename(f).startswith((".", "_")))


def last_line_end(file: str, low: int = 0, high: int | None = None) -> int:
    """Position behind the last line break between two positions, or ``low`` without one."""
    with open(file, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        at = at if high is None else min(at, high)
        while at > low:
            size = min(_STEP, at - low)
            f.seek(at - size)
            found = f.read(size).rfind(b"\n")
            if found >= 0:
                return at - size + found + 1
            at -= size
    return low


def lines_of(part: ByteRange) -> Iterator[tuple[bytes, int]]:
    """(line, position) of the lines that start in a range; all of them end in a break."""
    with open(part.file, "rb") as f:
        at = part.start
        if at > part.first:
            f.seek(at - 1)
            at += len(f.readline()) - 1  # the rest of a line of the range before
        else:
            f.seek(at)
        while at < part.end:
            line = f.readline()
            if not line.endswith(b"\n"):
                return  # cut off since it was planned
            yield line[:-1], at
            at += len(line)


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.from_start = options.get("from", "end") == "start"
        self.block = int(options.get("blockbytes", BLOCK_BYTES))
        self.most = int(options.get("triggerbytes", TRIGGER_BYTES))
        self.seen: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        # A name that no file has tells a query that has begun from the very first offset.
        files = {} if self.from_start else {f: last_line_end(f) for f in files_of(self.path)}
        return {"": 0, **files}

    def latestOffset(self) -> dict:
        """Ends of whole lines, at most ``triggerbytes`` ahead of what was planned last."""
        now, left = {"": 0}, self.most
        for f in files_of(self.path):
            try:
                end = last_line_end(f)
                if self.seen is not None:
                    before = self.seen.get(f, 0)
                    before = 0 if end < before else before
                    if end - before > left:
                        end = last_line_end(f, before, before + max(left, 0)) if left > 0 else before
                        # A line longer than the rest waits for a trigger of its own.
                        if end == before and left == self.most:
                            end = self._first_line_end(f, before)
                    left -= end - before
            except FileNotFoundError:
                continue  # gone since it was listed
            now[f] = end
        self.seen = now
        return now

    @staticmethod
    def _first_line_end(file: str, at: int) -> int:
        with open(file, "rb") as f:
            f.seek(at)
            return at + len(f.readline())

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = []
        for file, stop in sorted(end.items()):
            first = start.get(file, 0)
            first = 0 if stop < first else first
            for at in range(first, stop, self.block):
                found.append(ByteRange(file, at, min(at + self.block, stop), first))
        self.seen = end
        return found

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple[bytes, int]]) -> pa.RecordBatch:
            texts = pa.array([line.decode("utf-8", "replace") for line, _ in rows], pa.string())
            places = pa.array([at for _, at in rows], pa.int64())
            return pa.RecordBatch.from_arrays([texts, pa.array([partition.file] * len(rows)), places], names=["value", "file", "position"])

        rows: list[tuple[bytes, int]] = []
        for row in lines_of(partition):
            rows.append(row)
            if len(rows) == 10_000:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    def commit(self, end: dict) -> None:
        pass  # Spark's checkpoint is the only store of positions


class FileTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file-tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader({k.lower(): v for k, v in self.options.items()})


def tail_lines(spark: SparkSession, path: str, from_start: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The lines (value, file, position) that are added to the files of a path."""
    spark.dataSource.register(FileTail)
    reader = spark.readStream.format("file-tail").option("path", path).option("blockBytes", block_bytes)
    return reader.option("from", "start" if from_start else "end").load()
