"""User-defined sources: a registry, and polling on executors as a Python data source.

A ``Poller`` says how far there is something to poll and fetches what lies between two
cursors. The driver plans ranges of cursors and asks for the newest cursor, nothing else;
executors fetch the ranges. A range that fails yields no rows and doesn't stop the
query: it is noted in a status folder and is planned again with the next micro-batch.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RAW_SCHEMA = "value string, received_at string"


class SourceRegistry:
    """Named source classes, with search, that Spark can read by name."""

    def __init__(self) -> None:
        self._sources: dict[str, tuple[type[DataSource], dict]] = {}

    def register(self, source: type[DataSource], description: str = "", tags: Sequence[str] = ()) -> None:
        name = source.name()
        if name in self._sources:
            raise ValueError(f"source already registered: {name}")
        self._sources[name] = (source, {"name": name, "description": description, "tags": list(tags)})

    def get(self, name: str) -> type[DataSource]:
        if name not in self._sources:
            raise KeyError(f"unknown source: {name}")
        return self._sources[name][0]

    def has(self, name: str) -> bool:
        return name in self._sources

    def list(self) -> list[dict]:
        return [info for _, info in self._sources.values()]

    def search(self, text: str) -> list[dict]:
        needle = text.lower()
        return [
            info
            for info in self.list()
            if needle in info["name"].lower()
            or needle in info["description"].lower()
            or any(needle in t.lower() for t in info["tags"])
        ]

    def install(self, spark: SparkSession) -> None:
        for source, _ in self._sources.values():
            spark.dataSource.register(source)


class Poller:
    """What a polling source has to say; it is sent to the executors."""

    def newest(self) -> int:
        """The cursor behind all that can be polled now."""
        raise NotImplementedError

    def fetch(self, start: int, end: int) -> Iterator[str]:
        """The texts between two cursors; an error means that none of them counts."""
        raise NotImplementedError


@dataclass
class CursorRange(InputPartition):
    start: int
    end: int
    attempt: int = 0


def cursor_ranges(start: int, end: int, step: int) -> list[CursorRange]:
    return [CursorRange(at, min(at + step, end)) for at in range(start, end, step)]


class StatusFolder:
    """The latest status of each range that ever failed, and of the poll for the newest cursor: a file each.

    The folder must be one that the driver and all executors can open.
    """

    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file://")

    def _file(self, name: str) -> str:
        return os.path.join(self.path, f"{name}.json")

    def has(self, name: str) -> bool:
        return os.path.exists(self._file(name))

    def tell(self, name: str, **status) -> None:
        os.makedirs(self.path, exist_ok=True)
        draft = os.path.join(self.path, f".{name}-{os.getpid()}-{time.time_ns()}")
        with open(draft, "w") as f:
            json.dump({"name": name, "at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **status}, f)
        os.replace(draft, self._file(name))

    def failed(self) -> list[list[int]]:
        """(start, end, next attempt) of the ranges that failed last time."""
        out = []
        for name in sorted(os.listdir(self.path)) if os.path.isdir(self.path) else ():
            if name.startswith("range-"):
                with open(os.path.join(self.path, name)) as f:
                    status = json.load(f)
                if status["status"] == "degraded":
                    out.append([status["start"], status["end"], status["attempt"] + 1])
        return out


def _texts(texts: list[str]) -> Iterator[pa.RecordBatch]:
    stamp = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    for at in range(0, len(texts), 10_000):
        part = texts[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([stamp] * len(part))], names=["value", "received_at"])


class PollReader(DataSourceReader):
    """All that can be polled from ``start``, once; here a failing range fails its task, and Spark tries again."""

    def __init__(self, poller: Poller, start: int, step: int) -> None:
        self.poller, self.start, self.step = poller, start, step

    def partitions(self) -> list[InputPartition]:
        return cursor_ranges(self.start, self.poller.newest(), self.step)

    def read(self, partition: CursorRange) -> Iterator[pa.RecordBatch]:
        yield from _texts(list(self.poller.fetch(partition.start, partition.end)))


class PollStreamReader(DataSourceStreamReader):
    """Polls from a cursor; the offset is the cursor and the failed ranges that are due again."""

    def __init__(self, poller: Poller, start: int, step: int, status: str) -> None:
        self.poller, self.start, self.step, self.status = poller, start, step, StatusFolder(status)
        self.cursor: int | None = None

    def initialOffset(self) -> dict:
        return {"cursor": self.start, "again": "[]"}

    def latestOffset(self) -> dict:
        try:
            self.cursor = max(self.poller.newest(), self.cursor or self.start)
            if self.status.has("newest"):
                self.status.tell("newest", status="connected", cursor=self.cursor)
        except Exception as error:  # noqa: BLE001 - a failed poll is retried with the next trigger
            self.status.tell("newest", status="degraded", error=str(error))
            if self.cursor is None:
                raise  # after a restart the cursor isn't known here: the query stops and goes on from its checkpoint
        return {"cursor": self.cursor, "again": json.dumps(self.status.failed())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.cursor = end["cursor"]
        before = json.loads(start["again"])
        again = [CursorRange(*r) for r in json.loads(end["again"]) if r not in before]
        return again + cursor_ranges(start["cursor"], end["cursor"], self.step)

    def read(self, partition: CursorRange) -> Iterator[pa.RecordBatch]:
        name = f"range-{partition.start}-{partition.end}"
        about = {"start": partition.start, "end": partition.end, "attempt": partition.attempt}
        try:
            texts = list(self.poller.fetch(partition.start, partition.end))
        except Exception as error:  # noqa: BLE001 - noted, and due again with the next micro-batch
            self.status.tell(name, status="degraded", error=str(error), **about)
            return
        if self.status.has(name):
            self.status.tell(name, status="connected", **about)
        yield from _texts(texts)

    def commit(self, end: dict) -> None:
        pass  # Spark's checkpoint is the store of cursors


class PollingSource(DataSource):
    """Base of polling sources: give a name and a ``poller``.

    Options: ``start`` (first cursor, 0), ``step`` (cursors fetched by one task, 1) and, for
    streams, ``status`` (a shared folder).
    """

    def poller(self) -> Poller:
        raise NotImplementedError

    def schema(self) -> str:
        return RAW_SCHEMA

    def _plan(self) -> tuple[Poller, int, int]:
        return self.poller(), int(self.options.get("start", 0)), int(self.options.get("step", 1))

    def reader(self, schema) -> DataSourceReader:
        return PollReader(*self._plan())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PollStreamReader(*self._plan(), self.options["status"])


def poll_status(spark: SparkSession, status: str) -> DataFrame:
    """The status table of a polling stream: what failed, with attempts, errors and what became of it."""
    schema = "name string, status string, error string, start long, end long, attempt long, cursor long, at string"
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").json(status)


class PageFolder(Poller):
    """Pages of texts in a shared folder: ``page=N`` holds text files, and ``newest`` the number of pages."""

    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file://")

    def newest(self) -> int:
        numbers = [int(n.removeprefix("page=")) for n in os.listdir(self.path) if n.startswith("page=")]
        return max(numbers, default=-1) + 1

    def fetch(self, start: int, end: int) -> Iterator[str]:
        for page in range(start, end):
            folder = os.path.join(self.path, f"page={page}")
            for name in sorted(os.listdir(folder)):
                if not name.startswith((".", "_")):
                    with open(os.path.join(folder, name), encoding="utf-8") as f:
                        yield from (line.rstrip("\n") for line in f)


class EventFeed(PollingSource):
    """Example of a user source: event texts, page by page."""

    @classmethod
    def name(cls) -> str:
        return "event-feed"

    def poller(self) -> Poller:
        return PageFolder(self.options["path"])
