"""Replies put together from a stream of chunks that may come out of order.

The state of a reply is a list of its chunks, appended to as they come, and how many
numbers it still misses. It is read once: when the chunk that ends the reply and all
numbers before it have come, or when nothing has come for a while.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sieveline.functions.text import with_actions
from sieveline.streaming.stateful import keep_state_in_rocksdb

CHUNK = ["seq", "type", "text", "tokens_used"]
_CHUNKS = "seq bigint, type string, text string, tokens_used bigint"


def whole_reply(chunks: list[tuple]) -> tuple[str, int, bool]:
    """Text, tokens and whether no number is missing; of repeated numbers the first chunk counts."""
    by_seq: dict[int, tuple] = {}
    for seq, kind, text, tokens in chunks:
        by_seq.setdefault((seq, kind), (kind, text, tokens))
    order = sorted(by_seq)
    text = "".join(by_seq[k][1] or "" for k in order if by_seq[k][0] == "text")
    usage = [by_seq[k][2] for k in order if by_seq[k][0] == "usage" and by_seq[k][2] is not None]
    ends = [seq for seq, kind in order if kind == "done"]
    return text, int(usage[-1]) if usage else 0, bool(ends) and {s for s, _ in order} >= set(range(ends[-1] + 1))


class _Replies(StatefulProcessor):
    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", _CHUNKS)
        self.about = handle.getValueState("about", "held bigint, done bigint, due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat([r[CHUNK] for r in rows], ignore_index=True)
        plain = fresh.astype(object).where(fresh.notna(), None).itertuples(index=False, name=None)
        new = [(int(s), kind, text, None if n is None else int(n)) for s, kind, text, n in plain]
        held, done, _ = self.about.get() if self.about.exists() else (0, -1, 0)
        done = max([done, *(s for s, kind, *_ in new if kind == "done")])
        self.chunks.appendList(new)
        held += len(new)
        # Only a reply that may be whole is looked at.
        if 0 <= done < held:
            chunks = [tuple(r) for r in self.chunks.get()]
            text, tokens, whole = whole_reply(chunks)
            if whole:
                yield self._close(key, text, tokens, True)
                return
        due = 0 if self.idle_ms is None else timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.about.update((held, done, due))
        if self.idle_ms is not None:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.about.exists() and self.about.get()[2] <= timerValues.getCurrentProcessingTimeInMs():
            text, tokens, _ = whole_reply([tuple(r) for r in self.chunks.get()])
            yield self._close(key, text, tokens, False)

    def _close(self, key, text: str, tokens: int, whole: bool) -> pd.DataFrame:
        self.chunks.clear()
        self.about.clear()
        return pd.DataFrame({"response_id": [key[0]], "content": [text], "tokens_used": [tokens], "is_whole": [whole]})

    def close(self) -> None:
        pass


def assemble_live(chunks: DataFrame, key: str = "response_id", idle_seconds: float | None = None) -> DataFrame:
    """Whole replies from a stream of chunks (key, seq, type, text, tokens_used), numbered from 0.

    Text chunks are joined in order, the last usage chunk gives the tokens, actions are
    read from the whole text, as in ``assemble_stream``. A reply that ``idle_seconds``
    pass for without a chunk leaves with what has come, ``is_whole`` false; this asks
    for the wall clock, so such a query has no end of its own (no ``availableNow``).
    """
    slim = chunks.transform(keep_state_in_rocksdb).select(
        F.col(key).cast("string").alias("response_id"), F.col("seq").cast("long").alias("seq"), "type", "text", F.col("tokens_used").cast("long").alias("tokens_used")
    ).where("seq is not null")
    found = slim.groupBy("response_id").transformWithStateInPandas(
        statefulProcessor=_Replies(None if idle_seconds is None else round(idle_seconds * 1000)),
        outputStructType="response_id string, content string, tokens_used bigint, is_whole boolean", outputMode="append",
        timeMode="None" if idle_seconds is None else "ProcessingTime",
    )
    return found.transform(with_actions)
