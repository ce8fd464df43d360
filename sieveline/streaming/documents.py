"""Change detection over a stream of document snapshots.

The state of a document is the set of its pending suggestions and the number of its
last poll. The first poll seeds; a suggestion that the last poll didn't have is new; one
that has gone is forgotten, and is new again if it comes back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sieveline.streaming.stateful import keep_state_in_rocksdb


class _Suggestions(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "poll bigint")
        self.pending = handle.getMapState("pending", "suggestion_id string", "poll bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        polls = pd.concat(list(rows), ignore_index=True).sort_values("poll", kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        known = {k[0] for k in self.pending.keys()} if self.pending.exists() else set()
        start, found = set(known), []
        for poll, group in polls.groupby("poll", sort=True):
            if last is not None and poll <= last:
                continue  # a snapshot that a later one has overtaken
            present = {s for ids in group["suggestion_ids"] if ids is not None for s in ids if s is not None}
            if last is not None:
                found += [(key[0], int(poll), s) for s in sorted(present - known)]
            known, last = present, int(poll)
        for s in start - known:
            self.pending.removeKey((s,))
        for s in known - start:
            self.pending.updateValue((s,), (last,))
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(found, columns=["doc_id", "poll", "suggestion_id"])

    def close(self) -> None:
        pass


def new_suggestions_stream(snapshots: DataFrame) -> DataFrame:
    """(doc_id, poll, suggestion_id) that a document's previous poll did not have.

    snapshots(doc_id, poll, suggestion_ids) holds a row for each poll of a document, with
    no ids if nothing is pending. Polls of a document are compared in their order;
    one that arrives behind a later poll of another micro-batch is left out.
    """
    slim = snapshots.transform(keep_state_in_rocksdb).select("doc_id", F.col("poll").cast("long").alias("poll"), F.col("suggestion_ids").cast("array<string>").alias("suggestion_ids"))
    return slim.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=_Suggestions(), outputStructType="doc_id string, poll bigint, suggestion_id string", outputMode="append", timeMode="None"
    )
