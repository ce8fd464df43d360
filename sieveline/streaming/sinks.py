"""Streaming sinks: outbox of actions, and metrics of a running query."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from sieveline.functions.text import explode_actions
from sieveline.operators.routing import dispatch_actions

Action = Callable[[Mapping[str, Any]], Any]

_RESULT = "success boolean, response string, action_error string"


def run_actions(actions: DataFrame, executors: Mapping[str, Action]) -> DataFrame:
    """Run user callables on dispatched action rows, on the executors.

    An exception becomes a failed result row; a type without a callable too.
    A retried task runs its actions again, so callables should be idempotent.
    """
    columns = actions.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            results = []
            for request in frame.to_dict("records"):
                call = executors.get(request["type"])
                try:
                    if call is None:
                        raise LookupError(f"no handler for action type {request['type']!r}")
                    results.append((True, str(call(request)), None))
                except Exception as error:  # noqa: BLE001 - user code
                    results.append((False, None, str(error)))
            yield pd.concat(
                [frame.reset_index(drop=True), pd.DataFrame(results, columns=["success", "response", "action_error"])], axis=1
            )[[*columns, "success", "response", "action_error"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in actions.schema.fields)
    return actions.mapInPandas(run, f"{fields}, {_RESULT}")


def write_outbox(
    replies: DataFrame, handlers: Sequence[tuple[str, str]], path: str, checkpoint: str, executors: Mapping[str, Action] | None = None
):
    """Write the actions of every micro-batch to its own folder of an outbox table.

    A replayed micro-batch overwrites its folder, so each action is stored once.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        actions = dispatch_actions(explode_actions(batch), handlers)
        if executors is not None:
            actions = run_actions(actions, executors)
        actions.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        replies.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def observed(df: DataFrame, name: str) -> DataFrame:
    """Count rows, priorities and sources passing a point of the plan."""
    return df.observe(
        name,
        F.count("*").alias("events"),
        F.count_if(F.col("priority") <= 2).alias("urgent"),
        F.max("timestamp").alias("last_event_at"),
    )


class MetricsListener(StreamingQueryListener):
    """Hands observed metrics and progress of every micro-batch to a callable."""

    def __init__(self, on_metrics: Callable[[str, Mapping[str, Any]], None]):
        self.on_metrics = on_metrics

    def onQueryStarted(self, event):
        self.on_metrics("started", {"id": str(event.id), "name": event.name})

    def onQueryProgress(self, event):
        p = event.progress
        self.on_metrics("progress", {"batch": p.batchId, "rows": p.numInputRows})
        for name, row in (p.observedMetrics or {}).items():
            self.on_metrics(name, row.asDict())

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.on_metrics("terminated", {"id": str(event.id), "error": event.exception})
