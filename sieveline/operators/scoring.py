"""Agent calls as a vectorised user function over (event, agent) rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORE_SCHEMA = "content string, tokens bigint, latency_ms double, error string"
REPLY = ["content", "tokens", "latency_ms", "error"]
Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def record_scorer(one: Callable[[dict], dict]) -> Scorer:
    """A scorer made of a function from a request to a reply, as plain records.

    Such a scorer is called without a frame around every request, and as one that raises
    fails alone, no request is asked twice.
    """

    def scorer(requests: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([one(r) for r in requests.to_dict("records")], columns=REPLY)

    scorer.one = one
    return scorer


@record_scorer
def offline_scorer(request: dict) -> dict:
    """Deterministic stand-in for an agent: answers from the prompt alone."""
    prompt = request["prompt"] or ""
    return {"content": f"Noted {request['event_id']}.", "tokens": len(prompt) // 4, "latency_ms": 0.0, "error": None}


def score(requests: DataFrame, scorer: Scorer = offline_scorer) -> DataFrame:
    """Appends the reply columns.

    The scorer gets Arrow batches (event_id, agent_id, prompt, ...) and returns
    content, tokens, latency_ms and error.  If it raises for a batch, its rows
    are asked one by one: those that fail come back with the error.  A
    ``record_scorer`` is asked one by one from the start.
    """
    columns = requests.columns
    ask = _asking(scorer)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.reset_index(drop=True)
            reply = ask(frame)
            yield pd.concat([frame, reply[REPLY]], axis=1)[[*columns, *REPLY]]

    return _spread_calls(requests).mapInPandas(run, f"{_fields(requests)}, {SCORE_SCHEMA}")


def _call_tasks(requests: DataFrame) -> int:
    """A fixed number of tasks: calls take long, however few bytes their requests have."""
    return 2 * requests.sparkSession.sparkContext.defaultParallelism


def _spread_calls(requests: DataFrame) -> DataFrame:
    return requests if requests.isStreaming else requests.repartition(_call_tasks(requests))


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _asking(scorer: Scorer) -> Scorer:
    one = getattr(scorer, "one", None)

    def ask_records(frame: pd.DataFrame) -> pd.DataFrame:
        replies = []
        for request in frame.to_dict("records"):
            try:
                replies.append(dict(one(request)))
            except Exception as error:  # noqa: BLE001 - user code
                replies.append(dict(zip(REPLY, failed(error), strict=True)))
        return pd.DataFrame(replies, columns=REPLY)

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            return scorer(frame).reset_index(drop=True)
        except Exception as error:  # noqa: BLE001 - user code
            if len(frame) > 1:
                return pd.DataFrame([ask_row(frame.iloc[i : i + 1]) for i in range(len(frame))], columns=REPLY)
            return pd.DataFrame([failed(error)], columns=REPLY)

    def ask_row(row: pd.DataFrame) -> tuple:
        # A copy with an index of its own, as the scorer may write to it; no frame is made of its reply.
        row = row.copy()
        row.index = pd.RangeIndex(1)
        try:
            reply = scorer(row)
        except Exception as error:  # noqa: BLE001 - user code
            return failed(error)
        return tuple(reply[c].iat[0] for c in REPLY)

    def failed(error: Exception) -> tuple:
        return None, 0, 0.0, str(error)

    return ask if one is None else ask_records


def _asking_one(scorer: Scorer, columns: list[str]) -> Callable[[pd.DataFrame], Callable[[int], dict]]:
    """For a frame, a function that asks for one of its rows; an error is a reply."""
    one = getattr(scorer, "one", None)

    def of(frame: pd.DataFrame) -> Callable[[int], dict]:
        values = {c: frame[c].tolist() for c in columns} if one is not None else {}

        def ask(i: int) -> dict:
            try:
                if one is not None:
                    reply = one({c: v[i] for c, v in values.items()})
                else:
                    reply = scorer(frame[columns].iloc[i : i + 1].reset_index(drop=True)).iloc[0]
                return {c: reply[c] for c in REPLY}
            except Exception as error:  # noqa: BLE001 - user code
                return {"content": None, "tokens": 0, "latency_ms": 0.0, "error": str(error)}

        return ask

    return of


def budget_hour(timestamp: Column) -> Column:
    """Start of the aligned hour, in seconds since 1970."""
    return F.floor(F.unix_seconds(timestamp) / 3600).cast("long") * 3600


def score_in_budget(
    requests: DataFrame, scorer: Scorer = offline_scorer, max_per_hour: str = "max_per_hour", used: DataFrame | None = None
) -> DataFrame:
    """Like ``score``, but no call is made for an agent whose budget of the hour is used up.

    Adds ``tokens_before`` (tokens of the hour's earlier replies, failed ones
    excluded) and ``is_sent``; rows that aren't sent have no reply.  Agents with a
    budget are asked event by event, in order of time and id, as what a call
    costs is known only after it; an hour of an agent ends its calls at the
    budget, and what is left of it is told apart without looking at each row.
    Agents without one are asked in batches.  ``used`` (agent_id, _hour
    in seconds, _used) is what agents used of their hours before.
    """
    free = score(requests.where(F.col(max_per_hour).isNull()), scorer)
    columns = requests.columns
    asking = _asking_one(scorer, columns)
    order = ["agent_id", "_hour", "timestamp", "event_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, spent = None, 0
        for frame in frames:
            frame = frame.reset_index(drop=True)
            ask, caps = asking(frame), frame[max_per_hour].to_numpy()
            out = frame[columns].assign(content=None, tokens=pd.Series(pd.NA, frame.index, "Int64"), latency_ms=float("nan"), error=None)
            before, sent = np.zeros(len(frame), np.int64), np.zeros(len(frame), bool)
            replies: list[dict] = []
            same = (frame["agent_id"] == frame["agent_id"].shift()) & (frame["_hour"] == frame["_hour"].shift())
            starts = np.flatnonzero(~same.to_numpy()).tolist()
            for lo, hi in zip(starts, [*starts[1:], len(frame)], strict=True):
                if (frame.at[lo, "agent_id"], frame.at[lo, "_hour"]) != key:
                    key, spent = (frame.at[lo, "agent_id"], frame.at[lo, "_hour"]), int(frame.at[lo, "_used"])
                i = lo
                while i < hi:
                    # Over the rows that the budget stops at once, to the next that it doesn't.
                    allowed = np.flatnonzero(caps[i:hi] > spent) if caps[i] <= spent else [0]
                    stop = i + int(allowed[0]) if len(allowed) else hi
                    before[i:stop], i = spent, stop
                    if i < hi:
                        reply = ask(i)
                        replies.append(reply)
                        before[i], sent[i] = spent, True
                        spent += int(reply["tokens"] or 0) if pd.isna(reply["error"]) else 0
                        i += 1
            if replies:
                at = np.flatnonzero(sent)
                told = pd.DataFrame(replies, columns=REPLY, index=at)
                told["tokens"] = told["tokens"].astype("Int64")
                for c in REPLY:
                    out[c] = told[c].reindex(out.index)
            yield out.assign(tokens_before=before, is_sent=sent)

    timed = requests.where(F.col(max_per_hour).isNotNull()).withColumn("_hour", budget_hour(F.col("timestamp")))
    timed = timed.withColumn("_used", F.lit(0)) if used is None else timed.join(used, ["agent_id", "_hour"], "left").fillna(0, ["_used"])
    ordered = timed.repartition(_call_tasks(requests), "agent_id", "_hour").sortWithinPartitions(*order)
    capped = ordered.mapInPandas(run, f"{_fields(requests)}, {SCORE_SCHEMA}, tokens_before bigint, is_sent boolean")
    return capped.unionByName(free.withColumns({"tokens_before": F.lit(None).cast("bigint"), "is_sent": F.lit(True)}))


def spent_in_hours(replies: DataFrame, used: DataFrame | None = None, keep_hours: int = 24) -> DataFrame:
    """(agent_id, _hour, _used) after replies, from what was used before; hours long behind the newest one are forgotten."""
    mine = replies.where("is_sent and error is null and max_per_hour is not null").select(
        "agent_id", budget_hour(F.col("timestamp")).alias("_hour"), F.col("tokens").alias("_used")
    )
    every = mine if used is None else mine.unionByName(used)
    summed = every.groupBy("agent_id", "_hour").agg(F.sum("_used").alias("_used"))
    newest = summed.agg((F.max("_hour") - keep_hours * 3600).alias("_from"))
    return summed.join(F.broadcast(newest), F.col("_hour") >= F.col("_from")).drop("_from")
