"""Stored reply streams: assembly of text chunks and token counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.replies import delta_text, delta_tokens
from sieveline.functions.text import with_actions
from sieveline.operators.ordered import largest_key, running_sum

PIECES = 1024


def _joined(group: DataFrame, keys: Sequence[str | Column], order: Sequence[str], text: str, sep: str, alias: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(*order, text)))
    return group.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x[text]), sep).alias(alias))


def ordered_concat(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], text: str, sep: str = "", alias: str = "text"
) -> DataFrame:
    """Texts of a key joined in order.

    Where a key has many texts, a running count cuts them into runs of bounded
    length; runs are joined in parallel, and only the joined pieces meet in
    the final row.
    """
    df = df.where(F.col(text).isNotNull())
    if largest_key(df, keys) <= PIECES:
        return _joined(df, keys, order_by, text, sep, alias)
    counted = running_sum(df.withColumn("_one", F.lit(1).cast("long")), "_one", list(keys), list(order_by))
    run = counted.withColumn("_run", F.floor(F.col("_before") / F.lit(PIECES)))
    return _joined(_joined(run, [*keys, "_run"], ["_before"], text, sep, "_piece"), keys, ["_run"], "_piece", sep, alias)


def assemble_stream(chunks: DataFrame, key: str = "response_id", seq: str = "seq") -> DataFrame:
    """Whole replies from chunks(key, seq, type, text, tokens_used).

    Text chunks are joined in order, the last usage chunk gives the tokens,
    actions are read from the whole text.
    """
    kind = F.col("type")
    texts = ordered_concat(
        chunks.where((kind == "text") & (F.col("text") != "")), [key], [seq], "text", alias="content"
    )
    usage = chunks.groupBy(key).agg(
        F.max_by(
            "tokens_used",
            F.when((kind == "usage") & F.col("tokens_used").isNotNull(), F.col(seq)),
        ).alias("tokens_used")
    )
    return (
        usage.join(texts, key, "left")
        .withColumn("content", F.coalesce("content", F.lit("")))
        .withColumn("tokens_used", F.coalesce("tokens_used", F.lit(0)))
        .transform(with_actions)
    )


def stream_tokens(records: DataFrame, key: str = "response_id", seq: str = "seq") -> DataFrame:
    """Tokens of streamed replies: summed deltas, or the last total, by provider."""
    counted = records.withColumn("_t", delta_tokens(F.col("provider"), F.col("record")))
    reported = F.col("_t").isNotNull()
    nonzero = reported & (F.col("_t") != 0)
    return counted.groupBy(key, "provider").agg(
        F.coalesce(
            F.when(F.col("provider") == "anthropic", F.sum("_t")).otherwise(F.max_by("_t", F.when(nonzero, F.col(seq)))),
            F.lit(0),
        ).alias("tokens_used")
    )


def stream_chunks(records: DataFrame) -> DataFrame:
    """Text chunks of stored stream records."""
    text = delta_text(F.col("provider"), F.col("record"))
    return records.withColumn("text", text).where(F.coalesce(F.col("text") != "", F.lit(False)))


def last_assistant(messages: DataFrame, key: str = "conv_id", order: str | Column = "turn") -> DataFrame:
    """Last assistant message per thread; a thread without one yields its last message as JSON."""
    is_reply = F.col("role").isin("assistant", "ai")
    turn = F.col(order) if isinstance(order, str) else order
    return messages.groupBy(key).agg(
        F.coalesce(
            F.max_by("text", F.when(is_reply, turn)),
            F.to_json(F.max_by(F.struct("role", "text"), turn)),
        ).alias("content")
    )
