"""Text helpers: trimming, fenced action blocks, stored stream bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.json import is_json, is_json_array

# The white space that is trimmed, and the fence of action blocks.
SPACES = (
    " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
ACTION_FENCE = r"```json:actions\s*\r?\n([\s\S]*?)```"
ACTION_TYPE = "array<struct<type:string,config:string,payload:string>>"


def trim_all(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return trim_all(text) == ""


def action_block(content: Column) -> Column:
    """Text of the first fenced action block, NULL without one or if it is empty."""
    return F.nullif(F.regexp_extract(content, ACTION_FENCE, 1), F.lit(""))


def parse_actions(block: Column) -> Column:
    """Array of requested actions; NULL if malformed or not a JSON array."""
    return F.when(is_json_array(block), F.from_json(block, ACTION_TYPE))


def with_actions(replies: DataFrame, content: str = "content", alias: str = "actions") -> DataFrame:
    """Adds the array of requested actions; the block is cut out only once per row."""
    return (
        replies.withColumn("_block", action_block(F.col(content)))
        .withColumn(alias, parse_actions(F.col("_block")))
        .drop("_block")
    )


def explode_actions(replies: DataFrame, content: str = "content") -> DataFrame:
    """One row per requested action: ``action_pos``, ``type``, ``config``, ``action_payload``."""
    fenced = replies.where(F.col(content).contains("```json:actions"))
    return (
        with_actions(fenced, content, "_actions")
        # The outer form keeps the optimizer from testing the parsed array in a
        # filter of its own, which would parse every text twice more.
        .select("*", F.posexplode_outer("_actions").alias("action_pos", "_action"))
        .where(F.col("_action").isNotNull())
        .select(
            *[c for c in replies.columns],
            "action_pos",
            F.col("_action.type").alias("type"),
            F.col("_action.config").alias("config"),
            F.col("_action.payload").alias("action_payload"),
        )
    )


def sse_data(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Data records of a stored server-sent-event body, one row each."""
    keep = [c for c in bodies.columns if c != body]
    lines = bodies.select(*keep, F.posexplode_outer(F.split(F.col(body), "\n")).alias("line_no", "_line"))
    data = trim_all(F.substring(F.col("_line"), 7, 2147483647))
    return (
        lines.where(F.col("_line").startswith("data: "))
        .select(*keep, "line_no", data.alias("data"))
        .where((F.col("data") != "") & (F.col("data") != "[DONE]"))
    )


def ndjson_lines(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Well-formed JSON records of a newline-delimited body, one row each."""
    keep = [c for c in bodies.columns if c != body]
    lines = bodies.select(*keep, F.posexplode_outer(F.split(F.col(body), "\n")).alias("line_no", "_line"))
    return (
        lines.select(*keep, "line_no", trim_all(F.col("_line")).alias("record"))
        .where(F.col("record") != "")
        .where(is_json(F.col("record")))
    )


def describe_action(action_type: Column, payload: Column, limit: int = 500) -> Column:
    """Approval text; the payload part is cut for display only."""
    shown = F.when(
        F.length(payload) > limit, F.concat(F.substring(payload, 1, limit), F.lit("... [truncated]"))
    ).otherwise(payload)
    return F.concat(F.lit("[Approval Required]\nAction: "), action_type, F.lit("\nPayload: "), shown)
