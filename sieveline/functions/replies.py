"""Fields of stored agent replies, by provider shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(body: Column, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(body, p).cast("bigint") for p in paths])


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("bigint"))


def usage_tokens(provider: Column, body: Column) -> Column:
    """Tokens of one full reply."""
    return (
        F.when(
            provider == "anthropic",
            _or_zero(_int(body, "$.usage.input_tokens")) + _or_zero(_int(body, "$.usage.output_tokens")),
        )
        .when(provider == "openai", _or_zero(_int(body, "$.usage.total_tokens")))
        .when(
            provider == "ollama",
            _or_zero(_int(body, "$.prompt_eval_count")) + _or_zero(_int(body, "$.eval_count")),
        )
        .when(provider == "langgraph", _or_zero(_int(body, "$.usage.total_tokens", "$.metadata.tokens_used")))
        .when(provider == "crewai", _or_zero(_int(body, "$.tokens_used", "$.usage.total_tokens")))
        .when(provider == "openclaw", _or_zero(_int(body, "$.tokens_used", "$.usage.total_tokens")))
        .otherwise(F.lit(0).cast("bigint"))
    )


def reply_text(provider: Column, body: Column) -> Column:
    """Text of one full reply, '' where the provider sent none."""
    plain = (
        F.when(provider == "anthropic", F.get_json_object(body, "$.content[0].text"))
        .when(provider == "openai", F.get_json_object(body, "$.choices[0].message.content"))
        .when(provider == "ollama", F.get_json_object(body, "$.message.content"))
    )
    wrapped = F.when(
        provider == "crewai",
        F.coalesce(F.get_json_object(body, "$.result"), F.get_json_object(body, "$.output"), body),
    ).when(
        provider == "openclaw",
        F.coalesce(F.get_json_object(body, "$.content"), F.get_json_object(body, "$.text"), body),
    )
    return F.coalesce(plain, wrapped, F.lit(""))


def delta_text(provider: Column, record: Column) -> Column:
    """Text carried by one record of a streamed reply, NULL if it carries none."""
    return (
        F.when(
            (provider == "anthropic") & (F.get_json_object(record, "$.type") == "content_block_delta"),
            F.get_json_object(record, "$.delta.text"),
        )
        .when(provider == "openai", F.get_json_object(record, "$.choices[0].delta.content"))
        .when(provider == "ollama", F.get_json_object(record, "$.message.content"))
    )


def delta_tokens(provider: Column, record: Column) -> Column:
    """Tokens reported by one record of a streamed reply, NULL if it reports none."""
    kind = F.get_json_object(record, "$.type")
    return (
        F.when((provider == "anthropic") & (kind == "message_start"), _int(record, "$.message.usage.input_tokens"))
        .when((provider == "anthropic") & (kind == "message_delta"), _int(record, "$.usage.output_tokens"))
        .when(provider == "openai", _int(record, "$.usage.total_tokens"))
        .when(
            (provider == "ollama") & (F.get_json_object(record, "$.done") == "true"),
            _or_zero(_int(record, "$.prompt_eval_count")) + _or_zero(_int(record, "$.eval_count")),
        )
    )


def model_provider(model: Column, runtime: Column) -> Column:
    """Provider part of a model reference."""
    bare = F.when(runtime == "direct-llm", "openai").otherwise(runtime)
    return F.when(model.contains("/"), F.split_part(model, F.lit("/"), F.lit(1))).otherwise(bare)


def model_name(model: Column) -> Column:
    """Model part of a model reference; a third path part is dropped."""
    return F.when(model.contains("/"), F.split_part(model, F.lit("/"), F.lit(2))).otherwise(model)
