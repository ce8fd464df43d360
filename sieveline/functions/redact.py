"""Masking of sensitive string fields in JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field names whose string values are masked.
SENSITIVE_KEYS = (
    "api_key", "apiKey", "secret", "password", "token",
    "webhook_url", "url", "connection_string",
)

_CHAR = r'(?:[^"\\]|\\u[0-9a-fA-F]{4}|\\[^u])'
_FIELD = rf'("(?:{"|".join(SENSITIVE_KEYS)})"\s*:\s*")'


def redact_fields(document: Column) -> Column:
    """Keep four characters of longer values, none of shorter ones, at any depth.

    Works on the JSON text itself: a field name is followed by a colon, so
    neither array elements nor quoted text inside values can match.
    """
    longer = F.regexp_replace(document, rf'{_FIELD}({_CHAR}{{4}}){_CHAR}+"', '$1$2***"')
    return F.regexp_replace(longer, rf'{_FIELD}{_CHAR}{{0,4}}"', '$1***"')
