"""Strict JSON tests; Spark's own parsers stop after the first value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_START = r'^[ \t\r\n]*[\[{"\-0-9tfn]'


def is_json(text: Column) -> Column:
    """True if the whole text is one JSON value.

    ``try_parse_json`` accepts anything behind the first value ('42 errors').
    What parses inside an array as well as behind an object key can only be a
    single value: after it, one allows ',' or ']', the other ',' or '}', and
    behind a comma one needs a value where the other needs a key and a colon.
    Texts that cannot start a value are not parsed at all.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    in_object = F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull()
    return F.coalesce(F.when(text.rlike(_START), in_array & in_object), F.lit(False))


def is_json_array(text: Column) -> Column:
    return F.when(text.rlike(r"^[ \t\r\n]*\["), is_json(text)).otherwise(F.lit(False))


def is_json_nested(text: Column) -> Column:
    """Object or array."""
    return F.when(text.rlike(r"^[ \t\r\n]*[\[{]"), is_json(text)).otherwise(F.lit(False))
