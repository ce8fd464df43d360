"""Dotted-path access to events (columns first, JSON text below them)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that never resolve, and the event columns holding JSON text.
GUARDED_KEYS = ("__proto__", "constructor", "prototype")
JSON_COLUMNS = ("payload", "metadata")
_PLAIN = re.compile(r"[A-Za-z0-9_ -]+")


def _json_paths(segments: Sequence[str]) -> list[str]:
    # A numeric segment may index an array or name an object key.
    as_index = "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in segments)
    as_key = "$" + "".join(f"['{s}']" for s in segments)
    return [as_index] if as_index == as_key else [as_index, as_key]


def _variant_at(column: str, segments: Sequence[str]) -> Column:
    doc = F.try_parse_json(F.col(column))
    found = [F.try_variant_get(doc, p, "variant") for p in _json_paths(segments)]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def _fast_text(column: str, segments: Sequence[str]) -> Column | None:
    """Plain lookup, NULL for missing and null; None if the path needs care."""
    if not all(_PLAIN.fullmatch(s) and not s.isdigit() for s in segments):
        return None
    return F.get_json_object(F.col(column), "$" + "".join(f"['{s}']" for s in segments))


_UNSETTLED_NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def _number_text(x: Column) -> Column:
    """Shortest text of a number: no trailing zeros, an exponent below 1e-6 and from 1e21 on."""
    size, text = F.abs(x), x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(text.cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", "")
    scientific = F.regexp_replace(F.regexp_replace(text, r"\.0E|E", "e"), r"e(?!-)", "e+")
    return F.when((x == F.floor(x)) & (size < 1e21), x.cast("decimal(38,0)").cast("string")).when((size >= 1e-6) & (size < 1e16), plain).otherwise(scientific)


def _node_text(node: Column) -> Column:
    """Text of a VARIANT: numbers with a fraction or an exponent in their shortest form."""
    text = F.try_variant_get(node, "$", "string")
    kind = F.schema_of_variant(node)
    real = kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
    return F.when(F.is_variant_null(node), "null").when(real, _number_text(F.try_variant_get(node, "$", "double"))).otherwise(text)


def path_present(path: str) -> Column:
    """True where the path resolves; an explicit JSON null counts as present."""
    head, *rest = path.split(".")
    if any(s in GUARDED_KEYS for s in (head, *rest)):
        return F.lit(False)
    if rest:
        if head not in JSON_COLUMNS:
            return F.lit(False)
        slow, fast = _variant_at(head, rest).isNotNull(), _fast_text(head, rest)
        return slow if fast is None else F.coalesce(fast.isNotNull() | F.lit(None).cast("boolean"), slow)
    return F.col(head).isNotNull()


def path_text(path: str) -> Column:
    """Text form of the value at the path; missing is NULL, JSON null is 'null'.

    Objects and arrays yield canonical (key-sorted) JSON text, numbers their
    shortest form: 100.0 and 1e2 are 100.
    """
    head, *rest = path.split(".")
    if any(s in GUARDED_KEYS for s in (head, *rest)):
        return F.lit(None).cast("string")
    if not rest:
        if head in JSON_COLUMNS:
            return F.coalesce(F.to_json(F.try_parse_json(F.col(head))), F.col(head))
        return F.col(head).cast("string")
    if head not in JSON_COLUMNS:
        return F.lit(None).cast("string")
    # A plain lookup settles scalars without building the whole document;
    # missing, null and nested values take the exact way.
    fast = _fast_text(head, rest)
    slow = _node_text(_variant_at(head, rest))
    if fast is None:
        return slow
    # Bound in a lambda, the lookup runs once per row; a filter would repeat it
    # for every mention.
    whole = lambda v: ~v.rlike(_UNSETTLED_NUMBER) | ~v.rlike("[.eE]")
    settled = lambda v: F.when(v.isNotNull() & ~v.startswith("{") & ~v.startswith("[") & whole(v), v).otherwise(slow)
    return F.element_at(F.transform(F.array(fast), settled), 1)


def event_key(fields: Sequence[str]) -> Column:
    """Readable composite key: texts joined by '|', missing as ''."""
    return F.concat_ws("|", *[F.coalesce(path_text(f), F.lit("")) for f in fields])


def key_parts(fields: Sequence[str]) -> list[Column]:
    """The parts of the key, for grouping without collisions of the joined text."""
    return [F.coalesce(path_text(f), F.lit("")) for f in fields]


def js_text(value: object) -> str:
    """Text form of a configuration value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def truthy(path: str) -> Column:
    """JSON truthiness: everything but missing, null, false, 0 and ''."""
    text = path_text(path)
    head, *rest = path.split(".")
    if not rest or head not in JSON_COLUMNS:
        return F.coalesce(~text.isin("", "0", "false"), F.lit(False))
    node = _variant_at(head, rest)
    kind = F.schema_of_variant(node)
    is_text = kind == "STRING"
    falsy = (
        (kind == "VOID")
        | (is_text & (text == ""))
        | (~is_text & (text.isin("false") | (F.try_variant_get(node, "$", "double") == 0)))
    )
    return F.coalesce(node.isNotNull() & ~F.coalesce(falsy, F.lit(False)), F.lit(False))
