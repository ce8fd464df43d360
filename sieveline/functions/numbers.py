"""Rounding and deterministic sampling numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_js(value: Column, digits: int = 0) -> Column:
    """Round half toward plus infinity."""
    if digits == 0:
        return F.floor(value + F.lit(0.5))
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def hash_sample(identifier: Column) -> Column:
    """Uniform number in [0, 1) from an id: replayable, unlike a random draw."""
    return F.conv(F.substring(F.md5(identifier), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
