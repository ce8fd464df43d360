"""Lookups against dimension tables of unknown size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a large left side, possibly with hot keys, to a lookup table.

    No hint: Spark sends the lookup table to every executor if its bytes, as
    estimated or as measured at run time, are below the session's threshold, and
    otherwise shuffles both sides and splits those partitions of the left side
    that turn out to be skewed.  Nothing is counted or copied beforehand.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    return left.join(right, list(on), how)
