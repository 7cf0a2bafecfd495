"""Helpers that several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.operators.ranked import fresh, spread_rank

__all__ = ["fresh", "keep_order_hash", "spread_rank"]


def keep_order_hash(seed: int, *cols: str | Column) -> Column:
    """A seeded 64-bit hash that serves as a permutation of the rows."""
    return F.xxhash64(F.lit(seed), *cols)
