"""Text forms of scores, durations and states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def two_decimals(score: Column, mode: Column | None = None, clamp: bool = True) -> Column:
    """Two decimals of the exact binary value, half to even; scores are clamped to [0, 1], an unsupported label is ``0.00``."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) if clamp else score
    out = F.regexp_replace(F.format_number(s, 2), ",", "")
    return out if mode is None else F.when(mode == "unsupported", F.lit("0.00")).otherwise(out)


def aspect_bucket(width: Column, height: Column) -> Column:
    """portrait below 0.8, landscape above 1.25, else square; NULL where the ratio is not known."""
    r = F.when(height > 0, width.cast("double") / F.nullif(height.cast("double"), F.lit(0.0)))
    return F.when(r < 0.8, "portrait").when(r > 1.25, "landscape").when(r.isNotNull(), "square")


def source_bucket(sources: Column, first: str, second: str) -> Column:
    """``mixed`` for both sources, ``dictionary`` if the second is among them, else ``jd``."""
    s = F.array_sort(F.array_distinct(sources))
    both = F.array_sort(F.array(F.lit(first), F.lit(second)))
    return F.when(s == both, "mixed").when(F.array_contains(s, second), "dictionary").otherwise("jd")


def cpu_text(percent: Column) -> Column:
    """One decimal below 10, none from there on."""
    plain = lambda d: F.regexp_replace(F.format_number(percent, d), ",", "")
    return F.concat(F.when(percent < 10, plain(1)).otherwise(plain(0)), F.lit("% CPU"))


def duration_text(seconds: Column) -> Column:
    """``MM:SS``, from an hour on ``HH:MM:SS``; negative durations are zero."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("bigint")
    two = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    tail = F.concat(two(m), F.lit(":"), two(s % 60))
    return F.when(s >= 3600, F.concat(two(h), F.lit(":"), tail)).otherwise(tail)


def percent_change(before: Column, after: Column) -> Column:
    """How much less ``after`` is, in per cent of ``before``; NULL where nothing was before."""
    return (before - after) / F.nullif(before, F.lit(0.0)) * 100


def offset_timestamp(text: Column) -> Column:
    """The instant of an ISO text that names its offset; NULL for text without one."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(F.regexp_replace(t, r"([+-]\d\d)(\d\d)$", "$1:$2")))
