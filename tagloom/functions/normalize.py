"""Normal forms of tags, digests, fingerprints, paths and identifiers.

All helpers are plain Column expressions, so they stay inside whole-stage code
generation and are pushed to the scan's stage.  Every helper maps NULL, blank
text and stand-ins for "no value" to NULL.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode White_Space, then the zero-width characters that come with pasted text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0            "
    "    　"
    "​‌‍⁠﻿"
)
# Strings that stand for a missing identifier or path.
STAND_INS = ("", "-", "--", "?", "n/a", "na", "nan", "nil", "none", "null", "unknown", "pending", "failed", "missing")

#: A label dictionary of at most this many written forms becomes a literal map; a larger one goes through a join.
MAP_LIMIT = 1024


def strip(c: Column) -> Column:
    """Outer white space of any kind removed."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    """NULL for blank text and for the stand-ins, else the stripped text."""
    s = strip(c)
    return F.when(F.lower(s).isin(*STAND_INS), None).otherwise(s)


def first_non_blank(*cols: Column) -> Column:
    """The first candidate with a value."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cols])


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` refers to it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def sha256_hex(c: Column) -> Column:
    """64 lower-case hex digits; a ``sha256:`` prefix is dropped; anything else is NULL."""
    return F.nullif(F.regexp_extract(F.lower(strip(c)), "^(?:sha256:)?([0-9a-f]{64})$", 1), F.lit(""))


def phash_hex(c: Column) -> Column:
    """16 lower-case hex digits of a 64-bit fingerprint; ``0x`` and dropped leading zeros are allowed."""
    return F.lpad(F.nullif(F.regexp_extract(F.lower(strip(c)), "^(?:0x)?([0-9a-f]{1,16})$", 1), F.lit("")), 16, "0")


def hex_to_long(c: Column) -> Column:
    """The two's-complement BIGINT of up to 16 hex digits."""
    return F.conv(c, 16, -10).cast("bigint")


def phash_long(c: Column) -> Column:
    return hex_to_long(phash_hex(c))


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def image_path(c: Column) -> Column:
    """One spelling for all names of a file.

    White space around it, percent-encoded or doubled separators, back slashes,
    a query string, ``.`` and ``..`` steps do not matter; stand-ins are NULL.
    """
    s = strip(c)
    for code, sign in (("%2F", "/"), ("%2f", "/"), ("%5C", "/"), ("%5c", "/"), ("%20", " ")):
        s = F.replace(s, F.lit(code), F.lit(sign))
    s = F.regexp_replace(F.translate(s, "\\", "/"), "(?s)[?#].*$", "")
    s = F.regexp_replace(s, "/{2,}", "/")

    def steps(x: Column) -> Column:
        kept = F.aggregate(
            F.filter(F.split(x, "/"), lambda p: p != "."),
            F.array().cast("array<string>"),
            lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p))),
        )
        walked = F.when(x.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(kept, "/")).otherwise(x)
        return F.when(F.lower(x).isin(*STAND_INS), None).otherwise(walked)

    return F.nullif(_once(s, steps), F.lit(""))


def record_name(c: Column) -> Column:
    """``PREFIX-number`` of an identifier, however written; another identifier is upper-cased; stand-ins are NULL.

    Letter case, the separator (dash, underscore, space, none) and leading
    zeros do not matter: prefix and number make the record.
    """
    s = F.regexp_replace(F.upper(strip(c)), r"^([A-Z]+)[\s_\-]*0*([0-9]+)$", "$1-$2")
    return F.when(s.isin(*map(str.upper, STAND_INS)), None).otherwise(s)


def tag_lookup(labels: DataFrame, aliases: DataFrame | None = None, limit: int = 100_000) -> dict[str, int]:
    """Written form -> label index, from the label dimension and its aliases.

    Both are dimension tables; more than ``limit`` rows raise, since the result
    is meant for a literal map or a small join.
    """
    rows = labels.select(strip(F.col("tag")).alias("t"), F.col("idx").cast("int").alias("i")).where("t is not null and i is not null").limit(limit + 1).collect()
    out = {r.t: r.i for r in sorted(rows, key=lambda r: (r.t, -r.i))}
    if aliases is not None:
        more = aliases.select(strip(F.col("alias")).alias("a"), strip(F.col("tag")).alias("t")).where("a is not null").limit(limit + 1).collect()
        rows += more
        for r in sorted(more, key=lambda r: (r.a, r.t or "")):
            if r.t in out:
                out.setdefault(r.a, out[r.t])
    if len(rows) > limit:
        raise ValueError(f"more than {limit} label names")
    return out


def label_indices(c: Column, lookup: dict[str, int]) -> Column:
    """Sorted distinct label indices of a tag list; tags outside the lookup count as nothing, a NULL list as an empty one."""
    empty = F.array().cast("array<int>")
    if not lookup:
        return empty
    if len(lookup) > MAP_LIMIT:
        return F.coalesce(_lookup_udf(lookup)(c), empty)
    # a map is searched from its beginning, so names are spread over small maps by a checksum
    parts: list[dict[str, int]] = [{} for _ in range(max(1, len(lookup) // 2))]
    for name, i in sorted(lookup.items()):
        parts[zlib.crc32(name.encode()) % len(parts)][name] = i
    maps = F.array(*[F.create_map(*[F.lit(x) for x in chain.from_iterable(p.items())]) if p else F.create_map().cast("map<string,int>") for p in parts])
    here = lambda s: F.try_element_at(F.get(maps, F.pmod(F.crc32(s), F.lit(len(parts))).cast("int")), s)
    found = F.transform(c, lambda t: _once(strip(t), here))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(found, lambda i: i.isNotNull()))), empty)


def _lookup_udf(lookup: dict[str, int]):
    @F.pandas_udf("array<int>")
    def find(tags: pd.Series) -> pd.Series:
        return tags.map(lambda ts: None if ts is None else sorted({lookup[k] for t in ts if t is not None and (k := t.strip(WHITE_SPACE)) in lookup}))

    return find
