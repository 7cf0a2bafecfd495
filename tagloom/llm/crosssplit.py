"""Same or near-same records across splits, by an edit-distance segment join.

A value of an evaluation split is cut into k + 1 segments.  If a training value
is within k edits, one segment stands in it unchanged, shifted by no more than
the edits before and after allow.  So training values are probed with their
substrings at those positions only, and what meets is verified by banded
dynamic programming (``levenshtein`` with a threshold).  With k = 0 the value is
one segment, which is the equality join.

The join runs over the different values of either side, not over rows; rows are
put back afterwards.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import Scratch


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """(start, size) of k + 1 segments of as even a size as can be, the longer ones last; start is 0-based."""
    n, base = k + 1, length // (k + 1)
    out, at = [], 0
    for i in range(n):
        size = base + (1 if i >= n - length % n else 0)
        out.append((at, size))
        at += size
    return out


def allowed_starts(length: int, other: int, k: int) -> list[tuple[int, int, int]]:
    """(segment, start in the other string, size): where a segment of a string of ``length`` can stand in one of ``other``.

    With i the number of the segment (from 0), at most i edits come before it
    and at most k - i after it, or else another segment matches too.
    """
    d, out = other - length, []
    for i, (p, size) in enumerate(segments(length, k)):
        lo, hi = max(p - i, p + d - (k - i)), min(p + i, p + d + (k - i))
        out += [(i, s, size) for s in range(max(0, lo), min(other - size, hi) + 1)]
    return out


def near_values(evaluation: DataFrame, training: DataFrame, k: int, value: str = "value", length: int | None = None, aligned: bool = False, together: int = 1) -> DataFrame:
    """(eval_value, train_value): different pairs of values within ``k`` edits of each other, equal ones included.

    Both inputs are used as sets; NULL values match nothing.  ``length`` is the
    length that all values have, if it is fixed; otherwise lengths are taken per
    value and pairs up to ``k`` apart in length are probed.

    ``aligned`` (with ``length``) is for values in which nothing is inserted or
    dropped: the allowed position of a segment is its own.  Then values may be
    cut into k + ``together`` segments, of which ``together`` stand unchanged,
    and are matched on every choice of so many, which makes chance matches rarer.
    """
    e = evaluation.select(F.col(value).alias("ev")).where("ev is not null").distinct()
    t = training.select(F.col(value).alias("tv")).where("tv is not null").distinct()
    if k == 0:
        return e.join(t, F.col("ev") == F.col("tv")).select(F.col("ev").alias("eval_value"), F.col("tv").alias("train_value"))
    if aligned:
        if length is None or not 1 <= together <= length - k:
            raise ValueError("aligned values need a fixed length, and segments of at least one character")
        parts = segments(length, k + together - 1)
        choices = list(itertools.combinations(parts, together))
        keys = lambda c: F.array(*[F.struct(F.lit(length).alias("len"), F.lit(i).alias("i"), F.concat(*[F.substring(c, p + 1, n) for p, n in choice]).alias("s")) for i, choice in enumerate(choices)])
        es, ts = e.select("ev", F.explode(keys("ev")).alias("g")), t.select("tv", F.explode(keys("tv")).alias("g"))
    elif length is not None:
        cut = [F.struct(F.lit(length).alias("len"), F.lit(i).alias("i"), F.substring("ev", p + 1, n).alias("s")) for i, (p, n) in enumerate(segments(length, k))]
        probe = [F.struct(F.lit(length).alias("len"), F.lit(i).alias("i"), F.substring("tv", p + 1, n).alias("s")) for i, p, n in allowed_starts(length, length, k)]
        es = e.select("ev", F.explode(F.array(*cut)).alias("g"))
        ts = t.select("tv", F.explode(F.array_distinct(F.array(*probe))).alias("g"))
    else:
        es = e.select("ev", F.explode(_cut(F.col("ev"), k)).alias("g"))
        ts = t.select("tv", F.explode(F.array_distinct(_probes(F.col("tv"), k))).alias("g"))
    met = es.select("ev", "g.*").join(ts.select("tv", "g.*"), ["len", "i", "s"])
    # verified before the pairs that met more than once are made one
    near = met.where(F.levenshtein("ev", "tv", k) >= 0)
    return near.select(F.col("ev").alias("eval_value"), F.col("tv").alias("train_value")).distinct()


def _bounds(n: Column, i: Column, k: int) -> tuple[Column, Column]:
    """Start (0-based) and size of segment i of a string of length n."""
    base, longer = F.floor(n / (k + 1)), n % (k + 1)
    short = F.lit(k + 1) - longer
    extra = F.greatest(i - short, F.lit(0))
    return (base * i + extra).cast("int"), (base + F.when(i >= short, 1).otherwise(0)).cast("int")


def _cut(c: Column, k: int) -> Column:
    n = F.char_length(c)

    def one(i: Column) -> Column:
        p, size = _bounds(n, i, k)
        return F.struct(n.alias("len"), i.cast("int").alias("i"), F.substr(c, p + 1, size).alias("s"))

    return F.transform(F.array(*map(F.lit, range(k + 1))), one)


def _probes(c: Column, k: int) -> Column:
    """Substrings of a training value at the allowed positions, for evaluation values of each length within k of its own."""
    m = F.char_length(c)
    out = []
    for d in range(-k, k + 1):  # evaluation length n = m + d
        n = m + d
        for i in range(k + 1):
            p, size = _bounds(n, F.lit(i), k)
            for shift in range(max(-i, -d - (k - i)), min(i, -d + (k - i)) + 1):
                s = p + shift
                ok = (n >= 0) & (s >= 0) & (s + size <= m)
                out.append(F.when(ok, F.struct(n.alias("len"), F.lit(i).alias("i"), F.substr(c, (s + 1).cast("int"), size).alias("s"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


class Near(NamedTuple):
    """A value compared within ``k`` edits: its length if fixed, an exact check over eval_value and train_value, and how it is cut."""

    value: Column
    k: int
    length: int | None = None
    check: Column | None = None
    aligned: bool = False
    together: int = 1


class Overlaps:
    """What the evaluation side shares with the training side.

    ``side`` is 'train' or 'eval'; rows with another or no side, or without a
    key, are no cases.  ``exact`` are values compared for equality (the segment
    join with k = 0, on 128 bits of their hashes), ``near`` those within some
    edits.  The rows are read once, into a table of hashes and near values.

    A value is a class of keys.  ``members`` is linear in the rows however common
    a value is; ``pairs`` has a row per pair of keys, by its definition.
    """

    def __init__(self, rows: DataFrame, key: str, side: str, exact: dict[str, Column], near: dict[str, Near], scratch: Scratch | None = None):
        if not exact and not near:
            raise ValueError("nothing to compare")
        self.exact, self.near = list(exact), near
        scratch = scratch or Scratch(rows.sparkSession, "overlaps")
        base = rows.where(F.col(key).isNotNull() & F.col(side).isin("train", "eval"))
        # values first, in a projection of their own, so that each is computed once
        base = base.select(F.col(key).alias("k"), (F.col(side) == "train").alias("train"), *[c.alias(f"x{i}") for i, c in enumerate(exact.values())], *[n.value.alias(f"v{i}") for i, n in enumerate(near.values())])
        hashed = [F.when(F.col(f"x{i}").isNotNull(), h).alias(f"{n}{i}") for i in range(len(exact)) for n, h in (("a", F.xxhash64(f"x{i}")), ("b", F.xxhash64(F.lit("second"), f"x{i}")))]
        self.base = scratch.keep(base.select("k", "train", *hashed, *[f"v{i}" for i in range(len(near))]), "values")
        self.scratch, self._links = scratch, {}

    def _long(self, train: bool) -> DataFrame:
        named = [F.when(F.col(f"a{i}").isNotNull(), F.struct(F.lit(i).alias("by"), F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"))) for i in range(len(self.exact))]
        own = self.base.where(F.col("train") == train).select("k", F.explode(F.filter(F.array(*named), lambda x: x.isNotNull())).alias("x"))
        return own.select("k", "x.by", "x.a", "x.b")

    def _values(self, i: int, train: bool) -> DataFrame:
        return self.base.where((F.col("train") == train) & F.col(f"v{i}").isNotNull()).select("k", F.col(f"v{i}").alias("value"))

    def links(self, i: int) -> DataFrame:
        """(eval_value, train_value) of the i-th near value: links between classes."""
        if i not in self._links:
            n = list(self.near.values())[i]
            met = near_values(self._values(i, False), self._values(i, True), n.k, length=n.length, aligned=n.aligned, together=n.together)
            self._links[i] = self.scratch.keep(met if n.check is None else met.where(n.check), "links")
        return self._links[i]

    def _name(self) -> Column:
        return F.get(F.array(*[F.lit(n) for n in self.exact]), F.col("by")).alias("by")

    def pairs(self) -> DataFrame:
        """(train_key, eval_key, by): a pair found in several ways has one row per way."""
        parts = []
        if self.exact:
            t, e = self._long(True).withColumnRenamed("k", "train_key"), self._long(False).withColumnRenamed("k", "eval_key")
            parts.append(t.join(e, ["a", "b", "by"]).select("train_key", "eval_key", self._name()))
        for i, name in enumerate(self.near):
            t = self._values(i, True).select(F.col("k").alias("train_key"), F.col("value").alias("train_value"))
            e = self._values(i, False).select(F.col("k").alias("eval_key"), F.col("value").alias("eval_value"))
            parts.append(self.links(i).join(e, "eval_value").join(t, "train_value").select("train_key", "eval_key", F.lit(name).alias("by")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct()

    def members(self) -> DataFrame:
        """(eval_key, by, class, links): each evaluation key with the class of its value and the number of training keys that the class is linked to."""
        parts = []
        if self.exact:
            n = self._long(True).groupBy("a", "b", "by").agg(F.count_distinct("k").alias("links"))
            e = self._long(False).distinct()
            one = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
            parts.append(e.join(n, ["a", "b", "by"]).select(F.col("k").alias("eval_key"), self._name(), F.concat(one("a"), one("b")).alias("class"), "links"))
        for i, name in enumerate(self.near):
            n = self._values(i, True).groupBy(F.col("value").alias("train_value")).agg(F.count_distinct("k").alias("n"))
            per = self.links(i).join(n, "train_value").groupBy(F.col("eval_value").alias("value")).agg(F.sum("n").alias("links"))
            e = self._values(i, False).distinct()
            parts.append(e.join(per, "value").select(F.col("k").alias("eval_key"), F.lit(name).alias("by"), F.col("value").alias("class"), "links"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
