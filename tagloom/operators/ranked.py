"""Running totals along a score, for groups too large to be sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def unit_bucket(score: Column, buckets: int = 512, low: float = 0.0, high: float = 1.0) -> Column:
    """Number of one of the equal parts of [low, high] that a score falls into; what lies outside goes to the first or last."""
    return F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor((score - low) / (high - low) * buckets))).cast("int")


def wide_bucket(value: Column, per_octave: int = 8) -> Column:
    """A bucket number that never falls as the value grows, for values of any size."""
    return F.floor(F.signum(value) * F.log2(F.lit(1.0) + F.abs(value) * 1024) * per_octave).cast("int")


def totals_at_or_above(points: DataFrame, group: list[str], score: str, sums: list[str], bucket: Column | None = None, total: str | None = "all_") -> DataFrame:
    """Adds per column of ``sums`` its sum over the rows of the group with the same or a higher score, as ``ge_<name>``.

    ``points`` has one row per (group, score).  ``bucket`` (by default parts of
    [0, 1]) must not fall as the score grows.  Only bucket sums are added up
    across a group; rows are sorted within a bucket.  ``total`` prefixes the sums
    over the whole group.
    """
    b = unit_bucket(F.col(score)) if bucket is None else bucket
    rows = points.withColumn("_b", b)
    per = rows.groupBy(*group, "_b").agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
    w = Window.partitionBy(*group)
    above = w.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum(f"_s_{s}").over(w).alias(f"{total}{s}") for s in sums] if total else []
    per = per.select(*group, "_b", *[F.coalesce(F.sum(f"_s_{s}").over(above), F.lit(0)).alias(f"_o_{s}") for s in sums], *extra)
    inner = Window.partitionBy(*group, "_b").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(per, [*group, "_b"])
    out = joined.select(*points.columns, *[(F.col(f"_o_{s}") + F.sum(s).over(inner)).alias(f"ge_{s}") for s in sums], *([f"{total}{s}" for s in sums] if total else []))
    return out


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("bigint")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, letter case aside."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name += "_"
    return name


def spread_rank(df: DataFrame, group: list[str], order: list[Column], out: str, buckets: int = 4096, weight: Column | None = None, out_total: str | None = None) -> DataFrame:
    """1-based rank of every row within its group, for groups that no single task could sort.

    ``order`` must begin with a BIGINT that is uniform over its range, such as
    ``xxhash64``: its top bits name a bucket.  Rows are counted per (group,
    bucket), a window over those few counts gives each bucket its offset, and
    rows are ranked within a bucket only.  With ``weight`` the rank becomes the
    sum of the weights before the row.  ``out_total`` adds the group's total.
    """
    b, off, tot, h, h2 = fresh(df, "_bucket"), fresh(df, "_offset"), out_total or fresh(df, "_total"), fresh(df, "_hash"), fresh(df, "_hash2")
    w = F.lit(1) if weight is None else weight
    rows = df.withColumn(b, F.floor((F.shiftrightunsigned(order[0], 32) * F.lit(buckets)) / F.lit(1 << 32)).cast("int"))
    # 128 bits stand for (group, bucket), NULL groups as well, so one exchange serves the join and the window
    both = lambda t: t.withColumn(h, F.xxhash64(F.lit(1), *group, b)).withColumn(h2, F.xxhash64(F.lit(2), *group, b))
    rows = both(rows)
    counts = rows.groupBy(*group, b, h, h2).agg(F.sum(w).alias("_n"))
    by_group = Window.partitionBy(*group)
    before = by_group.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(h, h2, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(off), F.sum("_n").over(by_group).alias(tot))
    joined = rows.join(counts, [h, h2])
    inner = Window.partitionBy(h, h2).orderBy(*order)
    if weight is None:
        ranked = joined.withColumn(out, (F.col(off) + F.row_number().over(inner)).cast("bigint"))
    else:
        prior = F.coalesce(F.sum(w).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = joined.withColumn(out, F.col(off) + prior)
    ranked = ranked.drop(h, h2)
    return ranked.drop(b, off) if out_total else ranked.drop(b, off, tot)


def values_at(points: DataFrame, group: list[str], score: str, n: str, at: dict[str, Column], bucket: Column | None = None) -> DataFrame:
    """Per group the score at given 0-based places of the sorted rows, and ``total`` rows.

    ``points`` has one row per (group, score) and how often it occurs, ``n``;
    ``at`` maps a column to a place, an expression over ``total``.  No task sorts
    a whole group.
    """
    t = totals_at_or_above(points, group, score, [n], bucket)
    total, last = F.col(f"all_{n}"), F.col(f"all_{n}") - F.col(f"ge_{n}") + F.col(n) - 1
    first = F.col(f"all_{n}") - F.col(f"ge_{n}")
    t = t.withColumn("total", total)
    hit = [F.max(F.when((first <= place) & (place <= last), F.col(score))).alias(name) for name, place in at.items()]
    return t.groupBy(*group).agg(F.max("total").alias("total"), *hit)
