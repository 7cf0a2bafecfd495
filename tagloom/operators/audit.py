"""Comparing two computations of the same thing: rows, vectors, metrics, inventories."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_match(a: DataFrame, b: DataFrame, index: str, key: str) -> DataFrame:
    """Positions at which the two sides do not have the same key: (index, key_a, key_b), a missing side being NULL."""
    x, y = a.select(index, F.col(key).alias("key_a")), b.select(index, F.col(key).alias("key_b"))
    return x.join(y, index, "full").where(~F.col("key_a").eqNullSafe(F.col("key_b")))


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one side only."""
    ka, kb = a.select(key).distinct(), b.select(key).distinct()
    return ka.join(kb, key, "left_anti").withColumn("side", F.lit("missing_in_b")).unionByName(kb.join(ka, key, "left_anti").withColumn("side", F.lit("missing_in_a")))


def merge_shards(manifest: DataFrame, shards: DataFrame, key: str, index: str) -> DataFrame:
    """Shard rows in manifest order; manifest rows that no shard has keep NULLs (see ``set_difference`` for both kinds of error)."""
    extra = [c for c in shards.columns if c != key]
    return manifest.select(index, key).join(shards.select(key, *extra), key, "left").select(index, key, *extra)


def vector_diff(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """Per key of both sides: the largest absolute difference of the vectors and whether they are identical."""
    x, y = a.select(key, F.col(vector).alias("va")), b.select(key, F.col(vector).alias("vb"))
    diff = F.aggregate(F.zip_with("va", "vb", lambda p, q: F.abs(p - q)), F.lit(0.0), lambda m, d: F.greatest(m, d.cast("double")))
    return x.join(y, key).select(key, diff.alias("max_abs_delta"), F.col("va").eqNullSafe(F.col("vb")).alias("exact"))


def diff_summary(diff: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    return diff.agg(F.count("*").alias("records"), F.coalesce(F.max("max_abs_delta"), F.lit(0.0)).alias("max_abs_delta"), F.coalesce(F.bool_and("exact"), F.lit(True)).alias("all_exact"), F.count_if(F.col("max_abs_delta") > tolerance).alias("mismatches"))


def tidy(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Wide metrics -> (keys, metric, value)."""
    names = [c for c in metrics.columns if c not in keys]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return metrics.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.metric", "x.value")


def crosscheck(reported: DataFrame, recomputed: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Tidy metrics of two paths that differ by more than the tolerance, or that one path lacks."""
    a, b = reported.withColumnRenamed("value", "reported"), recomputed.withColumnRenamed("value", "recomputed")
    j = a.join(b, [*keys, "metric"], "full")
    same = F.coalesce(F.abs(F.col("reported") - F.col("recomputed")) <= tolerance, F.col("reported").isNull() & F.col("recomputed").isNull())
    return j.where(~same)


def provenance(expected: DataFrame, actual: DataFrame, name: str = "name", value: str = "sha256") -> DataFrame:
    """Names whose values differ or that one side lacks."""
    a, b = expected.select(name, F.col(value).alias("expected")), actual.select(name, F.col(value).alias("actual"))
    return a.join(b, name, "full").where(~F.col("expected").eqNullSafe(F.col("actual")))


def gates(values: DataFrame, limits: dict[str, float], partial: tuple[str, float]) -> DataFrame:
    """One row of values -> a flag per gate and the verdict: success if all hold, partial if one value reaches a lower mark, else fail."""
    flags = {f"gate_{n}": F.col(n) >= x for n, x in limits.items()}
    out = values.withColumns(flags)
    every: Column = F.lit(True)
    for n in flags:
        every = every & F.col(n)
    return out.withColumn("verdict", F.when(every, "success").when(F.col(partial[0]) >= partial[1], "partial").otherwise("fail"))


def worst(statuses: DataFrame, status: str, order: tuple[str, ...] = ("success", "partial", "fail")) -> DataFrame:
    """The worst of several verdicts; an unknown one counts as the last of the order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(status))
    top = F.max(F.when(place > 0, place).otherwise(len(order)))
    return statuses.agg(F.element_at(F.array(*map(F.lit, order)), F.coalesce(top, F.lit(1)).cast("int")).alias("verdict"))


def ordered_digest(rows: DataFrame, order: list[str], key: str) -> str:
    """SHA-256 of the keys in order, one per line.  A digest of bytes in order is sequential: sorted on the executors, it is taken as parts come in."""
    h = hashlib.sha256()
    for r in rows.select(*order, F.col(key).cast("string").alias("_k")).orderBy(*order).select("_k").toLocalIterator(prefetchPartitions=True):
        h.update(f"{r[0]}\n".encode())
    return h.hexdigest()


def cache_key(split: Column, key: Column, digits: int = 32) -> Column:
    """First digits of the SHA-256 of split and key with a zero byte between."""
    return F.substring(F.sha2(F.concat(split.cast("string"), F.char(F.lit(0)), key.cast("string")), 256), 1, digits)


def tagged_union(parts: dict[str, DataFrame], tag: str = "split") -> DataFrame:
    """All parts under each other, with the name of the part; columns that a part lacks are NULL."""
    out = None
    for n, df in parts.items():
        df = df.withColumn(tag, F.lit(n))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
