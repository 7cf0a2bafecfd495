"""Exact and near identity of records: closures over shared digests and fingerprints."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.normalize import hamming64
from tagloom.session import Scratch


def value_links(rows: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """(a, b): each key with the least key that shares a value, per kind of value; as many rows as keys at most, however common a value is."""
    named = F.array(*[F.struct(F.lit(n).alias("kind"), v.cast("string").alias("v")) for n, v in values.items()])
    long = rows.select(F.col(key).alias("b"), F.explode(named).alias("x")).where("x.v is not null and b is not null").select("b", "x.kind", "x.v")
    least = long.groupBy("kind", "v").agg(F.min("b").alias("a"))
    return long.join(least, ["kind", "v"]).where("a <> b").select("a", "b").distinct()


def components(links: DataFrame, scratch: Scratch | None = None, max_rounds: int = 100) -> DataFrame:
    """(v, component): the least vertex that links lead to; vertices without a link are not listed.

    Alternates hooking (a vertex takes the least label of its neighbours) with
    pointer jumping (a label takes its own label), so chains of any form shrink
    geometrically.
    """
    spark = links.sparkSession
    scratch = scratch or Scratch(spark, "components")
    e = scratch.keep(links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = scratch.keep(e.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    for _ in range(max_rounds):
        near = e.join(label.select(F.col("v").alias("b"), "component"), "b").groupBy(F.col("a").alias("v")).agg(F.min("component").alias("near"))
        # hook the vertex and, through it, the root that it pointed to
        hooked = label.join(near, "v", "left").select("v", "component", F.least("component", "near").alias("c"))
        roots = hooked.groupBy(F.col("component").alias("r")).agg(F.min("c").alias("rc"))
        step = hooked.join(roots, hooked["component"] == roots["r"], "left").select("v", F.least("c", "rc").alias("c"))
        up = step.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        new = scratch.keep(step.join(up, "c", "left").select("v", F.coalesce(F.least("c", "cc"), "c").alias("component")), "labels")
        changed = new.join(label.withColumnRenamed("component", "old"), "v").where("component <> old").isEmpty()
        scratch.drop(label)
        label = new
        if changed:
            return label
    raise RuntimeError("labels did not settle")


def exact_groups(rows: DataFrame, key: str, values: dict[str, Column], scratch: Scratch | None = None) -> DataFrame:
    """(key, group_key) for every key: records that share any of the values, directly or through others."""
    keys = rows.select(F.col(key).alias("v")).where("v is not null").distinct()
    c = components(value_links(rows, key, values), scratch)
    return keys.join(c, "v", "left").select(F.col("v").alias(key), F.coalesce("component", "v").alias("group_key"))


def signature(members: Column, prefix: str, digits: int) -> Column:
    """``prefix`` and the first digits of the SHA-256 of the sorted members, one per line."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.array_join(F.sort_array(members), "\n"), 256), 1, digits))


def band_keys(h: Column, k: int, bands: int) -> Column:
    """One 64-bit key per choice of ``bands - k`` bands: the bits of these bands, the others 0."""
    width = 64 // bands
    keys = []
    for kept in itertools.combinations(range(bands), bands - k):
        mask = sum(((1 << width) - 1) << (width * i) for i in kept)
        keys.append(h.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    return F.array(*keys)


def near_pairs(values: DataFrame, h: str, k: int = 2, bands: int = 4) -> DataFrame:
    """(h_a, h_b, distance), h_a < h_b: different 64-bit values within ``k`` < ``bands`` bits.

    With at most k flipped bits at least ``bands - k`` bands are equal, so values
    are joined on every choice of so many bands (of 4 bands and k = 2: six keys
    of 32 bits each) and candidates verified before the distinct.
    """
    if k >= bands or 64 % bands:
        raise ValueError("needs more bands than differing bits, of equal width")
    v = values.select(F.col(h).alias("h")).where("h is not null").distinct()
    cut = v.select("h", F.posexplode(band_keys(F.col("h"), k, bands)).alias("i", "b"))
    a, b = cut.withColumnRenamed("h", "h_a"), cut.withColumnRenamed("h", "h_b")
    d = hamming64(F.col("h_a"), F.col("h_b"))
    return a.join(b, ["i", "b"]).where((F.col("h_a") < F.col("h_b")) & (d <= k)).select("h_a", "h_b", d.alias("distance")).distinct()


def near_components(rows: DataFrame, key: str, h: str, k: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """(key, component) of rows whose fingerprints are equal or chain through neighbours within ``k`` bits; a row without one is alone."""
    pairs = near_pairs(rows, h, k).select(F.col("h_a").alias("a"), F.col("h_b").alias("b"))
    c = components(pairs, scratch)
    base = rows.select(F.col(key), F.col(h).alias("v"))
    least = base.join(c, "v", "left").select(key, F.coalesce("component", "v").alias("root"))
    name = least.where("root is not null").groupBy("root").agg(F.min(key).alias("component"))
    return least.join(name, "root", "left").select(key, F.coalesce("component", F.col(key)).alias("component"))


def leakage(rows: DataFrame, split: str, values: dict[str, Column]) -> DataFrame:
    """(kind, value, splits): values that stand in more than one split; array values are taken apart by the caller."""
    named = F.array(*[F.struct(F.lit(n).alias("kind"), v.cast("string").alias("value")) for n, v in values.items()])
    long = rows.select(F.col(split).alias("s"), F.explode(named).alias("x")).where("x.value is not null and s is not null")
    return long.groupBy(F.col("x.kind").alias("kind"), F.col("x.value").alias("value")).agg(F.array_sort(F.collect_set("s")).alias("splits")).where("size(splits) > 1")


def overlay(rows: DataFrame, identities: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join of an identity table; a row's own non-blank value wins.  Identities must be unique by key (see ``contracts.duplicates``)."""
    ids = identities.select(key, *[F.col(c).alias(f"_id_{c}") for c in columns])
    own = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    return rows.join(ids, key, "left").select(*[c for c in rows.columns if c not in columns], *[F.coalesce(own(c), F.col(f"_id_{c}")).alias(c) for c in columns])
