"""Consolidating pairwise matches into groups by seed-tree pruning.

Each round, every vertex links itself and its neighbours to the least vertex of
its neighbourhood.  A vertex that nobody's minimum is drops out and hangs below
its own minimum in a propagation forest; the others go on with the links that
remain.  When no link is left the survivors are seeds, and their names flow down
the forest, last round first.  The number of rounds grows with the logarithm of
the longest chain.

Vertices are 64-bit hashes of the names while links are contracted.  A
collision would merge two groups, so the names are checked for one and hashed
with another seed if there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import Scratch

_EDGE = ("a", "b")


def _minima(edges: DataFrame) -> DataFrame:
    """Per vertex of undirected edges (stored once, a < b): the least of it and its neighbours."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    return both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("m"))


def contract(edges: DataFrame, scratch: Scratch, max_rounds: int = 200) -> tuple[list[DataFrame], int]:
    """Rounds of min selection and pruning over edges (a, b) of BIGINT.

    Returns the forest as one table (child, parent) per round and the number of
    rounds.  Self links are ignored, repeated and reversed edges count once.
    """
    e = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    forest: list[DataFrame] = []
    for _ in range(max_rounds):
        if e.isEmpty():
            scratch.drop(e)
            return forest, len(forest)
        low = _minima(e)
        # min selection: v -> m(v), and w -> m(v) for every neighbour w of v
        mv = low.select(F.col("v").alias("a"), F.col("m").alias("ma"))
        mw = low.select(F.col("v").alias("b"), F.col("m").alias("mb"))
        linked = e.join(mv, "a").join(mw, "b")
        arcs = linked.select(F.explode(F.array(*[F.struct(F.col(x).alias("v"), F.col(y).alias("w")) for x, y in (("a", "ma"), ("b", "mb"), ("a", "mb"), ("b", "ma"))])).alias("x")).select("x.*")
        arcs = scratch.keep(arcs.distinct(), "arcs")
        # pruning: v keeps its least target; it stays only if it is a target of its own
        best = arcs.groupBy("v").agg(F.min("w").alias("m"), F.max((F.col("v") == F.col("w")).cast("int")).alias("stays"))
        best = scratch.keep(best, "minima")
        forest.append(scratch.keep(best.where("stays = 0").select(F.col("v").alias("child"), F.col("m").alias("parent")), "forest"))
        nxt = arcs.join(best.select("v", "m"), "v").where("w <> m").select(F.least("w", "m").alias("a"), F.greatest("w", "m").alias("b")).distinct()
        nxt = scratch.keep(nxt, "edges")
        for old in (e, arcs, best):
            scratch.drop(old)
        e = nxt
    raise RuntimeError("contraction did not end")


def flow_down(forest: list[DataFrame], scratch: Scratch) -> DataFrame | None:
    """(v, seed) of every vertex that has a parent, from the last round up; seeds themselves are not listed.

    A parent dropped out in a later round or is a seed, so each layer looks up
    its parents in the layers named before it and is written once.
    """
    named: DataFrame | None = None
    for layer in reversed(forest):
        if named is None:
            named = layer.select(F.col("child").alias("v"), F.col("parent").alias("seed"))
            continue
        up = named.select(F.col("v").alias("parent"), "seed")
        here = layer.join(up, "parent", "left").select(F.col("child").alias("v"), F.coalesce("seed", "parent").alias("seed"))
        named = named.unionByName(scratch.keep(here, "named"))
    return named


def _hash(name: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(name))


def group_links(links: DataFrame, a: str = "key_a", b: str = "key_b", scratch: Scratch | None = None) -> DataFrame:
    """(key, group_key): every name that a link ties to another, with the least name of its group, by bytes.

    Links with a NULL end or from a name to itself tie nothing.  Repeated links
    and either order are fine.  An empty table gives an empty result.
    """
    spark = links.sparkSession
    scratch = scratch or Scratch(spark, "groups")
    pairs = links.select(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).where("x is not null and y is not null and x <> y")
    seed = 0
    while True:
        both = pairs.select("x", "y", _hash("x", seed).alias("a"), _hash("y", seed).alias("b"))
        both = scratch.keep(both, "links")
        ends = both.select(F.col("a").alias("v"), F.col("x").alias("key")).unionByName(both.select(F.col("b").alias("v"), F.col("y").alias("key")))
        names = scratch.keep(ends.groupBy("v").agg(F.min("key").alias("key"), F.max("key").alias("other")), "names")
        if names.where("key <> other").isEmpty():
            break
        seed += 1  # two names share a hash
    forest, _ = contract(both.select("a", "b"), scratch)
    scratch.drop(both)
    named = flow_down(forest, scratch)
    if named is None:
        return names.limit(0).select("key", F.col("key").alias("group_key"))
    whole = names.join(named, "v", "left").select("key", F.coalesce("seed", "v").alias("seed"))
    least = whole.groupBy("seed").agg(F.min("key").alias("group_key"))
    return whole.join(least, "seed").select("key", "group_key")


def star_links(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key_a, key_b): every key with the least key of its value, instead of all pairs of a value's keys.

    NULL values tie nothing.  A value that most rows share costs one row per key.
    """
    own = rows.select(F.col(key).alias("k"), F.col(value).alias("x")).where("k is not null and x is not null")
    least = own.groupBy("x").agg(F.min("k").alias("key_a"), F.max("k").alias("last")).where("key_a <> last").drop("last")
    return own.join(least, "x").where("k <> key_a").select("key_a", F.col("k").alias("key_b")).distinct()
