"""Splits that keep related records together: grouped iterative stratification.

Records of one entity form a group; a record that names several entities ties
their groups into one, so groups are the components over all (record, entity)
links.  A group's label vector counts its records by label.  Groups are placed
with the rarest outstanding label first, each into the split that needs that
label most; ``tagloom.operators.stratify`` does that on counts, for any number
of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm import matchgroups
from tagloom.operators.stratify import stratify
from tagloom.session import Scratch

#: A group with more than one in so many records is joined to its records by a broadcast, so no task gets them all.
HOT = 1000


def _components(base: DataFrame, keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """``keyed`` with ``comp``: the least entity that the record's entities lead to, or NULL."""
    several = keyed.where("ent <> last").select("key")
    if several.isEmpty():
        return keyed.withColumnRenamed("ent", "comp").drop("last")
    ties = base.where("ent is not null").join(several, "key", "left_semi").select("key", "ent").distinct()
    least = ties.groupBy("key").agg(F.min("ent").alias("a"))
    named = matchgroups.group_links(ties.join(least, "key").select("a", F.col("ent").alias("b")), "a", "b", scratch).withColumnRenamed("key", "ent")
    # tied entities may be few with many records each, the others many: AQE splits what is large on the left
    return keyed.join(named, "ent", "left").withColumn("comp", F.coalesce("group_key", "ent")).drop("group_key", "ent", "last")


def split_groups(rows: DataFrame, key: str, entity: str, labels: str, shares: dict[str, float], seed: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """(key, entity_key, group_size, split): one row per key; keys of one entity share the split.

    ``entity_key`` is the least key of the group.  ``rows`` may repeat a key;
    NULL keys are no cases.  A NULL entity names nothing: a key without any is a
    group of its own.  ``labels`` is an ARRAY<INT> of label numbers from 0; of
    rows that repeat a key the first in order of the arrays holds; a NULL list
    is an empty one.  Empty rows give an empty result.
    """
    scratch = scratch or Scratch(rows.sparkSession, "splits")
    base = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(entity).alias("ent"), F.coalesce(F.col(labels), F.array().cast("array<int>")).alias("lab"))
    keyed = scratch.keep(base.groupBy("key").agg(F.min("ent").alias("ent"), F.max("ent").alias("last"), F.array_distinct(F.min("lab")).alias("lab")), "keys")
    keyed = _components(base, keyed, scratch)
    # label -1 counts the records of a group; counted before they are shuffled
    tied = keyed.where("comp is not null")
    cells = tied.select("comp", "key", F.explode(F.array_append("lab", F.lit(-1))).alias("label"))
    cells = cells.groupBy("comp", "label").agg(F.count("*").alias("n"), F.min(F.when(F.col("label") == -1, F.col("key"))).alias("k"))
    groups = cells.groupBy("comp").agg(
        F.max(F.when(F.col("label") == -1, F.col("n"))).alias("size"), F.min("k").alias("entity_key"),
        F.collect_list(F.when(F.col("label") >= 0, F.struct("label", "n"))).alias("vec"),  # at most one entry per label
    )
    one = lambda j: F.struct(j.alias("label"), F.lit(1).cast("bigint").alias("n"))
    alone = keyed.where("comp is null").select(F.lit(None).cast("string").alias("comp"), F.lit(1).cast("bigint").alias("size"), F.col("key").alias("entity_key"), F.transform("lab", one).alias("vec"))
    # the two kinds never meet, whatever their names are
    every = groups.unionByName(alone).withColumn("gid", F.coalesce(F.concat(F.lit("e"), "comp"), F.concat(F.lit("k"), "entity_key"))).withColumn("group_size", F.col("size"))
    placed = scratch.keep(stratify(every, "gid", shares, seed, scratch=scratch, carry=("comp", "entity_key", "group_size")), "placed")
    out = placed.where("comp is null").select(F.col("entity_key").alias("key"), "entity_key", "group_size", "split")
    return out.unionByName(_to_records(tied.select("key", "comp"), placed.where("comp is not null").drop("gid")))


def _to_records(tied: DataFrame, placed: DataFrame) -> DataFrame:
    n = placed.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("n")).first().n
    hot: Column = F.col("group_size") * HOT > n
    large = F.broadcast(placed.where(hot))  # fewer than HOT rows, as their sizes sum to at most n
    cols = ["key", "entity_key", "group_size", "split"]
    a = tied.join(large, "comp").select(*cols)
    b = tied.join(large.select("comp"), "comp", "left_anti").join(placed.where(~hot), "comp").select(*cols)
    return a.unionByName(b)


def share_report(placed: DataFrame, rows: DataFrame, key: str, labels: str, shares: dict[str, float]) -> DataFrame:
    """(label_idx, split, records, share, deviation): how far each label's share of a split is from the one asked for; label NULL is all records."""
    lab = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.array_distinct(F.min(F.coalesce(F.col(labels), F.array().cast("array<int>")))).alias("lab"))
    long = placed.join(lab, "key").select("split", F.explode(F.array_append("lab", F.lit(None).cast("int"))).alias("label_idx"))
    per = long.groupBy("label_idx").agg(F.count("*").alias("n"), *[F.count_if(F.col("split") == s).alias(f"s{i}") for i, s in enumerate(shares)])
    total = sum(shares.values())
    parts = F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"s{i}").alias("records"), F.lit(v / total).alias("asked")) for i, (s, v) in enumerate(shares.items())])
    x = per.select("label_idx", "n", F.explode(parts).alias("x"))
    return x.select("label_idx", "x.split", "x.records", (F.col("x.records") / F.col("n")).alias("share"), (F.col("x.records") / F.col("n") - F.col("x.asked")).alias("deviation"))
