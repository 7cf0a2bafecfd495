"""Merging the evidence of a group: unions, conflicts, precedence and implications, all on cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import dimension

#: Order of claims about a label in a group: a stated presence, a presence of a positive-unlabelled label, a stated absence.
PN_POSITIVE, PU_POSITIVE, PN_NEGATIVE = 3, 2, 1


def claims(rows: DataFrame, group: str, lists: dict[int, str]) -> DataFrame:
    """(group, label_idx, pos_pn, pos_pu, neg): which claims the rows of a group make about a label."""
    parts = F.flatten(F.array(*[F.transform(F.coalesce(F.col(c), F.array().cast("array<int>")), _tag(code)) for code, c in lists.items()]))
    long = rows.select(group, F.explode(parts).alias("x"))
    has = lambda code: F.max((F.col("x.c") == code).cast("int"))
    return long.groupBy(group, F.col("x.i").alias("label_idx")).agg(has(PN_POSITIVE).alias("pos_pn"), has(PU_POSITIVE).alias("pos_pu"), has(PN_NEGATIVE).alias("neg"))


def _tag(code: int):
    return lambda i: F.struct(i.alias("i"), F.lit(code).alias("c"))


def exclusion_conflicts(claimed: DataFrame, group: str, dim: DataFrame) -> DataFrame:
    """(group, excl_group, positive labels) where two or more labels that exclude each other are claimed present."""
    g = dimension(dim.where("excl_group is not null").select(F.col("idx").alias("label_idx"), "excl_group"))
    pos = claimed.where("pos_pn = 1 or pos_pu = 1").join(g, "label_idx")
    return pos.groupBy(group, "excl_group").agg(F.array_sort(F.collect_set("label_idx")).alias("labels")).where("size(labels) >= 2")


def resolve(claimed: DataFrame, group: str, dim: DataFrame, implications: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """States (group, label_idx, label, known, pu) and conflicts (group, kind, excl_group, label_idx, detail).

    A group of exclusive labels with two positives becomes unknown as a whole.
    Elsewhere presence beats absence, with a note.  ``implications`` (rule,
    if_idx, if_state, then_idx) are applied once, to the states as they were:
    ``present`` means a label of 1, ``known_present`` and ``known_absent`` a stated
    one; a derived absence never touches a conflicted group and yields to a
    presence, with a note.
    """
    d = dimension(dim.select(F.col("idx").alias("label_idx"), "mode", "excl_group"))
    bad = exclusion_conflicts(claimed, group, dim)
    c = claimed.join(d, "label_idx").where("mode <> 'unsupported'").join(bad.select(group, "excl_group", F.lit(1).alias("bad")), [group, "excl_group"], "left")
    ok = c.where("bad is null")
    label = ((F.col("pos_pn") == 1) | (F.col("pos_pu") == 1)).cast("int")
    known = ((F.col("pos_pn") == 1) | ((F.col("pos_pu") == 0) & (F.col("neg") == 1))).cast("int")
    states = ok.select(group, "label_idx", label.alias("label"), known.alias("known"), (label - F.when(F.col("pos_pn") == 1, 1).otherwise(0)).alias("pu"))
    notes = bad.select(group, F.lit("mutually_exclusive_positive_conflict").alias("kind"), "excl_group", F.lit(None).cast("int").alias("label_idx"), F.array_join("labels", ",").alias("detail"))
    over = ok.where(((F.col("pos_pn") == 1) | (F.col("pos_pu") == 1)) & (F.col("neg") == 1)).select(group, F.lit("positive_overrode_negative").alias("kind"), F.lit(None).cast("string").alias("excl_group"), "label_idx", F.lit("").alias("detail"))
    notes = notes.unionByName(over)
    if implications is not None:
        rule = dimension(implications)
        holds = ((F.col("if_state") == "present") & (F.col("label") == 1)) | ((F.col("if_state") == "known_present") & (F.col("label") == 1) & (F.col("known") == 1)) | ((F.col("if_state") == "known_absent") & (F.col("label") == 0) & (F.col("known") == 1))
        fired = states.join(rule, F.col("label_idx") == F.col("if_idx")).where(holds).groupBy(group, F.col("then_idx").alias("label_idx")).agg(F.array_join(F.array_sort(F.collect_set("rule")), "; ").alias("why"))
        fired = fired.join(d, "label_idx").join(bad.select(group, "excl_group", F.lit(1).alias("bad")), [group, "excl_group"], "left").where("bad is null").select(group, "label_idx", "why")
        both = states.join(fired, [group, "label_idx"], "full")
        states = both.select(group, "label_idx", F.coalesce("label", F.lit(0)).alias("label"), F.when(F.col("why").isNotNull() & (F.coalesce("label", F.lit(0)) == 0), 1).otherwise(F.col("known")).alias("known"), F.coalesce("pu", F.lit(0)).alias("pu"))
        lost = both.where("label = 1 and why is not null").select(group, F.lit("positive_overrode_implication_negative").alias("kind"), F.lit(None).cast("string").alias("excl_group"), "label_idx", F.col("why").alias("detail"))
        notes = notes.unionByName(lost)
    return states, notes


def representative(rows: DataFrame, group: str, rank: list[str], columns: list[str]) -> DataFrame:
    """Per group the columns of the row that is first by ``rank``."""
    return rows.groupBy(group).agg(F.min(F.struct(*rank, *[c for c in columns if c not in rank])).alias("m")).select(group, *[F.col(f"m.{c}").alias(c) for c in columns])


def group_summary(rows: DataFrame, group: str, source: str, key: str) -> DataFrame:
    """Per group: sorted sources, number of rows, rows per source as counts, and the signature of its keys."""
    per = rows.groupBy(group, source).agg(F.count("*").alias("n"))
    return per.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(source).alias("source"), "n"))).alias("by_source"), F.sum("n").alias("binding_count")).select(group, F.col("by_source.source").alias("sources"), "binding_count", "by_source")
