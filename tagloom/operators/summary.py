"""Totals and reports over built records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators import quality
from tagloom.operators.identity import band_keys, near_pairs


def grouping_totals(rows: DataFrame, group: str, by: Sequence[str], scratch=None) -> DataFrame:
    """(dimension, value, n): input rows, groups, rows merged away, and rows by each column of ``by``, in one pass."""
    sets = [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in by]
    per = rows.select(F.explode(F.array(F.struct(F.lit("rows").alias("dimension"), F.lit(None).cast("string").alias("value")), *sets)).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
    n_groups = rows.where(F.col(group).isNotNull()).select(group).distinct().agg(F.count("*").alias("g"))
    some = rows.agg(F.count(group).alias("r")).join(n_groups, F.lit(True))  # one row each
    extra = some.select(F.explode(F.array(F.struct(F.lit("groups").alias("dimension"), F.col("g").alias("n")), F.struct(F.lit("merged").alias("dimension"), (F.col("r") - F.col("g")).alias("n")))).alias("x"))
    return per.unionByName(extra.select("x.dimension", F.lit(None).cast("string").alias("value"), "x.n"))


def source_bits(cells: DataFrame, sources: str) -> DataFrame:
    """(source, records, known_positive, known_negative, pu_positive): supervision bits per source; a record counts for each of its sources."""
    c = cells.select("record_id", "label", "known", "pu", F.explode(sources).alias("source"))
    one = lambda x: F.count_if(x)
    return c.groupBy("source").agg(F.count_distinct("record_id").alias("records"), one((F.col("known") == 1) & (F.col("label") == 1)).alias("known_positive"), one((F.col("known") == 1) & (F.col("label") == 0)).alias("known_negative"), one(F.col("pu") == 1).alias("pu_positive"))


def near_statistics(rows: DataFrame, h: str, k: int = 2, bands: int = 4) -> DataFrame:
    """One row: rows, rows with a value, different values, pairs that share enough bands, pairs within ``k`` bits."""
    base = rows.agg(F.count("*").alias("rows"), F.count(h).alias("with_value"))
    v = rows.select(F.col(h).alias("h")).where("h is not null").distinct()
    cut = v.select("h", F.posexplode(band_keys(F.col("h"), k, bands)).alias("i", "b"))
    met = cut.withColumnRenamed("h", "x").join(cut.withColumnRenamed("h", "y"), ["i", "b"]).where("x < y").select("x", "y").distinct()
    near = near_pairs(rows, h, k, bands)
    out = base
    for name, df in (("different_values", v), ("candidate_pairs", met), ("accepted_pairs", near)):
        out = out.join(df.agg(F.count("*").alias(name)), F.lit(True))  # one row each
    return out


def label_report(viewed: DataFrame, flag: str, dictionary: Column, common: int = 20, least_f1: float = 0.5) -> DataFrame:
    """One row per supported label with its figures and a warning.

    PN labels have the confusion figures, PU labels recall and coverage of the
    unlabelled; both the recall on the records that ``dictionary`` selects.  A PN
    label with ``common`` positives or more warns of an F1 below ``least_f1``, a
    PU label with dictionary positives of which none was found of that.
    """
    pn = quality.by_label(viewed, flag).select(
        "label_idx", "tag", F.lit("pn").alias("mode"), F.col("known_positive").alias("positive_support"), F.col("known_negative").alias("negative_support"), "tp", "fp", "fn", "tn",
        "precision", "recall", "f1", "specificity", F.lit(None).cast("bigint").alias("unlabeled_support"), F.lit(None).cast("double").alias("unlabeled_coverage"),
    )
    none = {c: F.lit(None).cast(t).alias(c) for t, cs in (("bigint", ("negative_support", "tp", "fp", "fn", "tn")), ("double", ("precision", "f1", "specificity"))) for c in cs}
    pu = quality.pu_by_label(viewed, flag).select(
        "label_idx", "tag", F.lit("pu").alias("mode"), F.col("positive_count").alias("positive_support"), *[none[c] for c in ("negative_support", "tp", "fp", "fn", "tn", "precision")],
        F.col("positive_recall").alias("recall"), none["f1"], none["specificity"], F.col("unlabeled_count").alias("unlabeled_support"), "unlabeled_coverage",
    )
    told = quality.positive_recall(viewed.where(dictionary), flag).select("label_idx", F.col("positive_support").alias("dictionary_support"), F.col("recall").alias("dictionary_recall"))
    t = pn.unionByName(pu).join(told, "label_idx", "left").withColumn("dictionary_support", F.coalesce("dictionary_support", F.lit(0)))
    low = (F.col("mode") == "pn") & (F.col("positive_support") >= common) & (F.col("f1") < least_f1)
    lost = (F.col("mode") == "pu") & (F.col("dictionary_support") > 0) & (F.col("dictionary_recall") == 0)
    return t.withColumn("warning", F.when(low, "low_f1_of_common_label").when(lost, "no_dictionary_positive_found").otherwise(""))
