"""Per-label thresholds from running counts over the distinct scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.metrics import ratio
from tagloom.operators.ranked import count_if, totals_at_or_above


def _candidates(points: DataFrame, fallback: float) -> DataFrame:
    """Distinct (label, score) with counts a, b, and the fallback as one more candidate of every label."""
    extra = points.select("label_idx", "tag").distinct().select("label_idx", "tag", F.lit(fallback).alias("score"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    return points.unionByName(extra).groupBy("label_idx", "tag", "score").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _choose(t: DataFrame, key: list, enough, fallback: float, method: str, names: tuple[str, str]) -> DataFrame:
    best = t.groupBy("label_idx", "tag").agg(F.max(F.struct(*key, F.col("score").alias("t"))).getField("t").alias("best"), F.max("all_a").alias(names[0]), F.max("all_b").alias(names[1]))
    ok = enough(F.col(names[0]), F.col(names[1]))
    return best.select("label_idx", "tag", F.when(ok, F.col("best")).otherwise(F.lit(fallback)).alias("threshold"), F.lit(method).alias("method"), F.when(ok, "calibrated").otherwise("fallback_insufficient_support").alias("status"), F.col(names[0]), F.col(names[1]))


def pn_thresholds(cells: DataFrame, fallback: float = 0.5) -> DataFrame:
    """Best F1 over known cells; of equals the one nearest the fallback, then the larger; the fallback without both classes."""
    k = cells.where("mode = 'pn'").groupBy("label_idx", "tag", "score").agg(count_if((F.col("known") == 1) & (F.col("label") == 1)).alias("a"), count_if((F.col("known") == 1) & (F.col("label") == 0)).alias("b"))
    labels = k.select("label_idx", "tag").distinct()
    pts = _candidates(k.where("a + b > 0"), fallback)
    pts = pts.unionByName(labels.join(pts.select("label_idx").distinct(), "label_idx", "left_anti").select("label_idx", "tag", F.lit(fallback).alias("score"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")))
    t = totals_at_or_above(pts, ["label_idx", "tag"], "score", ["a", "b"])
    score = ratio(F.col("ge_a") * 2, F.col("ge_a") + F.col("ge_b") + F.col("all_a"))
    return _choose(t, [score.alias("f"), (-F.abs(F.col("score") - fallback)).alias("d")], lambda p, n: (p > 0) & (n > 0), fallback, "observed_pn_f1", ("known_positive", "known_negative"))


def pu_thresholds(cells: DataFrame, fallback: float = 0.5, least_positive: int = 5, least_unlabeled: int = 50) -> DataFrame:
    """Best recall minus coverage of the unlabelled; of equals the higher recall, the one nearest the fallback, the larger."""
    u = (F.col("known") == 0) & (F.col("pu") == 0)
    k = cells.where("mode = 'pu'").groupBy("label_idx", "tag", "score").agg(count_if(F.col("pu") == 1).alias("a"), count_if(u).alias("b"))
    t = totals_at_or_above(_candidates(k, fallback), ["label_idx", "tag"], "score", ["a", "b"])
    recall, cover = ratio(F.col("ge_a"), F.col("all_a")), ratio(F.col("ge_b"), F.col("all_b"))
    return _choose(t, [(recall - cover).alias("g"), recall.alias("r"), (-F.abs(F.col("score") - fallback)).alias("d")], lambda p, n: (p >= least_positive) & (n >= least_unlabeled), fallback, "positive_minus_unlabeled_coverage", ("positive", "unlabeled"))


def all_thresholds(cells: DataFrame, fallback: float = 0.5) -> DataFrame:
    """One row per label of any mode; an unsupported label has no threshold."""
    pn = pn_thresholds(cells, fallback).select("label_idx", "tag", F.lit("pn").alias("mode"), "threshold", "method", "status", F.create_map(F.lit("known_positive"), "known_positive", F.lit("known_negative"), "known_negative").alias("support"))
    pu = pu_thresholds(cells, fallback).select("label_idx", "tag", F.lit("pu").alias("mode"), "threshold", "method", "status", F.create_map(F.lit("positive"), "positive", F.lit("unlabeled"), "unlabeled").alias("support"))
    no = cells.where("mode = 'unsupported'").select("label_idx", "tag").distinct().select("label_idx", "tag", F.lit("unsupported").alias("mode"), F.lit(None).cast("double").alias("threshold"), F.lit("disabled").alias("method"), F.lit("disabled_unsupported").alias("status"), F.create_map().cast("map<string,bigint>").alias("support"))
    return pn.unionByName(pu).unionByName(no)
