"""Masked metrics: known cells only for PN labels, positives against unlabelled for PU labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.metrics import from_counts, ratio
from tagloom.operators.ranked import count_if, totals_at_or_above, unit_bucket, values_at


def confusion(cells: DataFrame, by: list[str], flag: str = "raw") -> DataFrame:
    """tp, fp, fn, tn over known cells of PN labels, per ``by``."""
    k = cells.where("known = 1 and mode = 'pn'")
    y, p = F.col("label") == 1, F.col(flag) == 1
    return k.groupBy(*by).agg(count_if(y & p).alias("tp"), count_if(~y & p).alias("fp"), count_if(y & ~p).alias("fn"), count_if(~y & ~p).alias("tn"))


def by_label(cells: DataFrame, flag: str = "raw", extra: list[str] | None = None) -> DataFrame:
    return confusion(cells, [*(extra or []), "label_idx", "tag"], flag).withColumns(from_counts())


def micro_macro(cells: DataFrame, flag: str = "raw", by: list[str] | None = None) -> DataFrame:
    """One row per ``by``: micro counts and figures, macro means over labels with cells, over labels with both classes, over labels with positives."""
    by = by or []
    per = by_label(cells, flag, by)
    both = (F.col("known_positive") > 0) & (F.col("known_negative") > 0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = per.groupBy(*by).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "tn")],
        *[zero(F.avg(c)).alias(f"macro_{c}") for c in ("precision", "recall", "f1", "specificity", "fpr", "accuracy")],
        F.count("*").alias("labels_evaluated"),
        count_if(both).alias("labels_with_both_classes"),
        zero(F.avg(F.when(both, F.col("f1")))).alias("macro_f1_both_classes"),
        count_if(F.col("known_positive") > 0).alias("labels_with_positives"),
        zero(F.avg(F.when(F.col("known_positive") > 0, F.col("recall")))).alias("macro_recall_with_positives"),
    )
    return out.withColumns(from_counts())


def exact_match(cells: DataFrame, flag: str = "raw", by: list[str] | None = None) -> DataFrame:
    """Share of records, among those with a known cell, whose known cells are all right."""
    by = by or []
    per = cells.where("known = 1 and mode = 'pn'").groupBy(*by, "record_id").agg(F.min((F.col("label") == F.col(flag)).cast("int")).alias("ok"))
    out = per.groupBy(*by).agg(F.count("*").alias("rows"), F.coalesce(F.sum("ok"), F.lit(0)).cast("bigint").alias("hits"))
    return out.withColumn("exact_match", ratio(F.col("hits"), F.col("rows")))


def _sides(cells: DataFrame) -> DataFrame:
    u = (F.col("known") == 0) & (F.col("pu") == 0)
    return cells.where("mode = 'pu' and (pu = 1 or known = 0)").withColumn("side", F.when(F.col("pu") == 1, "p").when(u, "u"))


def concordance(cells: DataFrame) -> DataFrame:
    """Per PU label: the chance that a positive scores above an unlabelled cell, ties counting half; by running counts, not by pairs."""
    pts = _sides(cells).groupBy("label_idx", "tag", "score").agg(count_if(F.col("side") == "p").alias("p"), count_if(F.col("side") == "u").alias("u"))
    t = totals_at_or_above(pts, ["label_idx", "tag"], "score", ["p", "u"])
    below = F.col("all_u") - F.col("ge_u")
    agg = t.groupBy("label_idx", "tag").agg(F.max("all_p").alias("positive_count"), F.max("all_u").alias("unlabeled_count"), F.sum(F.col("p") * (below * 2 + F.col("u"))).alias("twice"))
    return agg.select("label_idx", "tag", "positive_count", "unlabeled_count", ratio(F.col("twice") * 0.5, F.col("positive_count") * F.col("unlabeled_count")).alias("concordance"))


def pu_quantiles(cells: DataFrame, at: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Score quantiles of both sides per PU label, interpolated; NULL for an empty side."""
    pts = _sides(cells).groupBy("label_idx", "tag", "side", "score").agg(F.count("*").alias("n"))
    place = lambda q: (F.col("total") - 1) * F.lit(q)
    ends = {f"{e}{i}": f(place(q)) for i, q in enumerate(at) for e, f in (("lo", F.floor), ("hi", F.ceil))}
    per = values_at(pts, ["label_idx", "tag", "side"], "score", "n", ends)
    cut = lambda i, q: F.col(f"lo{i}") + (place(q) - F.floor(place(q))) * (F.col(f"hi{i}") - F.col(f"lo{i}"))
    cuts = per.select("label_idx", "tag", "side", *[cut(i, q).alias(f"q{i}") for i, q in enumerate(at)])
    one = lambda x, i: F.max(F.when(F.col("side") == x, F.col(f"q{i}")))
    return cuts.groupBy("label_idx", "tag").agg(*[one(x, i).alias(f"{n}_p{round(q * 100)}") for x, n in (("p", "positive"), ("u", "unlabeled")) for i, q in enumerate(at)])


def pu_by_label(viewed: DataFrame, flag: str = "final") -> DataFrame:
    """Selected counts, recall and coverages of a view, per PU label."""
    on = F.col(flag) == 1
    p, u = F.col("side") == "p", F.col("side") == "u"
    per = _sides(viewed).groupBy("label_idx", "tag").agg(count_if(p).alias("positive_count"), count_if(u).alias("unlabeled_count"), count_if(p & on).alias("selected_positive"), count_if(u & on).alias("selected_unlabeled"))
    return per.withColumns(_pu_rates())


def _pu_rates() -> dict[str, Column]:
    sp, su, p, u = (F.col(c) for c in ("selected_positive", "selected_unlabeled", "positive_count", "unlabeled_count"))
    return {"positive_recall": ratio(sp, p), "unlabeled_coverage": ratio(su, u), "all_coverage": ratio(sp + su, p + u)}


def pu_summary(viewed: DataFrame, flag: str = "final") -> DataFrame:
    """One row: support-weighted recall, mean concordance over labels with both sides, micro coverages."""
    per = pu_by_label(viewed, flag).join(concordance(viewed).select("label_idx", "concordance"), "label_idx")
    both = (F.col("positive_count") > 0) & (F.col("unlabeled_count") > 0)
    out = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("positive_count", "unlabeled_count", "selected_positive", "selected_unlabeled")], F.coalesce(F.avg(F.when(both, F.col("concordance"))), F.lit(0.0)).alias("macro_concordance"))
    return out.withColumns(_pu_rates())


def positive_recall(viewed: DataFrame, flag: str = "final") -> DataFrame:
    """Per label with positives, PN and PU: support, selected and recall; callers filter the records first."""
    pos = viewed.where("mode <> 'unsupported' and ((mode = 'pn' and known = 1 and label = 1) or (mode = 'pu' and pu = 1))")
    return pos.groupBy("label_idx", "tag", "mode").agg(F.count("*").alias("positive_support"), F.sum(flag).cast("bigint").alias("selected_positive")).withColumn("recall", ratio(F.col("selected_positive"), F.col("positive_support")))


def positive_recall_total(viewed: DataFrame, flag: str = "final") -> DataFrame:
    per = positive_recall(viewed, flag)
    out = per.agg(F.count("*").alias("labels"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("macro_recall"), F.coalesce(F.sum("positive_support"), F.lit(0)).cast("bigint").alias("positive_support"), F.coalesce(F.sum("selected_positive"), F.lit(0)).cast("bigint").alias("selected_positive"))
    return out.withColumn("micro_recall", ratio(F.col("selected_positive"), F.col("positive_support")))


def supervision(cells: DataFrame, split: str = "split", component: str = "record_id") -> DataFrame:
    """Per label and split, with totals over splits (NULL): known positives and negatives, PU positives, unknown cells, and distinct groups with a positive."""
    return cells.rollup("tag", split).agg(
        count_if((F.col("known") == 1) & (F.col("label") == 1)).alias("known_positive"),
        count_if((F.col("known") == 1) & (F.col("label") == 0)).alias("known_negative"),
        count_if(F.col("pu") == 1).alias("pu_positive"),
        count_if((F.col("known") == 0) & (F.col("pu") == 0)).alias("unknown"),
        F.count_distinct(F.when(F.col("label") == 1, F.col(component))).alias("positive_groups"),
    ).where("tag is not null")


def class_weights(cells: DataFrame, cap: float = 20.0) -> DataFrame:
    """PN labels: negatives over positives, held between 1 and ``cap``."""
    per = cells.where("mode = 'pn'").groupBy("label_idx", "tag").agg(count_if((F.col("known") == 1) & (F.col("label") == 1)).alias("positives"), count_if((F.col("known") == 1) & (F.col("label") == 0)).alias("negatives"))
    raw = F.col("negatives") / F.greatest(F.col("positives"), F.lit(1)).cast("double")
    return per.withColumn("raw_weight", raw).withColumn("weight", F.least(F.greatest(raw, F.lit(1.0)), F.lit(float(cap))))


def masked_bce(cells: DataFrame, logit: Column, weight: Column | None = None) -> DataFrame:
    """One row: mean over records of the mean loss of their known cells; 0 without any."""
    w = F.lit(1.0) if weight is None else weight
    softplus = lambda z: F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0))
    loss = F.when(F.col("label") == 1, w * softplus(-logit)).otherwise(softplus(logit))
    per = cells.where("known = 1").groupBy("record_id").agg(F.avg(loss).alias("loss"))
    return per.agg(F.count("*").alias("active_records"), F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"))


def pairwise_hinge(cells: DataFrame, margin: float = 1.0) -> DataFrame:
    """Per PU label the mean of max(0, margin - p + u) over all pairs of a positive and an unlabelled score.

    Needs no pairs: for a positive p the unlabelled with u > p - margin count
    (margin - p) + u each, which running counts and sums give.
    """
    s = _sides(cells)
    p = s.where("side = 'p'").select("label_idx", "tag", (F.col("score") - margin).alias("x"), F.lit(1).alias("np"), F.lit(0).alias("nu"), F.lit(0.0).alias("su"))
    u = s.where("side = 'u'").select("label_idx", "tag", F.col("score").alias("x"), F.lit(0).alias("np"), F.lit(1).alias("nu"), F.col("score").alias("su"))
    pts = p.unionByName(u).groupBy("label_idx", "tag", "x").agg(F.sum("np").alias("np"), F.sum("nu").alias("nu"), F.sum("su").alias("su"))
    t = totals_at_or_above(pts, ["label_idx", "tag"], "x", ["np", "nu", "su"], unit_bucket(F.col("x"), 1024, min(0.0, -margin), 1.0))
    # an unlabelled score equal to p - margin adds nothing, so counting it does no harm
    total = F.sum(F.col("np") * (F.col("ge_su") - F.col("x") * F.col("ge_nu")))
    per = t.groupBy("label_idx", "tag").agg(total.alias("total"), F.max("all_np").alias("n_p"), F.max("all_nu").alias("n_u"))
    return per.where("n_p > 0 and n_u > 0").select("label_idx", "tag", F.col("n_p").alias("positives"), F.col("n_u").alias("unlabeled"), (F.col("total") / (F.col("n_p") * F.col("n_u"))).alias("loss"))


def pair_sides(cells: DataFrame, uniform: Column) -> DataFrame:
    """Adds ``side`` to PU cells of a batch: 'p' for a stated positive of either stream, 'u' for an unlabelled cell of the uniform stream; other cells are left out."""
    c = cells.where("mode = 'pu'")
    free = (F.col("known") == 0) & (F.col("pu") == 0)
    return c.withColumn("side", F.when(F.col("pu") == 1, "p").when(uniform & free, "u")).where("side is not null")
