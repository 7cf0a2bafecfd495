"""From evidence to a split data set, and from predictions to a verdict: the composed plans."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators import audit, calibrate, contracts, identity, payload, predict, quality, resolve, splits
from tagloom.session import Scratch


class Built(NamedTuple):
    #: (key, record): which record a row of evidence belongs to.
    members: DataFrame
    #: (record, component, split).
    records: DataFrame
    #: (record, label_idx, label, known, pu).
    states: DataFrame
    notes: DataFrame
    #: Values and components that stand in more than one split; empty if all is well.
    leaks: DataFrame


def build_records(rows: DataFrame, lists: Mapping[int, str], dim: DataFrame, rules: DataFrame | None, shares: Mapping[str, float], seed: int = 0, near_bits: int = 2, scratch: Scratch | None = None) -> Built:
    """Evidence rows (key, sha, ph BIGINT, and label lists) to records with a state per label and a split.

    Rows that share a digest or a fingerprint, directly or through others, are
    one record; its claims are united, conflicts resolved, implications drawn.
    Records that are the same or near are one component, and components are
    split as wholes, each label in the shares.
    """
    scratch = scratch or Scratch(rows.sparkSession, "build")
    rows = scratch.keep(rows.where("key is not null").distinct(), "rows")
    values = {"sha": F.col("sha"), "ph": F.col("ph")}
    members = scratch.keep(identity.exact_groups(rows.select("key", "sha", "ph"), "key", values, scratch).withColumnRenamed("group_key", "record"), "members")
    claimed = scratch.keep(resolve.claims(rows.join(members, "key"), "record", dict(lists)), "claims")
    states, notes = resolve.resolve(claimed, "record", dim, rules)
    states = scratch.keep(states, "states")
    # records that share no value may still be near: their least members are linked
    owner = rows.where("ph is not null").join(members, "key").groupBy("ph").agg(F.min("record").alias("record"))
    near = identity.near_pairs(rows, "ph", near_bits)
    links = near.join(owner.select(F.col("ph").alias("h_a"), F.col("record").alias("a")), "h_a").join(owner.select(F.col("ph").alias("h_b"), F.col("record").alias("b")), "h_b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    comp = identity.components(links, scratch)
    every = members.select("record").distinct()
    placed = scratch.keep(every.join(comp.withColumnRenamed("v", "record"), "record", "left").select("record", F.coalesce("component", "record").alias("component")), "components")
    positive = states.where("label = 1").groupBy("record").agg(F.collect_list("label_idx").alias("labels"))  # at most the labels
    plan = splits.split_components(placed.join(positive, "record", "left"), "component", "labels", shares, seed)
    records = scratch.keep(placed.join(plan, "component"), "records")
    told = rows.join(members, "key").join(records, "record")
    leaks = identity.leakage(told, "split", {"sha": F.col("sha"), "ph": F.col("ph"), "component": F.col("component")})
    return Built(members, records, states, notes, leaks)


def build_summary(rows: DataFrame, built: Built) -> DataFrame:
    """(name, n): rows, records, merged rows, supervision, conflicts by kind, leaks."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    counted = _supervision()
    s = built.states.agg(*[F.count_if(c).alias(n) for n, c in counted.items()])
    per = s.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in counted])).alias("x")).select("x.*")
    merged = built.members.agg((F.count("*") - F.count_distinct("record")).alias("n")).select(F.lit("merged").alias("name"), "n")
    kinds = built.notes.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    out = one(rows.where("key is not null").select("key").distinct(), "keys")
    for p in (one(built.records, "records"), merged, per, kinds, one(built.leaks, "leaks")):
        out = out.unionByName(p)
    return out


def _supervision() -> dict[str, Column]:
    known, label = F.col("known") == 1, F.col("label") == 1
    return {"known_positive": known & label, "known_negative": known & ~label, "pu_positive": F.col("pu") == 1}


def payload_errors(viewed: DataFrame, categories: list[str], dim: DataFrame) -> DataFrame:
    """(record_id, tag, rule): all rules on the selected, confidence and all-scores outputs of a view."""
    sel = payload.unpack_selected(payload.render(viewed, "selected", categories), categories)
    con = payload.unpack_selected(payload.render(viewed, "confidence", categories), categories, confidence=True)
    scores = payload.unpack_scores(payload.render(viewed, "all_scores", categories))
    a = predict.payload_errors(sel, dim, categories).select("record_id", "tag", "rule")
    b = payload.confidence_errors(con, sel, viewed)
    n = dim.count()
    return a.unionByName(b).unionByName(payload.scores_errors(scores, viewed, n))


def status(errors: DataFrame, part: str, else_: str = "fail") -> DataFrame:
    """(part, status, n): success without errors."""
    return errors.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), F.when(F.col("n") == 0, "success").otherwise(else_).alias("status"), "n")


def audit_delivery(cells: DataFrame, dim: DataFrame, categories: list[str], limits: Mapping[str, float], partial: tuple[str, float], reproduced: DataFrame, leaks: DataFrame) -> DataFrame:
    """(part, status, n) of a delivery, with the row ``verdict``, the worst of its parts.

    Thresholds come from the validation split and must keep their contract; the
    test split is viewed with them, its outputs keep theirs; metrics are computed
    on two paths; scores must be ``reproduced`` (record_id, label_idx, score),
    drift within 1e-6 being partial; quality is held against ``limits``; ``leaks``
    must be empty.  ``n`` counts errors, for the verdict the parts that fall short.
    """
    scratch = Scratch(cells.sparkSession, "delivery")
    t = scratch.keep(calibrate.all_thresholds(cells.where("split = 'val'")).select("label_idx", "mode", "threshold", "status"), "thresholds")
    bad_t = contracts.threshold_errors(t, dim.select("idx", "mode"))
    v = scratch.keep(predict.views(cells.where("split = 'test'"), t), "viewed")  # read by every part
    one = audit.tidy(quality.confusion(v, ["tag"], "final"), ["tag"])
    known = v.where("known = 1 and mode = 'pn'")
    other = known.groupBy("tag").agg(F.sum(F.col("final") * F.col("label")).alias("tp"), F.sum(F.col("final") * (1 - F.col("label"))).alias("fp"), F.sum((1 - F.col("final")) * F.col("label")).alias("fn"), F.sum((1 - F.col("final")) * (1 - F.col("label"))).alias("tn"))
    cross = audit.crosscheck(one, audit.tidy(other, ["tag"]), ["tag"])
    j = v.select("record_id", "label_idx", "score").join(reproduced.withColumnRenamed("score", "again"), ["record_id", "label_idx"], "left")
    off = F.abs(F.col("score") - F.col("again"))
    drift = j.agg(F.count_if(F.coalesce(off != 0, F.lit(True))).alias("n"), F.max(F.coalesce(off, F.lit(1.0))).alias("far")).select(F.lit("reproduction").alias("part"), F.when(F.col("n") == 0, "success").when(F.col("far") <= 1e-6, "partial").otherwise("fail").alias("status"), "n")
    m = quality.micro_macro(v, "final").select(F.col("f1").alias("micro_f1"), F.col("macro_f1_both_classes").alias("macro_f1"), "specificity")
    g = audit.gates(m, dict(limits), partial)
    missed = sum((F.when(F.col(f"gate_{n}"), 0).otherwise(1) for n in limits), F.lit(0))
    gate = g.select(F.lit("quality").alias("part"), F.col("verdict").alias("status"), missed.cast("bigint").alias("n"))
    parts = status(bad_t, "thresholds")
    for p in (status(payload_errors(v, categories, dim), "payloads"), status(cross, "metrics"), drift, gate, status(leaks, "leakage")):
        parts = parts.unionByName(p)
    short = parts.agg(F.count_if(F.col("status") != "success").alias("n"))
    worst = audit.worst(parts, "status").join(short, F.lit(True)).select(F.lit("verdict").alias("part"), F.col("verdict").alias("status"), "n")  # one row each
    return parts.unionByName(worst)
