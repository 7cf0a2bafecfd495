"""Output modes behind one door, and the checks of one mode against another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.render import two_decimals
from tagloom.operators import predict
from tagloom.operators.contracts import all_scores_text

MODES = ("all_scores", "verification", "selected", "confidence")
TWO_DECIMALS = r"^(0\.[0-9]{2}|1\.00)$"


def render(viewed: DataFrame, mode: str, categories: Sequence[str]) -> DataFrame:
    """(record_id, output): a record's scores as JSON text in one of ``MODES``; ``verification`` has them unrounded, in label order."""
    if mode == "all_scores":
        return predict.render_scores(viewed)
    if mode == "verification":
        scores = F.array_sort(F.collect_list(F.struct("label_idx", "score")))
        return viewed.groupBy("record_id").agg(scores.alias("p")).select("record_id", F.to_json(F.struct(F.col("p.score").alias("scores"))).alias("output"))
    if mode in ("selected", "confidence"):
        return predict.render_selected(viewed, list(categories), mode == "confidence")
    raise ValueError(f"unknown mode {mode!r}")


def unpack_selected(payload: DataFrame, categories: Sequence[str], confidence: bool = False) -> DataFrame:
    """JSON text of a selected payload -> (record_id, category, category_pos, pos, tag[, confidence]), positions from 0; text that holds no such payload gives nothing."""
    item = "array<struct<name:string,confidence:string>>" if confidence else "array<string>"
    m = F.from_json("output", f"map<string,{item}>")
    long = payload.select("record_id", F.posexplode(m).alias("category_pos", "category", "v")).select("record_id", "category", "category_pos", F.posexplode("v").alias("pos", "x"))
    tag: list[Column] = [F.col("x.name").alias("tag"), F.col("x.confidence").alias("confidence")] if confidence else [F.col("x").alias("tag")]
    return long.select("record_id", "category", "category_pos", "pos", *tag)


def unpack_scores(payload: DataFrame) -> DataFrame:
    """JSON text of an all-scores payload -> (record_id, pos, tag, text)."""
    return payload.select("record_id", F.posexplode(F.from_json("output", "map<string,string>")).alias("pos", "tag", "text"))


def round_trips(payload: DataFrame, kind: str) -> DataFrame:
    """(record_id, same): does the text come out of parsing and writing as it went in?"""
    return payload.select("record_id", F.coalesce(F.to_json(F.from_json("output", kind)) == F.col("output"), F.lit(False)).alias("same"))


def scores_errors(scores: DataFrame, cells: DataFrame, labels: int) -> DataFrame:
    """Rule breaks of an all-scores payload in long form (record_id, pos, tag, text): (record_id, tag, rule).

    Every label once and in order, texts of two decimals, equal to the rendered
    score.
    """
    want = cells.select("record_id", F.col("label_idx").alias("want_pos"), "tag", two_decimals(F.col("score"), F.col("mode")).alias("want"))
    j = want.join(scores, ["record_id", "tag"], "full")
    rules = {
        "missing_label": F.col("pos").isNull(),
        "unknown_label": F.col("want_pos").isNull(),
        "out_of_order": F.col("pos") != F.col("want_pos"),
        "not_two_decimals": ~all_scores_text(F.array("text")),
        "not_the_score": F.col("text") != F.col("want"),
    }
    return _broken(j, rules)


def confidence_errors(items: DataFrame, selected: DataFrame, cells: DataFrame) -> DataFrame:
    """Rule breaks of a confidence payload against the selected one and the scores: (record_id, tag, rule)."""
    want = cells.select("record_id", "tag", two_decimals(F.col("score")).alias("want"))
    ours = items.select("record_id", "tag", F.col("category").alias("c"), F.col("pos").alias("p"), F.coalesce("confidence", F.lit("")).alias("confidence"))
    theirs = selected.select("record_id", "tag", F.col("category").alias("sc"), F.col("pos").alias("sp"))
    j = ours.join(theirs, ["record_id", "tag"], "full").join(want, ["record_id", "tag"], "left")
    rules = {
        "only_with_confidence": F.col("sc").isNull(),
        "only_selected": F.col("c").isNull(),
        "elsewhere": (F.col("c") != F.col("sc")) | (F.col("p") != F.col("sp")),
        "not_two_decimals": ~F.col("confidence").rlike(TWO_DECIMALS),
        "not_the_score": F.col("confidence") != F.col("want"),
    }
    return _broken(j, rules)


def _broken(j: DataFrame, rules: dict[str, Column]) -> DataFrame:
    hit = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return j.select("record_id", "tag", F.explode(hit).alias("rule"))


def mode_consistency(selected: DataFrame, confidence: DataFrame, scores: DataFrame) -> DataFrame:
    """Records on which three modes do not agree: (record_id, problem).

    A record must be in all three; the confidence payload must name the selected
    labels, each with the text that the all-scores payload gives it.  Inputs are
    in long form; for a record without selected labels pass a row with a NULL tag.
    """
    names = lambda df: df.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("category", "pos", "tag"))).alias("n"))
    s, c = names(selected), names(confidence).withColumnRenamed("n", "cn")
    here = scores.groupBy("record_id").agg(F.lit(True).alias("scored"))
    j = s.join(c, "record_id", "full").join(here, "record_id", "full")
    missing = j.where(F.col("n").isNull() | F.col("cn").isNull() | F.col("scored").isNull()).select("record_id", F.lit("missing_in_a_mode").alias("problem"))
    other = j.where(~(F.col("n") == F.col("cn"))).select("record_id", F.lit("other_labels").alias("problem"))
    text = confidence.where("tag is not null").join(scores.select("record_id", "tag", "text"), ["record_id", "tag"], "left")
    off = text.where(~F.col("confidence").eqNullSafe(F.col("text"))).select("record_id", F.lit("other_score").alias("problem")).distinct()
    return missing.unionByName(other).unionByName(off)
