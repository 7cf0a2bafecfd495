"""Raw and final views of scores, and what the final view costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tagloom.functions.metrics import ratio
from tagloom.functions.render import two_decimals
from tagloom.operators.ranked import count_if
from tagloom.session import dimension

FALLBACK = 0.5


def raw_flag(threshold: Column | None = None) -> Column:
    """1 if the score reaches the threshold; unsupported labels are never selected."""
    t = F.lit(FALLBACK) if threshold is None else threshold
    return F.when(F.col("mode") == "unsupported", 0).otherwise((F.col("score") >= t).cast("int"))


def views(cells: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Adds ``raw`` and ``final``.  In the final view at most one label per record and subcategory stays: the highest score, of equals the lowest index."""
    if thresholds is not None:
        cells = cells.join(thresholds.select("label_idx", "threshold"), "label_idx", "left")  # few rows; AQE sees how many
        raw = cells.withColumn("raw", raw_flag(F.coalesce("threshold", F.lit(FALLBACK)))).drop("threshold")
    else:
        raw = cells.withColumn("raw", raw_flag())
    w = Window.partitionBy("record_id", "subcategory").orderBy(F.col("raw").desc(), F.col("score").desc(), "label_idx")
    return raw.withColumn("final", F.when((F.col("raw") == 1) & (F.row_number().over(w) == 1), 1).otherwise(0))


def winners(viewed: DataFrame) -> DataFrame:
    return viewed.where("final = 1").select("record_id", "subcategory", "label_idx", "tag", "score")


def format_loss(viewed: DataFrame) -> DataFrame:
    """Per subcategory: records with several raw labels, labels suppressed, records with several observed positives, hits and the recall that one label per subcategory can reach."""
    pos = ((F.col("known") == 1) & (F.col("label") == 1)) | (F.col("pu") == 1)
    c = viewed.where("mode <> 'unsupported'")
    per = c.groupBy("record_id", "subcategory").agg(
        F.sum("raw").alias("raw_n"), count_if((F.col("raw") == 1) & (F.col("final") == 0)).alias("cut"),
        count_if(pos).alias("obs"), count_if(pos & (F.col("final") == 1)).alias("hit"),
    )
    out = per.groupBy("subcategory").agg(
        count_if(F.col("raw_n") > 1).alias("raw_multi_records"),
        F.sum("cut").alias("suppressed"),
        count_if(F.col("obs") > 1).alias("observed_multi_records"),
        F.sum("obs").alias("observed_positive"),
        count_if(F.col("obs") > 0).alias("observed_records"),
        count_if((F.col("obs") > 0) & (F.col("hit") > 0)).alias("hit_records"),
        F.sum(F.greatest(F.col("obs") - 1, F.lit(0))).alias("forced_false_negatives"),
    )
    return out.withColumns({"hit_rate": ratio(F.col("hit_records"), F.col("observed_records")), "recall_ceiling": ratio(F.col("observed_records"), F.col("observed_positive"))})


def suppressed_by_tag(viewed: DataFrame) -> DataFrame:
    return viewed.where("mode <> 'unsupported'").groupBy("label_idx", "tag").agg(count_if((F.col("raw") == 1) & (F.col("final") == 0)).alias("suppressed"))


def render_scores(cells: DataFrame) -> DataFrame:
    """(record_id, output): all labels in order with two-decimal scores, as JSON text."""
    pairs = F.array_sort(F.collect_list(F.struct("label_idx", "tag", two_decimals(F.col("score"), F.col("mode")).alias("s"))))
    return cells.groupBy("record_id").agg(pairs.alias("p")).select("record_id", F.to_json(F.map_from_arrays("p.tag", "p.s")).alias("output"))


def render_selected(viewed: DataFrame, categories: list[str], confidence: bool = False) -> DataFrame:
    """(record_id, output): per category, in the given order, the selected labels in label order, as JSON text.

    Categories without a label stay with an empty list.  With ``confidence``
    each label comes with its two-decimal score.
    """
    item = F.struct("label_idx", "category", F.col("tag").alias("name"), two_decimals(F.col("score")).alias("confidence"))
    per = viewed.groupBy("record_id").agg(F.array_sort(F.collect_list(F.when(F.col("final") == 1, item))).alias("p"))

    def part(c: str) -> Column:
        mine = F.filter("p", lambda x: x["category"] == c)
        return F.transform(mine, lambda x: F.struct(x["name"].alias("name"), x["confidence"].alias("confidence"))) if confidence else F.transform(mine, lambda x: x["name"])

    return per.select("record_id", F.to_json(F.map_from_arrays(F.array(*map(F.lit, categories)), F.array(*map(part, categories)))).alias("output"))


def payload_errors(payload: DataFrame, dim: DataFrame, categories: list[str]) -> DataFrame:
    """Rule breaks of a selected-only payload (record_id, category position, category, tag position, tag) in long form.

    Checked: known category, its place, known tag, tag in its category, label
    order, no tag twice, at most one per subcategory, no unsupported label.
    """
    order = F.array(*map(F.lit, categories))
    j = payload.join(dimension(dim.select(F.col("tag"), F.col("idx"), F.col("category").alias("own"), "subcategory", "mode")), "tag", "left")
    w = Window.partitionBy("record_id", "category").orderBy("pos")
    same = Window.partitionBy("record_id", "tag")
    sub = Window.partitionBy("record_id", "subcategory")
    place = F.array_position(order, F.col("category")) - 1
    rules = {
        "unknown_category": place < 0,
        "category_out_of_place": (place >= 0) & (place != F.col("category_pos")),
        "unknown_tag": F.col("idx").isNull(),
        "wrong_category": F.col("idx").isNotNull() & (F.col("own") != F.col("category")),
        "unsupported": F.col("mode") == "unsupported",
        "out_of_order": F.lag("idx").over(w) > F.col("idx"),
        "tag_twice": F.count("*").over(same) > 1,
        "several_in_subcategory": F.col("idx").isNotNull() & (F.count("*").over(sub) > 1),
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return j.withColumn("rules", broken).select("record_id", "category", "tag", F.explode("rules").alias("rule"))
