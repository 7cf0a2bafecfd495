"""The pN_ queries over the tables of a data directory, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import normalize as N
from tagloom.llm import abuse, consensus, cooccur, crosssplit, fusion, groupsplit, matchgroups, mixture, quota, tokenizer
from tagloom.llm.oracles import SQL
from tagloom.session import Scratch, dimension, table


def _lookup(spark: SparkSession, d: str) -> dict[str, int]:
    return N.tag_lookup(table(spark, d, "label_dim"), table(spark, d, "tag_alias"))


# 1 -------------------------------------------------------------------------------------------------------------------


def _baskets(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    lookup = _lookup(spark, d)
    record = table(spark, d, "evidence").where("key is not null").select(F.lit(0).alias("kind"), F.xxhash64("key").alias("basket"), F.explode(N.label_indices(F.col("pn_positive"), lookup)).alias("item"))
    known = dimension(table(spark, d, "label_dim").select(F.col("idx").alias("item")).distinct())
    batch = table(spark, d, "sample_reference").select(F.lit(1).alias("kind"), F.col("global_batch").cast("bigint").alias("basket"), F.col("balanced_label_index").alias("item")).join(known, "item", "left_semi")
    return record.unionByName(batch), len(set(lookup.values()))


def _kind() -> Column:
    return F.when(F.col("kind") == 0, "record").otherwise("batch").alias("basket_kind")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    items, n = _baskets(spark, d)
    # the counts are read four times: pairs, both items, baskets
    return cooccur.association(Scratch(spark, "p1").keep(cooccur.pair_counts(items, vocabulary=n), "counts"))


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    t = _pairs(spark, d)
    return t.select(_kind(), "label_a", "label_b", "n_ab", "n_a", "n_b", "n_baskets", F.round("lift", 9).alias("lift"), F.round("odds_ratio", 9).alias("odds_ratio"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    # three times chance is far above an odds ratio of one; the exact count follows
    t = cooccur.beyond_chance(_pairs(spark, d).where("odds_ratio > 1"))
    return t.select(_kind(), "label_a", "label_b")


# 2 -------------------------------------------------------------------------------------------------------------------


def _draw(spark: SparkSession, d: str) -> quota.Drawn:
    stream = lambda: F.lower(N.strip(F.col("stream")))
    t = table(spark, d, "sample_target")
    dim = table(spark, d, "label_dim").select(F.col("idx").alias("balanced_label_index"), "category", "subcategory")
    targets = t.withColumn("stream", stream()).join(dimension(dim), "balanced_label_index", "left")
    # one number that is no index stands for a null index on both sides
    index = lambda c: F.coalesce(c, F.lit(-(2**31))).alias("i")
    cats = dimension(t.select(stream().alias("s"), index(F.col("balanced_label_index")), "category_id").where("s is not null"))
    slots = table(spark, d, "sample_reference").where("global_batch is not null and slot is not null")
    slots = slots.select((F.col("global_batch").cast("bigint") * (1 << 32) + F.col("slot")).alias("at"), stream().alias("s"), index(F.col("balanced_label_index")))
    rows = slots.join(cats, ["s", "i"], "left").groupBy("at").agg(F.min("category_id").alias("category_id"))
    return quota.draw_to_targets(rows, "category_id", ["at"], targets, ["stream", "category", "subcategory"], one_in=10)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Categories that the allocation drains and the drawn sample does not go beyond, if by the exact counts they fall short."""
    x = _draw(spark, d)
    drawn = x.sample.groupBy("category_id").agg(F.count("*").alias("drawn"))  # at most a row per target
    t = x.report.join(drawn, "category_id", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    as_planned = F.when(F.col("drawn") == F.col("quota"), F.lit(True)).otherwise(F.raise_error(F.lit("the sample is not the one allotted")).cast("boolean"))
    return t.where(as_planned & F.col("drained") & (F.col("below_share") | F.col("below_min"))).select("category_id")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _draw(spark, d).report


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row about the sample: its rows, the rows asked for, slots drawn twice, categories drawn beyond their rows or quota, small ones below what they could have, and their supply by category."""
    x = _draw(spark, d)
    s = p2_sample(spark, d)
    per = s.groupBy("category_id").agg(F.count("*").alias("drawn"), F.count_distinct("global_batch", "slot").alias("slots"))
    t = x.report.join(per, "category_id", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    over = (F.col("drawn") > F.col("rows")) | (F.col("drawn") != F.col("quota"))
    small = F.col("drawn") < F.least("min_rows", "rows")
    return t.agg(F.sum("drawn").alias("sample_rows"), F.sum("rows").alias("supply"), F.sum(F.col("drawn") - F.coalesce("slots", F.lit(0))).alias("twice"), F.count_if(over).alias("over"), F.count_if(small).alias("small"), F.count_if("below_share").alias("below_share"), F.count_if("below_min").alias("below_min"))


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    s = _draw(spark, d).sample
    return s.select("category_id", F.shiftright("at", 32).cast("int").alias("global_batch"), F.col("at").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("slot"))


# 3 -------------------------------------------------------------------------------------------------------------------


def _consensus(spark: SparkSession, d: str) -> consensus.Consensus:
    lookup = _lookup(spark, d)
    dim = table(spark, d, "label_dim").select("idx", "mode").where("idx is not null").limit(consensus.MAX_LABELS + 1).collect()
    if len(dim) > consensus.MAX_LABELS:
        raise ValueError(f"more than {consensus.MAX_LABELS} labels")
    modes = {r.idx: int(r.mode != "pn") for r in dim}
    lists = {c: (N.label_indices(F.col(c), lookup), s) for c, s in (("pn_positive", 1), ("pn_negative", 2), ("pu_positive", 1))}
    # what the item's key tells: its source, and whether its record was identified
    parts = F.split("item_key", ":")
    features = [F.get(parts, F.lit(0)), (F.length(F.get(parts, F.lit(1))) > 0)]
    return consensus.consensus(table(spark, d, "annotation"), "item_key", "annotator_id", lists, modes, features)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).labels.where("named and probability > 0.5").select(F.col("item").alias("item_key"), "label_idx")


def p3_agreement(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).items


def p3_annotators(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).annotators


# 4 -------------------------------------------------------------------------------------------------------------------


def _images(spark: SparkSession, d: str):
    e = table(spark, d, "evidence")
    fused = {"record_id": N.record_name(F.col("record_id")), "image_path": N.image_path(F.col("image_path")), "phash64": N.phash_hex(F.col("phash64"))}
    rows = e.select("key", "source", "record_id", "image_path", "phash64", "captured_at", N.sha256_hex(F.col("sha256")).alias("digest"))
    present = fused | {"source": N.blank_to_null(F.col("source"))}
    best, model = fusion.best_records(rows, "digest", "key", "source", table(spark, d, "evidence_source"), "captured_at", fused, present)
    return rows, fused, best, model


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    _, _, best, _ = _images(spark, d)
    return best.where("clear").select(F.col("digest").alias("sha256"), "key")


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    rows, fused, best, _ = _images(spark, d)
    return fusion.fused_values(rows, best, "digest", fused).withColumnRenamed("digest", "sha256")


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The survivors, and for which fields the fused record has a value."""
    r = p4_records(spark, d)
    return r.select("sha256", "key", "several", *[F.col(f"best_{n}").isNotNull().alias(f"has_{n}") for n in ("record_id", "image_path", "phash64")])


def p4_sources(spark: SparkSession, d: str) -> DataFrame:
    _, _, _, m = _images(spark, d)
    return spark.createDataFrame([(s, float(m.accuracy[i]), float(m.copies[i].max())) for i, s in enumerate(m.names)], "source string, accuracy double, copies double")


# 5 -------------------------------------------------------------------------------------------------------------------


def _groups(spark: SparkSession, d: str, scratch: Scratch) -> DataFrame:
    e = table(spark, d, "evidence").where("key is not null").select("key", N.phash_long(F.col("phash64")).alias("h"))
    same = matchgroups.star_links(e, "key", "h")
    m = table(spark, d, "match_pair").where(F.lower(N.strip(F.col("verdict"))) == "match").select("key_a", "key_b").where("key_a is not null and key_b is not null and key_a <> key_b").distinct()
    known = e.select("key")
    told = m.join(known.withColumnRenamed("key", "key_a"), "key_a", "left_semi").join(known.withColumnRenamed("key", "key_b"), "key_b", "left_semi")
    return matchgroups.group_links(same.unionByName(told.select("key_a", "key_b")), scratch=scratch)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d, Scratch(spark, "p5"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every key with its group; a key that nothing ties to another is its own."""
    g = _groups(spark, d, Scratch(spark, "p5"))
    keys = table(spark, d, "evidence").where("key is not null").select("key").distinct()
    return keys.join(g, "key", "left").select("key", F.coalesce("group_key", "key").alias("group_key"))


# 6 -------------------------------------------------------------------------------------------------------------------


def _split() -> Column:
    return F.lower(N.strip(F.col("split")))


def _overlaps(spark: SparkSession, d: str) -> crosssplit.Overlaps:
    e = table(spark, d, "evidence").select("key", "sha256", "image_path", "phash64", F.when(_split() == "train", "train").when(_split().isin("val", "test"), "eval").alias("side"))
    bits = N.hamming64(N.hex_to_long(F.col("eval_value")), N.hex_to_long(F.col("train_value"))) <= 2
    # two flipped bits change at most two hex digits and move none: of four segments two stand, 32 bits together
    near = {"phash64": crosssplit.Near(N.phash_hex(F.col("phash64")), 2, 16, bits, aligned=True, together=2)}
    return crosssplit.Overlaps(e, "key", "side", {"sha256": N.sha256_hex(F.col("sha256")), "image_path": N.image_path(F.col("image_path"))}, near)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).pairs().select(F.least("train_key", "eval_key").alias("key_a"), F.greatest("train_key", "eval_key").alias("key_b")).distinct()


def p6_members(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation keys that also stand in train, with the class of the value that gave them away and its number of links."""
    return _overlaps(spark, d).members()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts of evaluation keys that also stand in train, by split and source, and by what gave them away; without pairs."""
    e = table(spark, d, "evidence").where("key is not null").select(F.col("key").alias("eval_key"), _split().alias("split"), "source").where("split in ('val', 'test')").distinct()
    hit = _overlaps(spark, d).members().groupBy("eval_key").agg(*[F.max((F.col("by") == x).cast("int")).alias(f"by_{x}") for x in ("sha256", "phash64", "image_path")])
    t = e.join(hit, "eval_key", "left")
    return t.groupBy("split", "source").agg(F.count("*").alias("n_keys"), F.count("by_sha256").alias("n_overlapping"), *[F.coalesce(F.sum(f"by_{x}"), F.lit(0)).alias(f"n_{x}") for x in ("sha256", "phash64", "image_path")])


# 7 -------------------------------------------------------------------------------------------------------------------

SHARES = {"train": 80.0, "val": 10.0, "test": 10.0}


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence").select("key", N.record_name(F.col("record_id")).alias("entity"), N.label_indices(F.col("pn_positive"), _lookup(spark, d)).alias("labels"))


def p7_splits(spark: SparkSession, d: str) -> DataFrame:
    return groupsplit.split_groups(_records(spark, d), "key", "entity", "labels", SHARES)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each label's share of each split is, and how far from the one asked for."""
    e = _records(spark, d)
    r = groupsplit.share_report(groupsplit.split_groups(e, "key", "entity", "labels", SHARES), e, "key", "labels", SHARES)
    return r.select("label_idx", "split", "records", F.round("share", 9).alias("share"), F.round("deviation", 9).alias("deviation"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_splits(spark, d).where("group_size > 1 and split is not null").select("key", "entity_key")


# 8 -------------------------------------------------------------------------------------------------------------------


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    back = tokenizer.decode_corpus(tokenizer.encode_corpus(docs))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("given")).join(back, "doc_id").select("doc_id", (F.col("given") == F.col("text")).alias("same"))


# 9 -------------------------------------------------------------------------------------------------------------------


def _mixture(spark: SparkSession, d: str) -> mixture.Mixture:
    docs = tokenizer.encode_corpus(table(spark, d, "documents").where("source is not null"), keep=("doc_id", "source"), counts_only=True)
    # texts are encoded once for the sums, the blocks and the report
    return mixture.mix_sources(Scratch(spark, "p9").keep(docs, "sizes"), table(spark, d, "mix_target"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    # measured on the schedule; the exact sum must say the same
    short = F.col("used_tokens") < F.col("asked_tokens")
    agreed = F.when(short == F.col("short"), short).otherwise(F.raise_error(F.lit("the schedule and the sums differ")).cast("boolean"))
    return _mixture(spark, d).report.where(agreed).select("source")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).report


def p9_schedule(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).schedule


def p9_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).blocks


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture with its documents: a row per slot and piece of a document in it, as far as the slot takes it."""
    m = _mixture(spark, d)
    piece = m.blocks.select("source", "block", "doc_id", F.col("n_tokens").alias("n"), "start", "doc_start")
    taken = F.least("n", F.col("n_tokens") - (F.col("start") - F.col("block") * mixture.BLOCK_TOKENS))
    return m.schedule.join(piece, ["source", "block"]).select("slot", "source", "block", "repeat", "doc_id", "start", "doc_start", taken.alias("n_tokens")).where("n_tokens > 0")


# 10 ------------------------------------------------------------------------------------------------------------------


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_documents(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_documents(table(spark, d, "documents"), keep=("doc_id",)).where("abusive").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(p10_scores(spark, d)).withColumn("rate", F.round("rate", 9))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
