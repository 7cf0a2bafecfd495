"""Deterministic samples: hash order, one of each stratum, representatives with coverage, and the two-stream schedule."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tagloom.operators.ranked import spread_rank
from tagloom.session import Scratch

#: Labels of the balanced stream, a dimension.
MAX_LABELS = 4096


def hash_key(seed: int, key: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def hash_sample(rows: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """The first ``count`` rows by (SHA-256 of seed and key, key), with ``pick`` from 1; Spark's top-k keeps ``count`` rows per task."""
    top = rows.withColumn("_h", hash_key(seed, key)).orderBy("_h", key).limit(count)
    return top.withColumn("pick", F.row_number().over(Window.orderBy("_h", key))).drop("_h")


def stratified_sample(rows: DataFrame, key: str, strata: Sequence[Column], count: int, seed: int) -> DataFrame:
    """For each stratum in turn its first row in hash order that is not yet taken, then rows in hash order up to ``count``.

    Only the first strata + count candidates of each stratum and of the whole
    can matter; those few are chosen from.  The strata may exceed ``count``.
    """
    need = len(strata) + count
    marked = rows.withColumn("_h", hash_key(seed, key)).withColumns({f"_s{i}": F.coalesce(c, F.lit(False)) for i, c in enumerate(strata)})
    flags = [f"_s{i}" for i in range(len(strata))]
    thin = marked.select(key, "_h", *flags)
    pools = [thin.orderBy("_h", key).limit(need), *[thin.where(f).orderBy("_h", key).limit(need) for f in flags]]
    pool = pools[0]
    for p in pools[1:]:
        pool = pool.unionByName(p)
    lines = sorted({tuple(r) for r in pool.collect()}, key=lambda r: (r[1], r[0]))
    taken: list = []
    for i in range(len(strata)):
        hit = next((r for r in lines if r[2 + i] and r[0] not in taken), None)
        if hit is not None:
            taken.append(hit[0])
    for r in lines:
        if len(taken) >= count:
            break
        if r[0] not in taken:
            taken.append(r[0])
    kind = rows.schema[key].dataType.simpleString()
    picks = rows.sparkSession.createDataFrame([(k, i + 1) for i, k in enumerate(taken)], f"`{key}` {kind}, pick int")
    return rows.join(F.broadcast(picks), key)


def representatives(rows: DataFrame, key: str, outcome: str, bucket: str, order: Sequence[str], count: int, seed: int) -> DataFrame:
    """Half of the rows from each outcome (``success`` gets the smaller half): first one per bucket in the given order, then by hash; no outcome fills up for the other."""
    h = rows.withColumn("_h", hash_key(seed, key))
    # the first rows of each (outcome, bucket) by hash are all that can be taken
    w = Window.partitionBy(outcome, bucket).orderBy("_h", key)
    few = h.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= count)
    place = F.array_position(F.array(*map(F.lit, order)), F.col(bucket))
    first = F.when((F.col("_r") == 1) & (place > 0), place).otherwise(len(order) + 1)
    quota = F.when(F.col(outcome) == "success", count // 2).otherwise(count - count // 2)
    rank = F.row_number().over(Window.partitionBy(outcome).orderBy(first, "_h", key))
    return few.withColumn("pick", rank).where(F.col("pick") <= quota).drop("_h", "_r")


class Schedule(NamedTuple):
    rows: DataFrame
    batches: int


def _places(rows: DataFrame, group: list[str], key: str, seed: int) -> DataFrame:
    """0-based place ``at`` of every row in a seeded permutation of its group, and the group's ``size``."""
    ranked = spread_rank(rows, group, [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)], "at", out_total="size")
    return ranked.withColumn("at", F.col("at") - 1)


def two_stream_schedule(records: DataFrame, candidates: DataFrame, world: int, uniform: int, balanced: int, seed: int, scratch: Scratch | None = None) -> Schedule:
    """(global_batch, slot, record_index, stream, balanced_label_index, padding, fallback) for ``world`` ranks.

    ``records`` (record_index), each once; ``candidates`` (label, record_index,
    weight > 0), labels as INT.

    The uniform stream has every record once, by its place in a seeded
    permutation; the last batch is filled up with the permutation's first
    records (padding).  The balanced stream goes round the labels.  A label's
    turns are shared out among its candidates in proportion to their weights, by
    systematic sampling along a permutation of theirs, and shuffled.  A record
    that its batch has already gives way to the next candidate of the label;
    if a label has no candidate left for a batch, its slot takes any record that
    the batch lacks (fallback, without a label).  In a batch each rank has its
    uniform slots, then its balanced ones.

    Everything is done by joins on (batch, record) and on (label, place); a
    round of them settles all slots whose proposal is free.
    """
    spark = records.sparkSession
    scratch = scratch or Scratch(spark, "schedule")
    per_u, per_b = world * uniform, world * balanced
    n = records.count()
    if n < per_u + per_b:
        raise ValueError("the records must fill one batch")
    batches = -(-n // per_u)
    placed = scratch.keep(_places(records.select("record_index"), [], "record_index", seed).select("record_index", "at"), "permutation")
    pads = batches * per_u - n
    uni = placed.select("record_index", F.expr(f"at div {per_u}").alias("batch"), F.pmod("at", F.lit(per_u)).alias("i"), F.lit(False).alias("padding"))
    pad = placed.where(F.col("at") < pads).select("record_index", F.lit(batches - 1).cast("bigint").alias("batch"), (F.col("at") + per_u - pads).alias("i"), F.lit(True).alias("padding"))
    uni = uni.unionByName(pad)

    # turns: every label draws as often as the round of labels comes to it
    labels = [r[0] for r in candidates.where("weight > 0").select("label").distinct().orderBy("label").limit(MAX_LABELS + 1).collect()]
    if len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    slots = batches * per_b
    every = placed.select(F.lit(None).cast("int").alias("label"), "at", "record_index")
    if labels:
        known = candidates.where("weight > 0").select(F.col("label").cast("int").alias("label"), "record_index", F.col("weight").cast("double").alias("weight"))
        known = scratch.keep(_places(known, ["label"], "record_index", seed + 1), "candidates")
        turns = spark.createDataFrame([(j, i, (slots - i + len(labels) - 1) // len(labels)) for i, j in enumerate(labels)], "label int, i int, turns bigint")
        line = spread_rank(known, ["label"], [F.xxhash64(F.lit(seed + 1), F.col("record_index")), F.col("record_index")], "before", weight=F.col("weight"), out_total="whole")
        line = line.join(F.broadcast(turns), "label")  # one row per label
        # the point that opens a candidate's stretch; the turns in it are his, the last stretch ends with the line
        point = lambda x: F.least(F.col("turns"), F.ceil(x / F.col("whole") * F.col("turns") - 0.5)).cast("bigint")
        opens = point(F.col("before"))
        closes = F.when(F.col("at") == F.col("size") - 1, F.col("turns")).otherwise(point(F.col("before") + F.col("weight")))
        drawn = line.withColumn("opens", opens).withColumn("closes", closes).where("closes > opens").select("label", "i", "at", "size", F.explode(F.sequence(F.col("opens"), F.col("closes") - 1)).alias("draw"))
        drawn = spread_rank(drawn, ["label"], [F.xxhash64(F.lit(seed + 2), F.col("label"), F.col("draw")), F.col("draw")], "turn")
        open_ = drawn.select("label", "at", "size", ((F.col("turn") - 1) * len(labels) + F.col("i")).alias("j"), F.lit(0).alias("tries"))
        pool = scratch.keep(known.select("label", "at", "record_index").unionByName(every), "pool")
    else:
        open_ = spark.range(slots).select(F.lit(None).cast("int").alias("label"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("at"), F.lit(n).cast("bigint").alias("size"), F.col("id").alias("j"), F.lit(0).alias("tries"))
        pool = every
    open_ = scratch.keep(open_.withColumn("batch", F.expr(f"j div {per_b}")), "open")
    taken = uni.select("batch", "record_index")
    settled: list[DataFrame] = []
    while not open_.isEmpty():
        proposal = open_.join(pool, open_["label"].eqNullSafe(pool["label"]) & (open_["at"] == pool["at"])).select(open_["*"], "record_index")
        free = proposal.join(taken, ["batch", "record_index"], "left_anti")
        # of several slots of a batch that propose one record the first has it
        won = scratch.keep(free.groupBy("batch", "record_index").agg(F.min(F.struct("j", "label")).alias("w")).select("batch", "record_index", F.col("w.j").alias("j"), F.col("w.label").alias("label")), "settled")
        settled.append(won)
        taken = taken.unionByName(won.select("batch", "record_index"))
        rest = open_.join(won.select("j"), "j", "left_anti")
        spent = F.col("tries") + 1 >= F.col("size")
        nxt = rest.select(
            F.when(~spent, F.col("label")).alias("label"),
            F.when(spent, F.pmod(F.xxhash64(F.lit(seed + 3), "j"), F.lit(n))).otherwise((F.col("at") + 1) % F.col("size")).alias("at"),
            F.when(spent, F.lit(n).cast("bigint")).otherwise(F.col("size")).alias("size"), "j",
            F.when(spent, 0).otherwise(F.col("tries") + 1).alias("tries"), "batch",
        )
        nxt = scratch.keep(nxt, "open")
        scratch.drop(open_)
        open_ = nxt
    bal = settled[0]
    for s in settled[1:]:
        bal = bal.unionByName(s)
    width = uniform + balanced
    slot = lambda i, per, first: (F.expr(f"{i} div {per}") * width + F.pmod(F.col(i), F.lit(per)) + first).cast("int").alias("slot")
    a = uni.select(F.col("batch").cast("int").alias("global_batch"), slot("i", uniform, 0), "record_index", F.lit("uniform").alias("stream"), F.lit(None).cast("int").alias("balanced_label_index"), "padding", F.lit(False).alias("fallback"))
    b = bal.withColumn("i", F.pmod("j", F.lit(per_b))).select(F.col("batch").cast("int").alias("global_batch"), slot("i", balanced, uniform), "record_index", F.lit("balanced").alias("stream"), F.col("label").alias("balanced_label_index"), F.lit(False).alias("padding"), F.col("label").isNull().alias("fallback"))
    return Schedule(a.unionByName(b), batches)


def schedule_digest(rows: DataFrame) -> DataFrame:
    """(slots, digest): a SHA-256 of the sums of two 64-bit hashes of the rows, which hold their places themselves; needs no order."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in ("global_batch", "slot", "record_index", "stream", "balanced_label_index", "padding", "fallback")]
    total = lambda salt: F.coalesce(F.sum(F.xxhash64(F.lit(salt), *cols).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")
    return rows.agg(F.count("*").alias("slots"), F.sha2(F.concat_ws(":", total("a"), total("b"), F.count("*").cast("string")), 256).alias("digest"))


def rank_slots(schedule: DataFrame, rank: int, per_rank: int, start_batch: int = 0) -> DataFrame:
    """One rank's part of a rank-major schedule from a cursor on."""
    return schedule.where((F.floor(F.col("slot") / per_rank) == rank) & (F.col("global_batch") >= start_batch))


def exposures(schedule: DataFrame, by: list[str]) -> DataFrame:
    """Exposure counts of a schedule: slots, distinct records, padding and fallback slots."""
    return schedule.groupBy(*by).agg(F.count("*").alias("exposures"), F.count_distinct("record_index").alias("records"), F.count_if("padding").alias("padding"), F.count_if("fallback").alias("fallback"))
