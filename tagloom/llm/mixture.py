"""Mixing sources to target weights by a low-discrepancy schedule.

The mixture is a row of slots.  Slot i stands for the point frac(i * golden
ratio), in whole numbers of 40 bits, which the cumulative weights map to a source, so every stretch of slots
has the target shares as nearly as whole slots allow.  A source's documents are
shuffled, laid end to end and cut into blocks of ``block_tokens`` tokens; a
document is cut wherever a border falls.  The k-th slot of a source takes its
block k modulo its number of blocks, until the tokens asked of the source are
met or all its blocks have been used ``max_repeats`` times.  The last block of a
source is shorter than the others, so a source counts with the slots it takes to
give the tokens asked of it, and its last slot takes only what is left to take.
What a source cannot give even with all repeats is asked of the others that can
give more, in proportion to their weights.
What was reached is measured on the schedule and the blocks.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tagloom.llm._common import keep_order_hash, spread_rank
from tagloom.llm.quota import fill

#: Rows of the target table; it becomes a literal array.
MAX_SOURCES = 10_000
#: Tokens of a slot.
BLOCK_TOKENS = 4096
#: 2 ** 40 times the golden ratio less one, made odd, so that 2 ** 40 slots have different points.
_BITS, _GOLDEN = 40, 679535556991


def _point(slot: Column) -> Column:
    """``slot * _GOLDEN`` modulo 2 ** 40, without overflow."""
    half = 1 << (_BITS // 2)
    low, high = F.pmod(slot, F.lit(half)), F.pmod(F.floor(slot / half), F.lit(half))
    return F.pmod(low * _GOLDEN + F.pmod(high * _GOLDEN, F.lit(half)) * half, F.lit(1 << _BITS))


class Mixture(NamedTuple):
    schedule: DataFrame
    blocks: DataFrame
    report: DataFrame


def mix_sources(docs: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> Mixture:
    """Mix ``docs`` (doc_id, source, n_tokens) to ``targets`` (source, target_ppm, max_repeats).

    The size of the mixture is the number of tokens of all documents that have
    a source; documents without one, or whose source has no target, are not
    used.  Returns

    * ``schedule`` (slot, source, block, repeat, n_tokens): the slots in order,
      each with the tokens it takes from the beginning of its block,
    * ``blocks`` (source, block, doc_id, n_tokens, start, doc_start): the pieces
      of documents by block; ``start`` is the number of the source's tokens
      before the piece, ``doc_start`` that of the document's,
    * ``report`` per source of the targets: tokens, asked tokens, capacity,
      planned tokens (asked, as far as there are, and what it takes over from
      others), used tokens as scheduled, target_ppm, reached_ppm, repeats, short.

    A part of a token that is asked for counts as a whole one.
    Documents with NULL or no tokens take no room.  Repeated source rows in the
    targets raise.
    """
    spark = docs.sparkSession
    t = targets.select("source", F.coalesce("target_ppm", F.lit(0)).cast("long").alias("ppm"), F.coalesce("max_repeats", F.lit(0)).cast("long").alias("reps")).where("source is not null").limit(MAX_SOURCES + 1).collect()
    if len(t) > MAX_SOURCES or len({r.source for r in t}) != len(t):
        raise ValueError("the targets must have one row per source and at most %d" % MAX_SOURCES)
    t.sort(key=lambda r: r.source)
    sized = docs.where(F.col("source").isNotNull()).select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    names = targets.select("source").where("source is not null")
    # one row for all other sources, however many there are
    known = {r.source: r.tok for r in sized.join(F.broadcast(names.withColumn("known", F.lit(True))), "source", "left").groupBy(F.when(F.col("known"), F.col("source")).alias("source")).agg(F.sum("n_tokens").alias("tok")).collect()}
    total = sum(known.values())
    lines = [(i, r.source, r.ppm, r.reps, known.get(r.source, 0), -(-r.ppm * total // 1_000_000)) for i, r in enumerate(t)]

    def slots(tok: int, want: int) -> int:
        """Slots that give so many tokens; a source without tokens would have full blocks."""
        passes, rest = divmod(want, tok) if tok else (0, want)
        return passes * -(-tok // block_tokens) + -(-rest // block_tokens)

    plan_tokens = [min(want, tok * reps) for _, _, _, reps, tok, want in lines]
    room = [tok * reps - x for (_, _, _, reps, tok, _), x in zip(lines, plan_tokens)]
    plan_tokens = [x + y for x, y in zip(plan_tokens, fill(max(0, total - sum(plan_tokens)), [ppm for _, _, ppm, *_ in lines], room))]
    met = [slots(tok, x) for (*_, tok, _), x in zip(lines, plan_tokens)]
    n = sum(met)
    edges = [(x << _BITS) // n for x in itertools.accumulate(met)] if n else []
    start = spread_rank(sized.join(F.broadcast(names), "source", "left_semi").where("n_tokens > 0"), ["source"], [keep_order_hash(seed, "doc_id"), F.col("doc_id")], "at", weight=F.col("n_tokens"))
    pieces = start.withColumn("block", F.explode(F.sequence(F.expr(f"at div {block_tokens}"), F.expr(f"(at + n_tokens - 1) div {block_tokens}"))))
    begin = F.greatest("at", F.col("block") * block_tokens)
    end = F.least(F.col("at") + F.col("n_tokens"), (F.col("block") + 1) * block_tokens)
    blocks = pieces.select("source", "block", "doc_id", (end - begin).alias("n_tokens"), begin.alias("start"), (begin - F.col("at")).alias("doc_start"))
    if not n:
        schedule = spark.createDataFrame([], "slot bigint, source string, block bigint, repeat bigint, n_tokens bigint")
    else:
        # points of the golden ratio come back to an interval of width w within 1.9 / w steps, so 3 n of them give each source its slots
        points = spark.range(3 * n + 10).select(F.col("id").alias("slot"), _point(F.col("id")).alias("u"))
        at = F.aggregate(F.array(*map(F.lit, edges)), F.lit(0), lambda k, e: k + F.when(e <= F.col("u"), 1).otherwise(0))
        meta = spark.createDataFrame([(i, source, -(-tok // block_tokens), x, tok, m) for (i, source, _, _, tok, _), x, m in zip(lines, plan_tokens, met)], "i int, source string, n_blocks bigint, want bigint, tok bigint, met bigint")
        named = points.withColumn("i", at).join(F.broadcast(meta), "i").where("met > 0")
        # slots come in ranges, so the slot number itself spreads over the buckets
        spread = (F.col("slot").cast("double") / F.lit(float(3 * n + 10)) * F.lit(float(1 << 62))).cast("bigint") * 2
        ranked = spread_rank(named, ["source"], [spread, F.col("slot")], "k").where("k <= met")
        ranked = ranked.select("slot", "source", F.expr("(k - 1) % n_blocks").alias("block"), F.expr("(k - 1) div n_blocks").alias("repeat"), "want", "tok")
        sizes = blocks.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"))
        left = F.col("want") - F.col("repeat") * F.col("tok") - F.col("block") * block_tokens
        schedule = ranked.join(sizes, ["source", "block"]).select("slot", "source", "block", "repeat", F.least("size", left).alias("n_tokens"))
    got = schedule.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("used_tokens"))
    plan = spark.createDataFrame([(source, ppm, reps, tok, ppm * total / 1_000_000, tok * reps, x, tok * reps * 1_000_000 < ppm * total) for (_, source, ppm, reps, tok, _), x in zip(lines, plan_tokens)], "source string, target_ppm bigint, max_repeats bigint, tokens bigint, asked_tokens double, capacity_tokens bigint, planned_tokens bigint, short boolean")
    used = F.coalesce("used_tokens", F.lit(0.0))
    report = plan.join(got, "source", "left").withColumn("used_tokens", used)  # a row per source of the targets
    mixed = F.sum("used_tokens").over(Window.partitionBy())
    report = report.select(
        "source", "target_ppm", "max_repeats", "tokens", "asked_tokens", "capacity_tokens", "planned_tokens", "used_tokens", "short",
        F.when(mixed > 0, F.col("used_tokens") * 1e6 / mixed).otherwise(0.0).alias("reached_ppm"),
        F.when(F.col("tokens") > 0, F.col("used_tokens") / F.col("tokens")).otherwise(0.0).alias("repeats"),
    )
    return Mixture(schedule, blocks, report)
