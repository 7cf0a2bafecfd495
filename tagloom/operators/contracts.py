"""Constraints: named predicates that no row may meet, in report or strict mode."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Raised in strict mode; names the broken constraints and how often each was broken."""


@dataclass(frozen=True)
class Constraint:
    name: str
    violation: Column
    detail: Column | None = None


def violations(df: DataFrame, constraints: Sequence[Constraint], key: str) -> DataFrame:
    """(name, key, detail): one row per broken constraint of a row, in one pass.  A predicate that is NULL is not broken."""
    hits = F.array(*[F.when(c.violation, F.struct(F.lit(c.name).alias("name"), (c.detail if c.detail is not None else F.lit("")).cast("string").alias("detail"))) for c in constraints])
    return df.select(F.col(key).cast("string").alias("key"), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("v")).select("v.name", "key", "v.detail")


def require(df: DataFrame, constraints: Sequence[Constraint], key: str) -> DataFrame:
    """Strict mode: the rows as they came, or ``ContractError``."""
    broken = violations(df, constraints, key).groupBy("name").agg(F.count("*").alias("n"), F.min("key").alias("first")).orderBy("name").collect()
    if broken:
        raise ContractError("; ".join(f"{r.name}: {r.n} rows, first {r.first}" for r in broken))
    return df


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that stand in more than one row, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def score_constraints(scores: str, width: int) -> list[Constraint]:
    """Length, finite numbers, and the range [0, 1], as three rules."""
    s = F.col(scores)
    return [
        Constraint("score_width", (F.size(s) != width) | s.isNull()),
        Constraint("score_not_finite", F.exists(s, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))),
        Constraint("score_out_of_range", F.exists(s, lambda x: (x < 0) | (x > 1))),
    ]


def all_scores_text(scores: Column) -> Column:
    """Are all rendered scores of the form 0.dd or 1.00?"""
    return F.forall(scores, lambda x: x.rlike(r"^(0\.[0-9]{2}|1\.00)$"))


def threshold_errors(thresholds: DataFrame, dim: DataFrame, fallback: float = 0.5) -> DataFrame:
    """(label_idx, rule): thresholds (label_idx, mode, threshold, status) that do not fit the labels (idx, mode).

    Every label once and no other; the label's mode; a number from 0 to 1, but
    NULL for an unsupported label; a label without enough support has the
    fallback.
    """
    t = thresholds.groupBy("label_idx").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("mode", "threshold", "status")])
    j = dim.select(F.col("idx").alias("label_idx"), F.col("mode").alias("own")).join(t, "label_idx", "full")
    v, off = F.col("threshold"), F.col("own") == "unsupported"
    rules = {
        "missing": F.col("n").isNull(),
        "unknown_label": F.col("own").isNull(),
        "twice": F.col("n") > 1,
        "other_mode": F.col("mode") != F.col("own"),
        "unsupported_with_threshold": off & v.isNotNull(),
        "not_a_share": ~off & F.col("n").isNotNull() & (v.isNull() | F.isnan(v) | (v < 0) | (v > 1)),
        "not_the_fallback": ~off & (F.col("status") == "fallback_insufficient_support") & (v != fallback),
    }
    hit = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return j.select("label_idx", F.explode(hit).alias("rule"))


def schedule_totals(schedule: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(name, expected, actual) of totals of a schedule that are not as expected: batches, slots, uniform, balanced, and the least and most turns of a label."""
    per = schedule.where("balanced_label_index is not null").groupBy("balanced_label_index").agg(F.count("*").alias("n")).agg(F.min("n").alias("least_turns"), F.max("n").alias("most_turns"))
    t = schedule.agg(F.count_distinct("global_batch").alias("batches"), F.count("*").alias("slots"), F.count_if(F.col("stream") == "uniform").alias("uniform"), F.count_if(F.col("stream") == "balanced").alias("balanced")).join(per, F.lit(True))  # one row each
    long = t.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).cast("bigint").alias("expected"), F.col(n).alias("actual")) for n, x in expected.items()])).alias("x")).select("x.*")
    return long.where(~F.col("expected").eqNullSafe(F.col("actual")))


def overclaims(reported: DataFrame, measured: DataFrame, name: str, status: str, order: Sequence[str] = ("success", "partial", "fail")) -> DataFrame:
    """(name, reported, measured) where a better status is reported than was measured; what was not measured counts as the worst."""
    place = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(c)), F.lit(0)), F.lit(len(order)))
    j = reported.select(name, F.col(status).alias("reported")).join(measured.select(name, F.col(status).alias("measured")), name, "left")
    return j.where(place("reported") < place("measured"))


def one_to_one(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, problem): rows of two tables that do not go one to one with equal fields: only on one side, twice, or the first field that differs."""
    pack = lambda df, x: df.groupBy(key).agg(F.count("*").alias(f"n{x}"), *[F.min(f).alias(f"{f}_{x}") for f in fields])
    j = pack(a, "a").join(pack(b, "b"), key, "full")
    problem = F.when(F.col("na").isNull(), "only_in_b").when(F.col("nb").isNull(), "only_in_a").when((F.col("na") > 1) | (F.col("nb") > 1), "twice")
    for f in fields:
        problem = problem.when(~F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b")), f"other_{f}")
    return j.select(key, problem.alias("problem")).where("problem is not null")
