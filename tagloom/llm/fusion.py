"""Best representative of each duplicate group, by Bayesian fusion with copy detection.

Sources claim values for the fields of a group's record.  Source accuracies and,
from values that are shared though false, the dependence between sources are
estimated in turns; a vote that may be copied is discounted; per field the value
of highest posterior wins.

Estimation needs no values, only which sources stand behind each value of a
(group, field): a bit mask, in as many words as the sources need.  The masks of
one (group, field) form a pattern, equal patterns are counted once and for all,
and every round of the estimation is a pass over the counted patterns that
returns sums per source and per pair of sources.

Groups are known by 128 bits of hashes while they are worked on; rows are read
once, and a group is reduced before it is shuffled, however large it is.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm._common import fresh
from tagloom.session import Scratch

#: Sources of a source dimension; the driver holds four numbers per pair of them.
MAX_SOURCES = 1024
#: Sources per word of a mask.
WORD = 62


class SourceModel(NamedTuple):
    """Estimated by ``estimate_sources``: per source its accuracy, per ordered pair the probability that the first copies."""

    names: list[str]
    accuracy: np.ndarray
    copies: np.ndarray


_GROUP = ["g", "g2"]


def _words(k: int) -> list[str]:
    return [f"m{i}" for i in range(max(1, -(-k // WORD)))]


def claims(rows: DataFrame, source_index: str, k: int, fields: dict[str, Column]) -> DataFrame:
    """(g, g2, field, value, m0 ..): each value that a group's rows give for a field, with the mask of its sources of ``k``.

    Group and values are hashes.  Rows without a known source support a value
    with an empty mask.  Aggregated before the shuffle, so copies of one row
    cost nothing.
    """
    named = F.array(*[F.struct(F.lit(i).alias("field"), c.alias("v")) for i, c in enumerate(fields.values())])
    at = F.coalesce(F.col(source_index), F.lit(-1))
    bit = lambda w: F.when((at >= w * WORD) & (at < (w + 1) * WORD), F.expr(f"shiftleft(1L, {source_index} - {w * WORD})")).otherwise(F.lit(0).cast("bigint"))
    words = _words(k)
    long = rows.select(*_GROUP, *[bit(i).alias(m) for i, m in enumerate(words)], F.explode(F.filter(named, lambda x: x["v"].isNotNull())).alias("x"))
    return long.groupBy(*_GROUP, F.col("x.field").cast("byte").alias("field"), F.col("x.v").alias("value")).agg(*[F.bit_or(m).alias(m) for m in words])


def _bits(mask: int) -> list[int]:
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length() - 1)
        mask ^= low
    return out


def vote(mask: int, accuracy: np.ndarray, copies: np.ndarray, n_false: int) -> float:
    """Log posterior weight of a value with these sources: each vote ln(n A / (1 - A)), times the chance that it is not copied from a better one."""
    total = 0.0
    before: list[int] = []
    for s in sorted(_bits(mask), key=lambda s: (-accuracy[s], s)):
        a = accuracy[s]
        # whoever of the two copies, only one of them saw for itself
        own = math.prod(1.0 - 0.8 * min(1.0, copies[s][t] + copies[t][s]) for t in before)
        total += own * math.log(n_false * a / (1.0 - a))
        before.append(s)
    return total


def _evidence(batches, k: int, acc: np.ndarray, dep: np.ndarray, n_false: int):
    """Sums over counted patterns under the present model: right, said (per source); shared surely true, surely false, neither, and not shared (per pair)."""
    right, said = np.zeros(k), np.zeros(k)
    pair = np.zeros((4, k, k))
    seen: dict[int, float] = {}
    for batch in batches:
        for words, ns, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            masks = [sum(x << WORD * i for i, x in enumerate(w)) for w in words]
            logs = []
            for m, c in zip(masks, ns):
                if m not in seen:
                    seen[m] = vote(m, acc, dep, n_false)
                logs.append(seen[m] + math.log(c))
            top = max(max(logs), 0.0)
            w = [math.exp(x - top) for x in logs]
            z = sum(w) + n_false * math.exp(-top)  # or none of them is true
            post = [x / z for x in w]
            where: dict[int, list[int]] = {}
            for i, (m, c) in enumerate(zip(masks, ns)):
                for s in _bits(m):
                    right[s] += n * post[i] / c
                    said[s] += n
                    where.setdefault(s, []).append(i)
            ss = sorted(where)
            for x, a in enumerate(ss):
                for b in ss[x + 1 :]:
                    both = set(where[a]) & set(where[b])
                    if both:
                        p = max(post[i] for i in both)
                        pair[0 if p > 0.9 else 1 if p < 0.1 else 2, a, b] += n
                    else:
                        pair[3, a, b] += n
    flat = np.concatenate([right, said, pair.ravel()])
    at = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at])], ["i", "x"])


def estimate_sources(claimed: DataFrame, names: list[str], prior: list[float] | None = None, n_false: int = 20, rounds: int = 5, scratch: Scratch | None = None) -> SourceModel:
    """Accuracies and copying by alternating estimation over counted patterns of claims.

    A (group, field) in which only one source speaks says nothing and is left
    out.  A source without claims keeps its prior, which counts as four claims.
    """
    k = len(names)
    if k > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    scratch = scratch or Scratch(claimed.sparkSession, "fusion")
    words = F.array(*_words(k))
    some = F.exists(words, lambda x: x != 0)
    per = claimed.where(some).groupBy(*_GROUP, "field", words.alias("mask")).agg(F.count("*").alias("n"))
    per = per.groupBy(*_GROUP, "field").agg(F.sort_array(F.collect_list(F.struct("mask", "n"))).alias("p"))  # at most one entry per set of sources
    per = per.where((F.size("p") > 1) | (F.aggregate(F.col("p")[0]["mask"], F.lit(0), lambda n, x: n + F.bit_count(x)) > 1))
    patterns = scratch.keep(per.groupBy("p").count().select(F.col("p.mask").alias("masks"), F.col("p.n").alias("ns"), "count"), "patterns")
    base = np.array(prior if prior is not None else [0.8] * k, float)
    acc, dep = base.copy(), np.zeros((k, k))
    for n in range(rounds):
        now = (acc, dep)
        sums = patterns.mapInArrow(lambda it, m=now: _evidence(it, k, m[0], m[1], n_false), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # at most 2 k + 4 k k numbers
        flat = np.zeros(2 * k + 4 * k * k)
        for r in sums:
            flat[r.i] = r.x
        right, said = base * 4.0 + flat[:k], 4.0 + flat[k : 2 * k]
        same_true, same_false, same, differ = flat[2 * k :].reshape(4, k, k)
        if n:  # the first round only looks for copying, or a crowd of copies would pass for the truth
            acc = np.clip(right / said, 0.05, 0.98)
        dep = np.zeros((k, k))
        c, e = 0.8, 1e-9  # a copier copies this share of its values
        for a in range(k):
            for b in range(a + 1, k):
                x, y = acc[a], acc[b]
                t_, f_ = x * y, max(e, (1 - x) * (1 - y) / n_false)  # both true, the same false one, by chance
                for s, t in ((a, b), (b, a)):  # s copies from t
                    own = 1 - c
                    llr = same_true[a, b] * math.log((c * acc[t] + own * t_) / t_) + same_false[a, b] * math.log((c * (1 - acc[t]) + own * f_) / f_)
                    # while it is open which value is true, only the agreement counts
                    llr += same[a, b] * math.log((c + own * (t_ + f_)) / (t_ + f_)) + differ[a, b] * math.log(own)
                    dep[s, t] = 1 / (1 + math.exp(min(700.0, max(-700.0, math.log(4.0) - llr))))
        dep = dep / np.maximum(1.0, dep + dep.T)
    scratch.drop(patterns)
    return SourceModel(names, acc, dep)


def score_masks(model: SourceModel, n_false: int = 20):
    """A column: the vote of the value behind the mask words of a row, an empty mask being worth little."""
    acc, dep = model.accuracy, model.copies

    @F.pandas_udf("double")
    def score(mask: pd.Series) -> pd.Series:
        known: dict[bytes, float] = {}
        out = []
        for w in mask:
            key = w.tobytes()
            if key not in known:
                m = sum(int(x) << WORD * i for i, x in enumerate(w))
                known[key] = vote(m, acc, dep, n_false) if m else 0.1
            out.append(known[key])
        return pd.Series(out, dtype="float64")

    return lambda: score(F.array(*_words(len(model.names))))


def best_records(rows: DataFrame, group: str, key: str, source: str, sources: DataFrame, recency: str, fields: dict[str, Column], present: dict[str, Column], rounds: int = 5, scratch: Scratch | None = None) -> tuple[DataFrame, SourceModel]:
    """One surviving key per group, and the best value of every field.

    ``sources`` (source, trust_rank) gives the prior of accuracies, from 0.95
    for the most trusted down to 0.6, and the rank of trust; a NULL or unknown
    source is least trusted.  ``present`` are the fields whose having a value
    makes a key complete, ``fields`` those that are fused.  The group's fused
    record has the value of highest posterior in each field.  The key that
    stands for it is the first by number of values present, trust, recency and
    then the least key; so a key that is at least as good as each other in all
    respects is always taken.

    Returns (group, key, several, clear, v_<field> hashes of the fused values) and
    the source model.  ``several`` tells groups of two or more keys; ``clear``
    says that the survivor has a value wherever the fused record has one, is
    trusted as much and as recent as any key, and that no other key is its
    equal in all of that: so it is at least as good as every other and better
    than each in something.  Rows with a NULL group or key are no cases; rows
    that repeat a key with the same content count once.
    """
    spark = rows.sparkSession
    scratch = scratch or Scratch(spark, "fusion")
    dim = sources.select(F.col("source").alias("_s"), F.col("trust_rank").cast("int").alias("_r")).where("_s is not null").orderBy("_r", "_s").limit(MAX_SOURCES + 1).collect()
    if len(dim) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = [r._s for r in dim]
    span = max(1, len(names) - 1)
    prior = [0.95 - 0.35 * i / span for i in range(len(names))]
    ranks = spark.createDataFrame([(r._s, r._r, i) for i, r in enumerate(dim)], "_s string, _r int, _i int")
    base = rows.where(F.col(group).isNotNull() & F.col(key).isNotNull())
    # values first, in a projection of their own, so that each is computed once for its hash and its presence
    named = {f"f_{n}": c for n, c in fields.items()}
    has = {n: f"f_{n}" if n in fields else f"p_{n}" for n in present}
    named |= {has[n]: c for n, c in present.items() if n not in fields}
    base = base.select(F.col(group).alias("grp"), F.col(key).alias("key"), F.col(source).alias("_src"), F.unix_micros(F.col(recency).cast("timestamp")).alias("at"), *[c.alias(n) for n, c in named.items()])
    # fields that are fused are looked up in the fused record; the flags hold the others as well
    flags = F.lit(0)
    for i, n in enumerate(has.values()):
        flags = flags + F.when(F.col(n).isNotNull(), 1 << i).otherwise(0)
    hashed = [F.when(F.col(f"f_{n}").isNotNull(), F.xxhash64(f"f_{n}")).alias(f"f_{n}") for n in fields]
    base = base.select("grp", "key", "_src", "at", flags.cast("int").alias("has"), F.xxhash64("grp").alias("g"), F.xxhash64(F.lit("second"), "grp").alias("g2"), F.xxhash64("key").alias("kh"), *hashed)
    base = base.join(F.broadcast(ranks), base["_src"] == ranks["_s"], "left").drop("_src", "_s").withColumn("rank", F.coalesce("_r", F.lit(2**31 - 1))).drop("_r")  # at most MAX_SOURCES rows
    base = scratch.keep(base, "rows")
    claimed = scratch.keep(claims(base, "_i", len(names), {n: F.col(f"f_{n}") for n in fields}), "claims")
    model = estimate_sources(claimed, names, prior, rounds=rounds, scratch=scratch)
    scored = claimed.withColumn("score", score_masks(model)())
    fused = scored.groupBy(*_GROUP).agg(*[F.max(F.when(F.col("field") == i, F.struct("score", "value"))).getField("value").alias(f"v_{n}") for i, n in enumerate(fields)])
    # the survivor: first by (values present, trust, recency, key); the last among its equals tells whether it has any
    at = F.coalesce("at", F.lit(-(2**63) + 1))
    down = lambda k: F.struct((-F.bit_count("has")).alias("n"), F.col("rank").alias("t"), (-at).alias("at"), F.col(k).alias("key"))
    up = F.struct(F.bit_count("has").alias("n"), (-F.col("rank")).alias("t"), at.alias("at"), F.col("kh").alias("key"))
    # keys of one group are told apart by their hashes; only the survivor's name is carried along
    own = base.groupBy(*_GROUP).agg(
        F.min("grp").alias("grp"), F.min(down("key")).alias("best"), F.max(up).getField("key").alias("_hi"), F.min(down("kh")).alias("_lo"),
        F.bit_or("has").alias("_has"), F.min("rank").alias("_rank"), F.max(at).alias("_at"), F.min("kh").alias("_k0"), F.max("kh").alias("_k1"),
        F.min_by("has", F.struct((-F.bit_count("has")).alias("n"), F.col("rank"), (-at).alias("at"))).alias("_own"),
    )
    out = own.join(fused, _GROUP, "left")
    whole = F.lit(0)
    for i, n in enumerate(present):
        there = F.col(f"v_{n}").isNotNull() if n in fields else F.col("_has").bitwiseAND(F.lit(1 << i)) != 0
        whole = whole + F.when(there, 1 << i).otherwise(0)
    several = F.col("_k0") != F.col("_k1")
    clear = several & (F.col("_hi") == F.col("_lo.key")) & (F.col("_own") == whole) & (F.col("_lo.t") == F.col("_rank")) & (-F.col("_lo.at") == F.col("_at"))
    return out.select(F.col("grp").alias(group), F.col("best.key").alias(key), several.alias("several"), clear.alias("clear"), *[f"v_{n}" for n in fields]), model


def fused_values(rows: DataFrame, best: DataFrame, group: str, fields: dict[str, Column]) -> DataFrame:
    """The survivors with the fused values themselves: ``best`` joined back to one row per winning (group, field, value)."""
    g = fresh(rows, "_g")
    base = rows.where(F.col(group).isNotNull()).select(F.col(group).alias(g), *[c.alias(f"f_{n}") for n, c in fields.items()])
    hit = base.join(best.select(F.col(group).alias(g), *[f"v_{n}" for n in fields]), g)
    values = hit.groupBy(g).agg(*[F.min(F.when(F.xxhash64(f"f_{n}") == F.col(f"v_{n}"), F.col(f"f_{n}"))).alias(f"best_{n}") for n in fields])
    return best.drop(*[f"v_{n}" for n in fields]).join(values.withColumnRenamed(g, group), group, "left")
