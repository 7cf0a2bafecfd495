"""Placing groups of rows into splits by iterative stratification, on counts.

The label with the fewest rows left goes first; its groups are placed, each into
the split that still lacks most of that label; then the label that is rarest
among what remains, and so on; groups without a label follow by their size.
Whether a group is placed in a round does not depend on where others went, so the
rounds are known from counts.  Groups that are alike for a round form a class:
same label in turn, same number of its rows (above ``EXACT`` within a 64th of an
octave), same part of a hash of their labels.  Of a class only its number of
groups and its rows per label reach the driver, which fills the splits as if the
groups came one by one; in the class a group finds its split by its rank.

The driver holds at most labels x (``EXACT`` + 64 x 40) classes, with ``PARTS``
hash parts for classes of single rows, fewer for larger ones.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.ranked import spread_rank
from tagloom.session import Scratch

#: Numbers of rows up to which a class holds groups of one number only.
EXACT = 1024
#: Parts of the hash of the labels for groups with one row of the label in turn.
PARTS = 128
#: Groups from which the order of the labels is guessed before it is checked on all.
SAMPLE = 5_000
#: Labels this near to the rarest are as rare.
NEAR = 1.05
#: Labels; of each pair the driver holds a number.
MAX_LABELS = 4096
_ROWS, _GROUPS = -1, -2


def guess_order(totals: dict[int, int], sample: list[dict[int, int]], sure: list[int] = ()) -> list[int]:
    """The order in which labels become the rarest, by ``sample`` groups ({label: rows}) drawn up to the true totals; ``sure`` comes first."""
    names = sorted(totals)
    at = {j: i for i, j in enumerate(names)}
    m = np.zeros((len(sample), len(names)))
    for i, v in enumerate(sample):
        for j, n in v.items():
            m[i, at[j]] = n
    seen = m.sum(0)
    scale = np.array([totals[j] for j in names]) / np.maximum(seen, 1)
    live, out, todo = np.ones(len(sample), bool), [], set(names)
    while todo:
        left = np.where(seen > 0, m[live].sum(0) * scale, [totals[j] for j in names])
        j = sure[len(out)] if len(out) < len(sure) else min(todo, key=lambda x: (left[at[x]] <= 0, left[at[x]], x))
        todo.discard(j)
        out.append(j)
        live &= m[:, at[j]] == 0
    return out


def confirm_order(order: list[int], sure: int, totals: dict[int, int], rounds: dict[tuple[int, int], int]) -> tuple[int, dict[int, int]]:
    """How far ``order`` is right, and the rows of each label left then.

    ``rounds`` has the rows of a label in groups of a round, if rounds go by
    ``order``; a round's numbers hold as long as the rounds before it do.  Labels
    within ``NEAR`` of the rarest count as equally rare.
    """
    left = dict(totals)
    for p, j in enumerate(order):
        if p >= sure:
            best = min((x for x in order[p:]), key=lambda x: (left[x] <= 0, left[x], x))
            if best != j and left[best] > 0 and not 0 < left[j] <= left[best] * NEAR:
                return p, left
        for x in order[p:]:
            left[x] -= rounds.get((p, x), 0)
    return len(order), left


def fill(need: np.ndarray, rows: np.ndarray, room: np.ndarray, n: int, weight: float, size: float) -> np.ndarray:
    """How many of ``n`` equal groups each split gets, if each group goes where ``need`` is largest, then ``rows``.

    A group takes ``weight`` off the need and ``size`` off rows and room; a split without
    room for it gets none as long as another has room.
    """
    need, rows, room = need.copy(), rows.copy(), room.copy()
    got = np.zeros(len(need), np.int64)
    if n > 4 * len(need) and weight > 0:  # all but the last few at once: bring the needs down to one level
        low, high = need.min() - n * weight, need.max()
        most = np.maximum(0, np.floor(room / size)) if size > 0 else np.full(len(need), n)
        bulk = lambda x: np.minimum(np.maximum(0, np.floor((need - x) / weight)), most)
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if bulk(mid).sum() > n - len(need) else (low, mid)
        got = bulk(high).astype(np.int64)
        need -= got * weight
        rows -= got * size
        room -= got * size
    for _ in range(n - int(got.sum())):
        s = max(range(len(need)), key=lambda i: (room[i] >= size, round(need[i], 6), round(rows[i], 6), -i))
        got[s] += 1
        need[s] -= weight
        rows[s] -= size
        room[s] -= size
    return got


def place_classes(classes: list[tuple], quota: dict[int, np.ndarray], rows: np.ndarray, room: np.ndarray) -> list[tuple]:
    """``classes``: (round, label in turn or None, order in the round, key, groups, size, {label: rows}) -> (key, groups, counts per split)."""
    quota, rows, room, out = {j: q.copy() for j, q in quota.items()}, rows.copy(), room.copy(), []
    for _, label, _, key, n, size, vector in sorted(classes, key=lambda c: (c[0], c[2], c[3])):
        if label is None:
            got = fill(rows, rows, room, n, size / n, size / n)
        else:
            got = fill(quota[label], rows, room, n, vector[label] / n, size / n)
        part = got / n
        for j, x in vector.items():
            quota[j] -= part * x
        rows -= part * size
        room -= part * size
        out.append((key, n, got))
    return out


def _class_size(n: Column) -> Column:
    """The number itself up to ``EXACT``, then 64 classes per octave."""
    return F.when(n <= EXACT, n).otherwise(F.lit(EXACT) + F.ceil(F.log2(n / F.lit(float(EXACT))) * 64)).cast("int")


def stratify(groups: DataFrame, gid: str, shares: Mapping[str, float], seed: int = 0, tolerance: float = 0.02, quotas=None, scratch: Scratch | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(gid, split, ``carry``) of ``groups`` (gid, size, vec ARRAY<STRUCT<label INT, n BIGINT>>), one row per group.

    ``vec`` has each label once.  ``quotas`` (rows of a label -> rows per split)
    replaces exact shares.  Splits end within the larger of ``tolerance`` of all
    rows and the largest group of their shares, as far as labels were placed
    that way; groups without labels even out the rest.  No groups give no rows.
    """
    spark = groups.sparkSession
    names = list(shares)
    part = np.array([float(shares[s]) for s in names])
    part /= part.sum()
    quotas = quotas or (lambda n: part * n)
    scratch = scratch or Scratch(spark, "stratify")
    labels = F.transform("vec", lambda x: x["label"])
    g = groups.select(F.col(gid).alias("gid"), F.col("size").cast("bigint").alias("size"), F.coalesce(F.col("vec"), F.array().cast("array<struct<label:int,n:bigint>>")).alias("vec"), *[F.col(c).alias(f"c_{c}") for c in carry])
    kept = [f"c_{c}" for c in carry]
    whole = lambda df, split: df.select(F.col("gid").alias(gid), split.alias("split"), *[F.col(f"c_{c}").alias(c) for c in carry])
    g = scratch.keep(g.withColumn("h", F.xxhash64(F.lit(seed), "gid")).withColumn("sig", F.xxhash64(F.array_sort(labels))), "groups")
    counted = F.array_prepend("vec", F.struct(F.lit(_ROWS).alias("label"), F.col("size").alias("n")))
    got = g.select("size", F.explode(counted).alias("x")).groupBy(F.col("x.label").alias("label")).agg(F.sum("x.n").alias("n"), F.max("size").alias("largest")).limit(MAX_LABELS + 2).collect()
    if not got:
        return whole(g, F.lit(""))
    totals = {r.label: r.n for r in got}
    if len(totals) > MAX_LABELS + 1:
        raise ValueError(f"more than {MAX_LABELS} labels")
    n_rows, largest = totals.pop(_ROWS), max(r.largest for r in got)
    sample = [{x.label: x.n for x in r.vec} for r in g.where("size(vec) > 0").orderBy("h").limit(SAMPLE).select("vec").collect()]
    order, sure = guess_order(totals, sample), 0
    while True:
        place = F.create_map(*[F.lit(x) for p, j in enumerate(order) for x in (j, p)]) if order else None
        first = F.coalesce(F.array_min(F.transform("vec", lambda x: F.element_at(place, x["label"]))), F.lit(len(order))) if order else F.lit(0)
        if sure == len(order):
            break
        rounds = {(r.p, r.label): r.n for r in g.where("size(vec) > 0").select(first.alias("p"), F.explode("vec").alias("x")).groupBy("p", F.col("x.label").alias("label")).agg(F.sum("x.n").alias("n")).collect()}  # labels x labels
        sure, left = confirm_order(order, sure, totals, rounds)
        if sure < len(order):  # the rarest now is known; what comes after it is guessed again
            best = min(order[sure:], key=lambda x: (left[x] <= 0, left[x], x))
            order = guess_order(totals, sample, [*order[:sure], best])
    turn = F.get(F.array(*map(F.lit, order)), F.col("p")) if order else F.lit(None).cast("int")
    count = F.coalesce(F.get(F.filter("vec", lambda x: x["label"] == turn), F.lit(0))["n"], F.col("size")) if order else F.col("size")
    classed = g.withColumn("p", first).withColumn("c", _class_size(count)).withColumn("part", F.pmod("sig", F.greatest(F.lit(1), F.expr(f"{PARTS} div c"))).cast("int"))
    parts = F.concat("vec", F.array(F.struct(F.lit(_ROWS).alias("label"), F.col("size").alias("n")), F.struct(F.lit(_GROUPS).alias("label"), F.lit(1).cast("bigint").alias("n"))))
    per = classed.select("p", "c", "part", F.explode(parts).alias("x")).groupBy("p", "c", "part", F.col("x.label").alias("label")).agg(F.sum("x.n").alias("n"))
    held: dict[tuple, dict[int, int]] = {}
    for r in per.toPandas().itertuples(index=False):  # bounded by labels and classes, see above
        held.setdefault((int(r.p), int(r.c), int(r.part)), {})[int(r.label)] = int(r.n)
    classes = []
    for key, v in held.items():
        n, size = v.pop(_GROUPS), v.pop(_ROWS)
        classes.append((key[0], order[key[0]] if key[0] < len(order) else None, -key[1], key, n, size, v))
    slack = max(math.ceil(n_rows * tolerance), largest)
    placed = place_classes(classes, {j: np.asarray(quotas(n), float) for j, n in totals.items()}, part * n_rows, part * n_rows + slack)
    cols = [f"n{i}" for i in range(len(names))]
    plan = spark.createDataFrame([(*key, n, *map(int, c)) for key, n, c in placed], "p int, c int, part int, n bigint, " + ", ".join(f"{c} bigint" for c in cols))
    ranked = spread_rank(classed.select("gid", "h", "p", "c", "part", *kept), ["p", "c", "part"], [F.col("h"), F.col("gid")], "k")
    put = ranked.join(F.broadcast(plan), ["p", "c", "part"])  # as many rows as classes
    # the k-th of n groups: each split takes its number of them, spread evenly over the ranks that the splits before it left
    k, n, split = F.col("k") - 1, F.col("n"), F.lit(names[-1])
    steps = []
    for i, s in enumerate(names[:-1]):
        mine = lambda x, c=F.col(cols[i]), n=n: F.when(n > 0, F.floor(x.cast("double") * c / n)).otherwise(0).cast("bigint")
        steps.append((mine(k + 1) > mine(k), s))
        k, n = k - mine(k), n - F.col(cols[i])
    for hit, s in reversed(steps):
        split = F.when(hit, s).otherwise(split)
    return whole(put, split)
