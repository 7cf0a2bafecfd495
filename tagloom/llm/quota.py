"""A sample whose shares follow given targets: hierarchical top-down allocation over a category tree.

Quotas go down from the root.  What a category cannot fill is passed to its
siblings, what these cannot take to its cousins, and so on upwards.  At the
leaves rows are drawn by their dense rank in a seeded permutation.  Only counts
per category reach the driver; the tree comes from the target table, whose size
is checked.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm._common import fresh, keep_order_hash, spread_rank
from tagloom.session import Scratch

#: Rows of a target table; it is a dimension that the driver allocates over.
MAX_CATEGORIES = 200_000


class Drawn(NamedTuple):
    sample: DataFrame
    report: DataFrame


def apportion(total: int, weights: list[int]) -> list[int]:
    """Whole numbers that sum to ``total`` in proportion to the weights, by largest remainder; ties go to the earlier."""
    s = sum(weights)
    if s <= 0 or total <= 0:
        return [0] * len(weights)
    base = [total * w // s for w in weights]
    rest = sorted(range(len(weights)), key=lambda i: (-(total * weights[i] % s), i))
    for i in rest[: total - sum(base)]:
        base[i] += 1
    return base


def fill(total: int, weights: list[int], room: list[int]) -> list[int]:
    """``total`` by the weights, never more than ``room``; what one cannot take goes to the others, in rounds."""
    got = [0] * len(weights)
    while True:
        left = min(total, sum(room)) - sum(got)
        open_ = [i for i in range(len(weights)) if got[i] < room[i]]
        if left <= 0 or not open_:
            return got
        w = [weights[i] for i in open_]
        share = apportion(left, w if sum(w) else [1] * len(open_))
        if not any(share):
            share = [1] * len(open_)
        for i, x in zip(open_, share):
            got[i] += min(x, room[i] - got[i], left)
            left -= min(x, left)


def allocate(leaves: list[dict], size: int) -> list[dict]:
    """Quotas of a sample of ``size`` rows over leaves ``{path, ppm, least, rows}``; adds ``asked``, ``quota`` and ``passed``.

    A leaf asks for its share, at least ``least``.  Own supply is used first;
    then the unmet quota of each inner node, deepest first, goes to its other
    leaves by their shares, so siblings take it before cousins do.  ``wanted`` is
    what the leaf asked for before it gave way to the minima of others, ``drained``
    says that this took its whole supply.
    """
    asked = apportion(size, [x["ppm"] for x in leaves])
    for x, a in zip(leaves, asked):
        x["asked"] = max(a, x["least"])
        x["quota"] = min(x["asked"], x["rows"])
        x["wanted"], x["drained"] = x["asked"], x["rows"] <= x["asked"]
    extra = sum(x["asked"] for x in leaves) - size  # minima took this much beyond the sample's size
    if extra > 0:
        spare = [max(0, x["quota"] - min(x["least"], x["rows"])) for x in leaves]
        for x, cut in zip(leaves, fill(extra, spare, spare)):
            x["quota"] -= cut
            x["asked"] -= cut
    depth = max((len(x["path"]) for x in leaves), default=0)
    unmet = {x["path"]: x["asked"] - x["quota"] for x in leaves}
    for d in range(depth - 1, -1, -1):
        up: dict[tuple, int] = {}
        members: dict[tuple, list[dict]] = {}
        for p, n in unmet.items():
            up[p[:d]] = up.get(p[:d], 0) + n
        for x in leaves:
            members.setdefault(x["path"][:d], []).append(x)
        for p, n in up.items():
            if n:
                own = members.get(p, [])
                room = [x["rows"] - x["quota"] for x in own]
                got = fill(n, [x["ppm"] for x in own], room)
                for x, g in zip(own, got):
                    x["quota"] += g
                up[p] = n - sum(got)
        unmet = up
    for x in leaves:
        x["passed"] = x["quota"] - min(x["asked"], x["rows"])
    return leaves


def draw_to_targets(rows: DataFrame, category: str, row_id: list[str], targets: DataFrame, path: list[str], size: int | None = None, one_in: int = 10, seed: int = 0, order: Column | None = None) -> Drawn:
    """Draw ``size`` rows (by default one in ``one_in`` of all, rounded down) with the shares of ``targets``.

    ``targets`` has the column ``category`` (unique), ``target_ppm``,
    ``min_rows`` and the columns of ``path`` from the root down.  ``rows`` must
    hold one row per thing that can be drawn; a row whose category is NULL or
    has no target is never drawn.  Returns the sample (the rows as they came)
    and the report: per category ``rows``, ``wanted`` (its share, at least its
    minimum), ``asked`` (what is left of that once it gave way to the minima of
    others), ``quota`` (what is drawn), ``passed`` (what it took over from
    others), ``missing`` (wanted but not drawn, whatever the reason), ``drained``
    (all its rows were wanted), ``below_share`` and ``below_min``, both by the
    whole supply, and ``reached_ppm``.  Empty rows give an empty sample and a report of zeros.
    """
    spark = rows.sparkSession
    rows = Scratch(spark, "quota").keep(rows, "rows")  # read for the counts, the ranks and the draw
    t = targets.select(F.col(category).alias("c"), F.coalesce("target_ppm", F.lit(0)).cast("long").alias("ppm"), F.coalesce("min_rows", F.lit(0)).cast("long").alias("least"), F.array(*[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in path]).alias("path")).where("c is not null").limit(MAX_CATEGORIES + 1).collect()
    if len(t) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories")
    # one pass for the size and the supply; all rows without a target are one group, so at most MAX_CATEGORIES + 1 counts come back
    known = F.broadcast(targets.select(category).where(F.col(category).isNotNull()).distinct().withColumn("_known", F.lit(True)))
    counts = dict(rows.select(category).join(known, category, "left").groupBy(F.when(F.col("_known"), F.col(category)).alias("c")).count().collect())
    if size is None:
        size = sum(counts.values()) // one_in
    leaves = [{"c": r.c, "path": (*r.path, str(r.c)), "ppm": r.ppm, "least": r.least, "rows": counts.get(r.c, 0)} for r in sorted(t, key=lambda r: (r.path, r.c))]
    allocate(leaves, size)
    kind = targets.schema[category].dataType.simpleString()
    drawn = max(1, sum(x["quota"] for x in leaves))
    lines = [(x["c"], x["ppm"], x["least"], x["rows"], x["wanted"], x["asked"], x["quota"], x["passed"], max(0, x["wanted"] - x["quota"]), x["drained"], x["rows"] * 1_000_000 < x["ppm"] * size, x["rows"] < x["least"], x["quota"] * 1e6 / drawn) for x in leaves]
    report = spark.createDataFrame(lines, f"`{category}` {kind}, target_ppm bigint, min_rows bigint, rows bigint, wanted bigint, asked bigint, quota bigint, passed bigint, missing bigint, drained boolean, below_share boolean, below_min boolean, reached_ppm double")
    rank, quota, cat = fresh(rows, "_rank"), fresh(rows, "_quota"), fresh(rows, "_cat")
    quotas = report.where("quota > 0").select(F.col(category).alias(cat), F.col("quota").alias(quota))
    open_ = rows.join(F.broadcast(quotas), F.col(f"`{category}`") == F.col(cat)).drop(cat)  # at most MAX_CATEGORIES rows of 16 bytes
    perm = keep_order_hash(seed, *row_id) if order is None else order
    ranked = spread_rank(open_, [category], [perm, *map(F.col, row_id)], rank)
    return Drawn(ranked.where(F.col(rank) <= F.col(quota)).select(*[F.col(f"`{c}`") for c in rows.columns]), report)
