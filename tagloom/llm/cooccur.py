"""Items that appear together: pair counts by external sort, and how far they exceed chance.

Every basket's item set becomes packed 64-bit codes ``kind | a | b`` (a code with
``a = b`` counts an item, the code of all ones counts baskets).  A map task sorts
the codes it makes run by run and writes each run already counted, so a pair
leaves a task at most once per run however hot it is.  The shuffle by code and
the sort inside each partition are Spark's external sorter: it spills sorted runs
and merges them.  What is left is a run-length count over the merged stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of an item id in a code; ids are 0 .. 2**30 - 2.
ITEM_BITS = 30
_MASK = (1 << ITEM_BITS) - 1
#: Codes that a task sorts at once (8 bytes each): the length of a run.
RUN_CODES = 4_000_000
#: Items of one basket that are paired as one array; larger baskets are cut into blocks of about this size.
BLOCK_ITEMS = 4096


def _runs(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Run-length count of codes: distinct codes in order, with their counts."""
    if weights is None:
        codes = np.sort(codes)
    edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    if weights is None:
        return codes[edge], np.diff(np.append(edge, len(codes)))
    return codes[edge], np.add.reduceat(weights, edge)


def _pair_codes(offsets: np.ndarray, values: np.ndarray, head: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of all pairs a <= b within each list, lists of one length at a time."""
    sizes = np.diff(offsets)
    for n in np.unique(sizes):
        if n == 0:
            continue
        at = offsets[:-1][sizes == n]
        i, j = np.triu_indices(int(n))
        step = max(1, RUN_CODES // len(i))
        kinds = head[sizes == n]
        for k in range(0, len(at), step):
            rows = values[at[k : k + step, None] + np.arange(n)]
            rows.sort(axis=1)
            yield (kinds[k : k + step, None] | rows[:, i] << ITEM_BITS | rows[:, j]).ravel()


def _cross_codes(left, right, kind: int) -> np.ndarray:
    a, b = np.meshgrid(np.asarray(left, np.int64), np.asarray(right, np.int64), indexing="ij")
    lo, hi = np.minimum(a, b).ravel(), np.maximum(a, b).ravel()
    return kind | lo << ITEM_BITS | hi


_RUN_SCHEMA = pa.schema([("code", pa.int64()), ("n", pa.int64())])


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: (kind, items, other) -> counted sorted runs of codes."""
    held: list[np.ndarray] = []
    total = 0

    def flush():
        code, n = _runs(np.concatenate(held))
        held.clear()
        for k in range(0, len(code), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(code[k : k + (1 << 16)]), pa.array(n[k : k + (1 << 16)], pa.int64())], schema=_RUN_SCHEMA)

    for batch in batches:
        kind = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) << (2 * ITEM_BITS)
        items = batch.column(1)
        other = batch.column(2)
        whole = np.asarray(other.is_null())
        lists = items.filter(pa.array(whole))
        off = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(values) and (values.min() < 0 or values.max() >= _MASK):
            raise ValueError("item ids must be 0 .. 2**30 - 2")
        parts = [kind[whole][np.diff(off) > 0] | (_MASK << ITEM_BITS | _MASK)]
        for part in (*parts, *_pair_codes(off, values, kind[whole])):
            held.append(part)
            total += len(part)
            if total >= RUN_CODES:
                yield from flush()
                total = 0
        for r in np.flatnonzero(~whole):  # blocks of a large basket: one block against another
            part = _cross_codes(items[int(r)].as_py(), other[int(r)].as_py(), int(kind[r]))
            held.append(part)
            total += len(part)
            if total >= RUN_CODES:
                yield from flush()
                total = 0
    if total:
        yield from flush()


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: the merged stream in code order -> one row per code."""
    code0, n0 = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        code, n = _runs(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False))
        n = n.astype(np.int64)
        if code0 is not None:
            if code[0] == code0:
                n[0] += n0
            else:
                code, n = np.insert(code, 0, code0), np.insert(n, 0, n0)
        code0, n0 = int(code[-1]), int(n[-1])
        yield pa.RecordBatch.from_arrays([pa.array(code[:-1]), pa.array(n[:-1])], schema=_RUN_SCHEMA)
    if code0 is not None:
        yield pa.RecordBatch.from_arrays([pa.array([code0], pa.int64()), pa.array([n0], pa.int64())], schema=_RUN_SCHEMA)


def pair_counts(items: DataFrame, kind: str = "kind", basket: str = "basket", item: str = "item", vocabulary: int | None = None) -> DataFrame:
    """Code table (kind, label_a, label_b, n) of all baskets; ``label_a = label_b`` counts an item, both NULL counts baskets.

    ``items`` has a row per item of a basket; repeated rows count once, rows with
    a NULL in any of the three columns count nothing; an item id out of range
    raises.  ``kind`` is 0 .. 7 and
    keeps several families of baskets apart in one pass.  ``vocabulary`` is the
    number of different items if known; above ``BLOCK_ITEMS`` (or unknown) large
    baskets are cut into blocks that are paired on different tasks.
    """
    rows = items.select(F.col(kind).cast("int").alias("kind"), F.col(basket).alias("basket"), F.col(item).cast("long").alias("item")).where("kind is not null and basket is not null and item is not null")
    rows = rows.distinct()
    if vocabulary is not None and vocabulary <= BLOCK_ITEMS:
        lists = rows.groupBy("kind", "basket").agg(F.collect_list("item").alias("items")).select("kind", "items", F.lit(None).cast("array<bigint>").alias("other"))
    else:
        sizes = rows.groupBy("kind", "basket").agg(F.count("*").alias("n"))
        large = sizes.where(F.col("n") > BLOCK_ITEMS).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ITEMS).cast("int"))
        marked = rows.join(large.drop("n"), ["kind", "basket"], "left").withColumn("block", F.pmod(F.xxhash64("item"), F.coalesce("blocks", F.lit(1))).cast("int"))
        cut = marked.groupBy("kind", "basket", "blocks", "block").agg(F.collect_list("item").alias("items"))
        small = cut.select("kind", "items", F.lit(None).cast("array<bigint>").alias("other"))
        a = cut.where("blocks is not null").alias("a")
        b = cut.where("blocks is not null").alias("b")
        # a block pairs within itself like a small basket; the basket itself is counted once, by its block 0
        across = a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.basket") == F.col("b.basket")) & (F.col("a.block") < F.col("b.block"))).select(F.col("a.kind").alias("kind"), F.col("a.items").alias("items"), F.col("b.items").alias("other"))
        lists = small.unionByName(across)
    runs = lists.mapInArrow(_sorted_runs, "code bigint, n bigint")
    merged = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_run_lengths, "code bigint, n bigint")
    a = F.shiftright("code", ITEM_BITS).bitwiseAND(F.lit(_MASK))
    b = F.col("code").bitwiseAND(F.lit(_MASK))
    every = b == F.lit(_MASK)
    out = merged.select(F.shiftright("code", 2 * ITEM_BITS).cast("int").alias("kind"), F.when(~every, a).cast("int").alias("label_a"), F.when(~every, b).cast("int").alias("label_b"), "n")
    if vocabulary is not None and vocabulary <= BLOCK_ITEMS:
        return out
    # in blocks a large basket was counted once per block
    extra = large.groupBy("kind").agg(F.sum(F.col("blocks") - 1).alias("extra"))
    return out.join(extra, "kind", "left").withColumn("n", F.when(F.col("label_a").isNull(), F.col("n") - F.coalesce("extra", F.lit(0))).otherwise(F.col("n"))).drop("extra")


def association(counts: DataFrame) -> DataFrame:
    """Pairs with n_ab, n_a, n_b, n, lift, and the odds ratio with 0.5 added to each cell of the 2 x 2 table.

    The correction keeps the ratio finite where a cell is empty.
    """
    n = counts.where("label_a is null").select("kind", F.col("n").alias("n_baskets"))
    one = counts.where("label_a = label_b").select("kind", F.col("label_a").alias("label"), F.col("n").alias("n_one"))
    pairs = counts.where("label_a < label_b").withColumnRenamed("n", "n_ab")
    a = one.select("kind", F.col("label").alias("label_a"), F.col("n_one").alias("n_a"))
    b = one.select("kind", F.col("label").alias("label_b"), F.col("n_one").alias("n_b"))
    t = pairs.join(a, ["kind", "label_a"]).join(b, ["kind", "label_b"]).join(n, "kind")
    d = lambda c: F.col(c).cast("double")
    n11, n10, n01 = d("n_ab"), d("n_a") - d("n_ab"), d("n_b") - d("n_ab")
    n00 = d("n_baskets") - d("n_a") - d("n_b") + d("n_ab")
    odds = ((n11 + 0.5) * (n00 + 0.5)) / ((n10 + 0.5) * (n01 + 0.5))
    return t.select(
        "kind", "label_a", "label_b", "n_ab", "n_a", "n_b", "n_baskets",
        (d("n_ab") * d("n_baskets") / (d("n_a") * d("n_b"))).alias("lift"),
        odds.alias("odds_ratio"),
        F.sqrt(1 / (n11 + 0.5) + 1 / (n10 + 0.5) + 1 / (n01 + 0.5) + 1 / (n00 + 0.5)).alias("log_odds_error"),
    )


def beyond_chance(pairs: DataFrame, least: int = 5, times: int = 3) -> DataFrame:
    """Pairs in at least ``least`` baskets and ``times`` as many as chance gives, in exact arithmetic."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.where((F.col("n_ab") >= least) & (big("n_ab") * big("n_baskets") >= F.lit(times).cast("decimal(1,0)") * (big("n_a") * big("n_b")).cast("decimal(37,0)")))
