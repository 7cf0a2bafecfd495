"""Cells: one row per record and label, the shape that all metrics work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import dimension

#: Columns of a cell: label, known and pu are 0 or 1.
CELL = ("record_id", "label_idx", "tag", "mode", "subcategory", "label", "known", "pu", "score")


def from_vectors(rows: DataFrame, dim: DataFrame, keep: list[str], vectors: dict[str, str]) -> DataFrame:
    """Wide rows with aligned vectors -> cells, joined to the label dimension by position.

    ``vectors`` maps a cell column to the array column it comes from.  Positions
    beyond the dimension, and rows whose vectors are all NULL, give no cells.
    """
    zipped = F.arrays_zip(*[F.col(a).alias(c) for c, a in vectors.items()])
    long = rows.select(*keep, F.posexplode(zipped).alias("label_idx", "x"))
    flat = long.select(*keep, "label_idx", *[F.col("x").getField(c).alias(c) for c in vectors])
    return flat.join(dimension(dim.withColumnRenamed("idx", "label_idx")), "label_idx")


def to_vectors(cells: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Cells -> one row per key with a vector per column, in label order; at most as long as the label dimension."""
    packed = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("label_idx", *columns))).alias("v"))
    return packed.select(*keys, *[F.col(f"v.{c}").alias(c) for c in columns])


def binary(c: Column) -> Column:
    """0 or 1 of 0, 1, 0.0, 1.0, true, false in any notation as text; else NULL."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("1", "1.0", "true"), 1).when(s.isin("0", "0.0", "false"), 0)


def binary_vector(arr: Column, width: int) -> Column:
    """An ARRAY<INT> of the width; one shorter is padded with 0; a bad element or width gives NULL."""
    v = F.transform(arr, binary)
    v = F.when(F.size(v) == width - 1, F.concat(v, F.array(F.lit(0)))).otherwise(v)
    return F.when((F.size(v) == width) & F.forall(v, lambda x: x.isNotNull()), v)


def multi_hot(tags: Column, labels: list[str]) -> Column:
    """Tag list -> 0/1 vector in label order."""
    return F.transform(F.array(*map(F.lit, labels)), lambda t: F.array_contains(F.coalesce(tags, F.array().cast("array<string>")), t).cast("int"))


def from_evidence(rows: DataFrame, dim: DataFrame, lists: dict[str, Column], keep: list[str]) -> DataFrame:
    """Evidence rows with label index lists -> stated cells (label, known, pu), one per row and label that any list names.

    Present beats present-only, which beats absent.
    """
    code = {"pn_positive": 3, "pu_positive": 2, "pn_negative": 1}
    parts = F.flatten(F.array(*[F.transform(lists[n], _state(code[n])) for n in code]))
    long = rows.select(*keep, F.explode(parts).alias("x")).select(*keep, F.col("x.i").alias("label_idx"), F.col("x.c").alias("c"))
    best = long.groupBy(*keep, "label_idx").agg(F.max("c").alias("c"))
    out = best.select(*keep, "label_idx", (F.col("c") >= 2).cast("int").alias("label"), F.col("c").isin(3, 1).cast("int").alias("known"), (F.col("c") == 2).cast("int").alias("pu"))
    return out.join(dimension(dim.withColumnRenamed("idx", "label_idx")), "label_idx")


def _state(code: int):
    return lambda i: F.struct(i.alias("i"), F.lit(code).alias("c"))


def illegal(cells: DataFrame) -> DataFrame:
    """Cells that break the supervision rules, with every rule they break."""
    rules = {
        "masks_overlap": (F.col("known") == 1) & (F.col("pu") == 1),
        "known_outside_pn": (F.col("known") == 1) & (F.col("mode") != "pn"),
        "pu_outside_pu": (F.col("pu") == 1) & (F.col("mode") != "pu"),
        "pu_without_label": (F.col("pu") == 1) & (F.col("label") != 1),
        "unknown_not_neutral": (F.col("known") == 0) & (F.col("pu") == 0) & (F.col("label") != 0),
        "unsupported_supervised": (F.col("mode") == "unsupported") & ((F.col("known") == 1) | (F.col("pu") == 1) | (F.col("label") == 1)),
        "not_binary": ~(F.col("label").isin(0, 1) & F.col("known").isin(0, 1) & F.col("pu").isin(0, 1)),
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return cells.withColumn("rule", F.explode(broken))
