"""From source rows to records: which field counts, what a label implies, and what a row must hold."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.contracts import Constraint


def as_list(c: Column, is_list: bool) -> Column:
    """A tag list of a field that holds one tag or a list; NULL is an empty list."""
    empty = F.array().cast("array<string>")
    return F.coalesce(c, empty) if is_list else F.when(c.isNull(), empty).otherwise(F.array(c.cast("string")))


def first_given(df: DataFrame, names: Sequence[str]) -> tuple[Column, Column]:
    """(name, tags) of the first of the fields that is not NULL; an empty list counts as given, fields that the table lacks do not."""
    have = [n for n in names if n in df.columns]
    kind = {f.name: f.dataType.typeName() == "array" for f in df.schema.fields}
    name, tags = F.lit(None).cast("string"), as_list(F.lit(None), False)
    for n in reversed(have):
        given = F.col(n).isNotNull()
        name, tags = F.when(given, F.lit(n)).otherwise(name), F.when(given, as_list(F.col(n), kind[n])).otherwise(tags)
    return name, tags


def exclusive_negatives(positives: Column, groups: Mapping[str, Sequence[int]]) -> Column:
    """Labels that are absent because another of their group is present, sorted; ``groups`` of a label dimension."""
    empty = F.array().cast("array<int>")
    own = F.coalesce(positives, empty)
    parts = [F.when(F.arrays_overlap(own, F.array(*map(F.lit, m))), F.array_except(F.array(*map(F.lit, m)), own)).otherwise(empty) for m in groups.values() if len(m) > 1]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*parts)))) if parts else empty


def fields_to_vector(fields: Sequence[Column], labels: Sequence[str], alias: Mapping[str, str] | None = None) -> Column:
    """Several tag lists -> one 0/1 vector in label order; written forms count through ``alias``."""
    empty = F.array().cast("array<string>")
    every = F.flatten(F.array(*[F.coalesce(f, empty) for f in fields]))
    names = {t: [t] for t in labels}
    for a, t in (alias or {}).items():
        if t in names and a not in names[t]:
            names[t].append(a)
    return F.array(*[F.arrays_overlap(every, F.array(*map(F.lit, names[t]))).cast("int") for t in labels])


def pad_vector(c: Column, width: int, fill: float = 0.0) -> Column:
    """A vector one short of the width gets ``fill`` at its end; any other stays as it is."""
    return F.when(F.size(c) == width - 1, F.concat(c, F.array(F.lit(fill)))).otherwise(c)


def with_computed(rows: DataFrame, path: str, columns: Sequence[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Fills columns that a row lacks from what ``compute`` gives for its path.

    ``compute`` gets the distinct paths of such rows, (path), and returns (path,
    columns), a row per path; it never sees a path twice.
    """
    lacks = F.lit(False)
    for c in columns:
        lacks = lacks | F.col(c).isNull()
    paths = rows.where(lacks & F.col(path).isNotNull()).select(F.col(path).alias("path")).distinct()
    got = compute(paths).select(F.col("path").alias("_path"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = rows.join(got, F.col(path) == F.col("_path"), "left")
    return joined.select(*[c for c in rows.columns if c not in columns], *[F.coalesce(F.col(c), F.col(f"_new_{c}")).alias(c) for c in columns])


def record_constraints(labels: str, known: str, pu: str, counts: Sequence[str], total: str, full_mask: tuple[Column, Sequence[int]] | None = None) -> list[Constraint]:
    """What a record must hold, as named rules.

    Labels and known mask come together; some label is supervised; binding counts
    are not negative and add up.  ``full_mask`` (which rows, mask): the source
    that judges a fixed set of labels must know exactly these, without claims
    beside them.
    """
    y, k, p = F.col(labels), F.col(known), F.col(pu)
    any_one = lambda c: F.exists(c, lambda x: x == 1)
    parts = sum((F.col(c) for c in counts[1:]), F.col(counts[0]))
    negative = F.lit(False)
    for c in (*counts, total):
        negative = negative | (F.col(c) < 0)
    rules = [
        Constraint("labels_without_mask", y.isNull() != k.isNull()),
        Constraint("no_supervision", ~F.coalesce(any_one(k), F.lit(False)) & ~F.coalesce(any_one(p), F.lit(False))),
        Constraint("negative_binding_count", negative),
        Constraint("binding_counts_do_not_add_up", parts != F.col(total)),
    ]
    if full_mask is not None:
        rows, mask = full_mask
        want = F.array(*map(F.lit, mask))
        stray = F.exists(F.arrays_zip(y.alias("y"), k.alias("k")), lambda x: (x["k"] == 0) & (x["y"] != 0))
        rules += [Constraint("mask_is_not_the_fixed_one", rows & (k != want)), Constraint("label_outside_mask", rows & stray), Constraint("claim_beside_fixed_mask", rows & any_one(p))]
    return rules
