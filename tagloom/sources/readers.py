"""Strict readers.  All of them are lazy and distributed unless they say otherwise."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StructType

from tagloom.functions.normalize import first_non_blank
from tagloom.operators.contracts import Constraint, ContractError, require
from tagloom.session import file_system


def json_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """One object per line; blank lines are skipped; a bad line fails the read in strict mode, else gives NULLs."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def json_lines_no_blanks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``json_lines``, but a blank line is an error as well."""
    lines = spark.read.text(path)
    n = lines.where("trim(value) = ''").limit(1).count()
    if n:
        raise ContractError(f"{path} has a blank line")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def line_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, value) of lines that hold no object of the schema, counted from 1 in each file; for diagnosis after a failed read."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value")
    bad = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull()
    # lines of one file are read in order; blocks are counted first, so only a block's lines meet in a task
    w = Window.partitionBy("file", "block").orderBy("i")
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = counts.withColumn("off", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return lines.withColumn("k", F.row_number().over(w)).where(bad & (F.trim("value") != "")).join(before, ["file", "block"]).select("file", (F.col("off") + F.col("k")).alias("line"), "value")


def json_object(path: str, spark: SparkSession | None = None) -> dict:
    """A small object on the driver."""
    r = (spark or SparkSession.active()).read.text(path, wholetext=True).first()
    value = json.loads(r.value if r else "null")
    if not isinstance(value, dict):
        raise ContractError(f"{path} holds no object")
    return value


# Names under which a field may come; the first with a value counts.
FIELD_NAMES = {
    "record_id": ("record_id", "id"),
    "image_path": ("image_path", "local_path", "path", "relative_path", "image"),
    "sha256": ("image_sha256", "sha256", "image_hash"),
    "phash64": ("phash64", "image_phash", "phash", "perceptual_hash"),
}


def canonical_fields(df: DataFrame) -> DataFrame:
    """Adds the canonical fields from whichever of their names are present; names of the originals are dropped."""
    have = set(df.columns)
    out = {c: first_non_blank(*[F.col(n).cast("string") for n in names if n in have]) if have & set(names) else F.lit(None).cast("string") for c, names in FIELD_NAMES.items()}
    rest = [c for c in df.columns if not any(c in names for names in FIELD_NAMES.values())]
    return df.select(*[v.alias(k) for k, v in out.items()], *rest)


def manifest(spark: SparkSession, path: str, schema: str, key: str, constraints: list[Constraint] | None = None, expected_sha256: str | None = None) -> DataFrame:
    """A locked manifest: file hash, constraints, unique keys and at least one row are checked before it is returned."""
    if expected_sha256 is not None:
        found = inventory(spark, path).limit(2).collect()
        if [r.sha256 for r in found] != [expected_sha256]:
            raise ContractError(f"{path} is not the locked file")
    df = json_lines(spark, path, schema)
    require(df, [Constraint("missing_key", F.col(key).isNull()), *(constraints or [])], key)
    stats = df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d")).first()
    if stats.n == 0 or stats.n != stats.d:
        raise ContractError(f"{path}: {stats.n} rows, {stats.d} keys")
    return df


def inventory(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path relative to the root, length, sha256) of every file below a folder, or of one file."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    fs, p = file_system(spark, root.rstrip("/"))
    base = fs.makeQualified(p).toString()
    # both sides are spelled by the store itself
    rel = F.when(F.col("path").startswith(base), F.substring("path", len(base) + 1, 1 << 30)).otherwise(F.col("path"))
    return r.load(root).select(F.when(rel == "", F.lit(p.getName())).otherwise(F.ltrim(rel, F.lit("/"))).alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def checksum_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of lines ``digest  path``; unsafe or malformed lines raise."""
    pat = r"^([0-9a-f]{64})  (.+)$"
    t = spark.read.text(path).where("value <> ''").select("value", F.regexp_extract("value", pat, 1).alias("sha256"), F.regexp_extract("value", pat, 2).alias("path"))
    bad = (F.col("sha256") == "") | F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)")
    require(t, [Constraint("bad_checksum_line", bad)], "value")
    return t.select("path", "sha256")


def shard_set(spark: SparkSession, folder: str, stem: str, schema: str) -> DataFrame:
    """Rows of ``stem.rankRR-of-WW.jsonl`` files with ``rank`` and ``world`` from the name; an incomplete set raises."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/{stem}.rank*-of-*.jsonl")
    pat = r"\.rank(\d+)-of-(\d+)\.jsonl$"
    name = F.col("_metadata.file_name")
    out = df.select("*", F.regexp_extract(name, pat, 1).cast("int").alias("rank"), F.regexp_extract(name, pat, 2).cast("int").alias("world"))
    fs, p = file_system(spark, f"{folder}/{stem}.rank*-of-*.jsonl")
    names = sorted(x.getPath().getName() for x in fs.globStatus(p))
    worlds = {int(n.rsplit("-of-", 1)[1][:-6]) for n in names}
    if len(worlds) != 1 or len(names) != worlds.pop():
        raise ContractError(f"{folder}: the shards of {stem} are not complete")
    return out


def sidecar_disagreements(shards: DataFrame, sidecars: DataFrame, key: str, position: str) -> DataFrame:
    """Shards whose sidecar does not agree with their rows: (rank, name, expected, actual).

    ``shards`` has ``rank`` and, from 0, the row's ``position`` in it; ``sidecars``
    (rank, durable_records, next_local_index, last_record_id, complete).  The
    cursor must stand right behind the rows, which must have no gap and no key
    twice; a sidecar or a shard alone is a disagreement.
    """
    has = shards.groupBy("rank").agg(F.count("*").alias("n"), (F.max(position) + 1).alias("next"), F.max_by(key, position).alias("last"), F.count_distinct(key).alias("keys"))
    j = sidecars.withColumn("told", F.lit(True)).join(has, "rank", "full")
    text = lambda c: F.col(c).cast("string")
    n = F.coalesce("n", F.lit(0))
    checks = [
        ("sidecar", F.lit("present"), F.when(F.col("told"), "present").otherwise("missing")),
        ("durable_records", text("durable_records"), n.cast("string")),
        ("next_local_index", text("next_local_index"), F.coalesce("next", F.lit(0)).cast("string")),
        ("last_record_id", text("last_record_id"), text("last")),
        ("distinct_keys", n.cast("string"), F.coalesce("keys", F.lit(0)).cast("string")),
        ("contiguous", n.cast("string"), F.coalesce("next", F.lit(0)).cast("string")),
        ("complete", F.lit("true"), text("complete")),
    ]
    long = j.select("rank", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), e.alias("expected"), a.alias("actual")) for c, e, a in checks])).alias("x"))
    return long.select("rank", "x.*").where(~F.col("expected").eqNullSafe(F.col("actual")))
