"""Writers for data sets (distributed) and for small reports (driver, replaced as a whole); paths are those that Spark reads."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import file_system
from tagloom.sources.readers import inventory


def split_json(df: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines in a folder per split; refuses to overwrite."""
    df.write.mode("errorifexists").partitionBy(split).json(path)


def flat_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON text."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns]).write.mode("errorifexists").option("header", True).csv(path)


def write_lines(lines: Iterable[str], path: str, spark: SparkSession | None = None) -> int:
    """Replaces a file on any store as a whole: written and closed beside it, then renamed over it; returns the number of lines."""
    spark = spark or SparkSession.active()
    fs, target = file_system(spark, path)
    jvm, n = spark.sparkContext._jvm, 0
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:12]}.part")
    try:
        out = fs.create(beside, True)
        try:
            for line in lines:
                out.write(line.encode())
                n += 1
            out.hsync()
        finally:
            out.close()
        over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, target, over)
    finally:
        fs.delete(beside, False)
    return n


def atomic_text(text: str, path: str, spark: SparkSession | None = None) -> None:
    write_lines([text], path, spark)


def atomic_json(value: object, path: str, spark: SparkSession | None = None) -> None:
    atomic_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", path, spark)


def checksums(df_root: str, spark: SparkSession, path: str) -> int:
    """Writes ``digest  path`` lines, sorted by path, for every file below a folder; returns their number.

    Sorted on the executors; the lines pass through the driver one part at a time.
    """
    rows = inventory(spark, df_root).orderBy("path").select(F.format_string("%s  %s\n", "sha256", "path").alias("line"))
    return write_lines((r.line for r in rows.toLocalIterator()), path, spark)


def publish(candidate: str, target: str, spark: SparkSession | None = None) -> None:
    """Renames a finished folder to its place; refuses to replace one."""
    spark = spark or SparkSession.active()
    fs, there = file_system(spark, target)
    if fs.exists(there):
        raise FileExistsError(target)
    if not fs.rename(file_system(spark, candidate)[1], there):
        raise OSError(f"{candidate} could not be renamed to {target}")


def keep_newest(folder: str, keep: int = 3, spark: SparkSession | None = None) -> list[str]:
    """Removes all but the ``keep`` last entries of a folder by name; returns what was removed."""
    spark = spark or SparkSession.active()
    fs, p = file_system(spark, folder)
    names = sorted(x.getPath().getName() for x in fs.listStatus(p))
    gone = names[: max(0, len(names) - keep)]
    for n in gone:
        fs.delete(file_system(spark, f"{folder}/{n}")[1], True)
    return gone
