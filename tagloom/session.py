"""Session construction and the shared scratch folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "tagloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC, AQE and the RocksDB state store; settings already present win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    spark = b.config(map=conf).getOrCreate()
    spark.streams.active  # touches the stream manager, so state stores can be used by batch plans too
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``.  Only where
    that is unset, as in tests, it is a folder below the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tagloom_scratch"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system that serves a path, and the path as it names it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Scratch:
    """Tables written below the shared folder; they survive the loss of executors.

    ``keep`` writes a DataFrame as Parquet and reads it back, which cuts the
    lineage.  ``drop`` removes a table that is no longer needed; what is left
    goes when the session's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self.close)

    def folder(self, name: str) -> str:
        """A path below the table's folder, which goes with it."""
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}_{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tagloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_tagloom_path", None)
        if path:
            fs, p = file_system(self.spark, path)
            fs.delete(p, True)

    def close(self) -> None:
        try:
            fs, p = file_system(self.spark, self.root)
            fs.delete(p, True)
        except Exception:  # the session may already be gone
            pass


def dimension(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A small side of a join: broadcast if it has at most so many rows, which is counted first; a larger one is joined as any other table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
