"""Streaming twins of the monitor: keyed state through ``applyInPandasWithState``, an idempotent sink, resumable slices."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tagloom.operators.monitor import micros
from tagloom.session import file_system


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A file stream over a folder, or over one file, so many files per micro-batch."""
    fs, p = file_system(spark, path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if fs.getFileStatus(p).isFile():  # the source lists folders only
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def stream_delta(events: DataFrame, key: str, ts: str, counter: str, idle_seconds: float = 86_400.0) -> DataFrame:
    """(key, us, percent): the rate against the key's previous sample; a key that stays away for so long, by the stream's own time, is forgotten."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), micros(F.col(ts)).alias("us"), F.col(counter).cast("double").alias("c")).withWatermark("ts", "0 seconds")

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            last = state.get if state.exists else None
            for t, c in sorted((t, c) for b in batches for t, c in zip(b.us.tolist(), b.c.tolist())):
                if last is not None:
                    dt = (t - last[0]) / 1e6
                    out.append((k[0], t, max(0.0, (c - last[1]) / dt * 100) if dt > 0 else 0.0))
                last = (t, c)
            state.update(last)
            state.setTimeoutTimestamp(max(int(last[0] // 1000 + idle_seconds * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "us", "percent"])

    return rows.groupBy("key").applyInPandasWithState(step, "key string, us bigint, percent double", "us bigint, c double", "append", GroupStateTimeout.EventTimeTimeout)


def stream_breaches(events: DataFrame, key: str, ts: str, value: str, limit: float, least: int = 2) -> DataFrame:
    """(key, us, run): samples from the ``least``-th above the limit in a row on."""
    rows = events.select(F.col(key).cast("string").alias("key"), micros(F.col(ts)).alias("us"), F.col(value).cast("double").alias("v"))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        out = []
        for t, v in sorted((t, v) for b in batches for t, v in zip(b.us.tolist(), b.v.tolist())):
            run = run + 1 if v > limit else 0
            if run >= least:
                out.append((k[0], t, run))
        state.update((run,))
        yield pd.DataFrame(out, columns=["key", "us", "run"])

    return rows.groupBy("key").applyInPandasWithState(step, "key string, us bigint, run bigint", "run bigint", "append", GroupStateTimeout.NoTimeout)


def stream_cooldown(events: DataFrame, key: str, ts: str, seconds: float = 600.0) -> DataFrame:
    """(key, us): events that fire, at least ``seconds`` after the last that fired."""
    rows = events.select(F.col(key).cast("string").alias("key"), micros(F.col(ts)).alias("us"))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(t for b in batches for t in b.us.tolist()):
            if last is None or t - last >= seconds * 1e6:
                out.append((k[0], t))
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["key", "us"])

    return rows.groupBy("key").applyInPandasWithState(step, "key string, us bigint", "us bigint", "append", GroupStateTimeout.NoTimeout)


def stream_heartbeats(events: DataFrame, key: str, ts: str, timeout: float) -> DataFrame:
    """(key, us): beats after which the next one came too late (or, at the end of the stream's time, none came)."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), micros(F.col(ts)).alias("us")).withWatermark("ts", "0 seconds")

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        if state.hasTimedOut:
            if last is not None:
                out.append((k[0], last))
            state.remove()
        else:
            for t in sorted(t for b in batches for t in b.us.tolist()):
                if last is not None and t - last >= timeout * 1e6:
                    out.append((k[0], last))
                last = t if last is None else max(last, t)
            state.update((last,))
            state.setTimeoutTimestamp(max(int(last // 1000 + timeout * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "us"])

    return rows.groupBy("key").applyInPandasWithState(step, "key string, us bigint", "us bigint", "append", GroupStateTimeout.EventTimeTimeout)


def run_slice(df: DataFrame, path: str, checkpoint: str, key: list[str] | None = None) -> None:
    """Works off what is there and stops; the checkpoint makes the next slice go on where this one ended.

    The file sink commits each micro-batch once.  With ``key`` repeated rows are
    dropped across slices.
    """
    out = df.dropDuplicates(key) if key else df
    q = out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def latest_snapshot(df: DataFrame, path: str, checkpoint: str, key: str, order: str) -> None:
    """Per micro-batch the newest row per key, in a folder named by the batch, so a repeated batch replaces itself."""

    def put(batch: DataFrame, n: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("r")).select(key, "r.*")
        newest.write.mode("overwrite").parquet(f"{path}/batch={n}")

    df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
