"""Batch forms of the monitor: rates, sustained breaches, ranking, cooldown, heartbeats, decisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tagloom.operators.ranked import values_at, wide_bucket


def micros(ts: Column) -> Column:
    """Microseconds of an instant, with or without a zone (then UTC by the session)."""
    return F.unix_micros(ts.cast("timestamp"))


def delta_percent(samples: DataFrame, key: str, ts: str, counter: str) -> DataFrame:
    """Adds ``elapsed`` seconds and ``percent`` = max(0, change of the counter per second * 100); 0 without elapsed time, NULL for a key's first sample.

    Repeated instants of a key are ordered by the counter.
    """
    w = Window.partitionBy(key).orderBy(ts, counter)
    us = micros(F.col(ts))
    dt = (us - F.lag(us).over(w)) / F.lit(1e6)
    dc = F.col(counter) - F.lag(counter).over(w)
    return samples.withColumn("elapsed", dt).withColumn("percent", F.when(dt.isNull(), None).when(dt <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), dc / F.nullif(dt, F.lit(0.0)) * 100)))


def breach_runs(samples: DataFrame, key: str, order: list[str], value: str, limit: float, least: int = 2) -> DataFrame:
    """Adds ``run``, the number of samples above the limit in a row up to here, and ``sustained`` from ``least`` on."""
    w = Window.partitionBy(key).orderBy(*order)
    high = F.coalesce(F.col(value) > limit, F.lit(False))
    island = samples.withColumn("_hi", high).withColumn("_g", F.sum(F.when(F.col("_hi"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum(F.col("_hi").cast("int")).over(Window.partitionBy(key, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return island.withColumn("run", F.when(F.col("_hi"), run).otherwise(0).cast("bigint")).withColumn("sustained", F.col("run") >= least).drop("_hi", "_g")


def top_k(rows: DataFrame, value: str, tie: str, k: int = 7) -> DataFrame:
    """The k largest values; of equals the least ``tie`` first."""
    return rows.orderBy(F.col(value).desc(), tie).limit(k)


def cooldown(events: DataFrame, key: str, ts: str, wanted: Column, seconds: float = 600.0) -> DataFrame:
    """Events that fire: wanted, and at least ``seconds`` after the last one of the key that fired.

    Whether an event fires depends on the one that fired before, which no window
    function expresses, so each key is scanned in time order, in Arrow batches
    with one instant of state; a key of any size streams through its task.
    """
    cand = events.where(wanted & F.col(ts).isNotNull()).withColumn("_us", micros(F.col(ts)))
    names = cand.columns

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, gap = None, None, int(seconds * 1e6)
        for b in batches:
            keep = []
            for k, t in zip(b[key].tolist(), b["_us"].tolist()):
                if last is None or k != now or t - last >= gap:
                    now, last = k, t
                    keep.append(True)
                else:
                    keep.append(False)
            yield b.loc[keep, names]

    return cand.repartition(key).sortWithinPartitions(key, "_us").mapInPandas(scan, cand.schema).drop("_us")


def heartbeat_gaps(beats: DataFrame, key: str, ts: str, timeout: float) -> DataFrame:
    """(key, last beat, expired_at): every beat after which none came within the timeout, the last beat of a key included."""
    w = Window.partitionBy(key).orderBy(ts)
    nxt = F.lead(ts).over(w)
    gap = (micros(nxt) - micros(F.col(ts))) / F.lit(1e6)
    return beats.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= timeout)).select(key, F.col(ts).alias("last_beat"), (F.col(ts) + F.make_dt_interval(secs=F.lit(float(timeout)))).alias("expired_at"))


def decide(snapshots: DataFrame, key: str, order: list[str], policy: Column, on_ac: Column, battery: Column, thermal: Column) -> DataFrame:
    """Adds ``decision`` of the ladder: leave when critical or unplugged against the policy, warn once per key for heat and once for a low battery."""
    leave = F.when(thermal == "critical", "exit:thermal_critical").when(~on_ac & (battery <= 10), "exit:critical_battery").when((policy == "ac_only") & ~on_ac, "exit:power_disconnected")
    base = snapshots.withColumn("_x", leave)
    hot = F.col("_x").isNull() & (thermal == "serious")
    w = Window.partitionBy(key).orderBy(*order)
    base = base.withColumn("_hot", hot).withColumn("_hot1", hot & (F.sum(hot.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1))
    low = F.col("_x").isNull() & ~F.col("_hot1") & ~on_ac & (battery <= 20)
    base = base.withColumn("_low1", low & (F.sum(low.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1))
    return base.withColumn("decision", F.coalesce("_x", F.when(F.col("_hot1"), "warn:thermal_serious").when(F.col("_low1"), "warn:low_battery"), F.lit("none"))).drop("_x", "_hot", "_hot1", "_low1")


def interval_seconds(visible: Column, thermal: Column) -> Column:
    return F.when(~visible & (thermal == "nominal"), 20).otherwise(10)


def prefix_rollup(paths: DataFrame, path: str, value: str, bundles: DataFrame, bundle: str) -> DataFrame:
    """(bundle, n, total): rows whose path is the bundle or lies below it.

    A path is looked up by its own prefixes (one per separator), so this is an
    equality join instead of a comparison of every path with every bundle.  A
    bundle without rows has n = 0.
    """
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    long = paths.where(F.col(path).isNotNull()).select(F.explode(F.array_distinct(prefixes)).alias("_p"), F.col(value).alias("_v"))
    per = long.groupBy("_p").agg(F.count("*").alias("n"), F.sum("_v").alias("total"))  # before the join, so a hot prefix is one row
    own = bundles.select(bundle).distinct().withColumn("_p", F.regexp_replace(bundle, "/+$", ""))
    return own.join(per, "_p", "left").select(bundle, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def step_timing(steps: DataFrame, order: str, seconds: str, skip: int = 2) -> DataFrame:
    """Mean without the first steps, the nearest-rank 95th percentile and the number of steps."""
    kept = steps.where(F.col(order) >= skip)
    mean = kept.agg(F.count("*").alias("steps"), F.avg(seconds).alias("mean_seconds"))
    pts = kept.where(F.col(seconds).isNotNull()).groupBy(F.lit(1).alias("_g"), F.col(seconds).cast("double").alias("_s")).agg(F.count("*").alias("_n"))
    rank = values_at(pts, ["_g"], "_s", "_n", {"p95_seconds": F.ceil(F.col("total") * F.lit(0.95)) - 1}, wide_bucket(F.col("_s")))
    return mean.join(rank.select("p95_seconds"), F.lit(True), "left")  # one row each


# Titles of the thermal states, in Chinese and English.
THERMAL_TITLES = {
    "zh": {"nominal": "正常", "fair": "偏热", "serious": "严重", "critical": "危急"},
    "en": {"nominal": "Normal", "fair": "Elevated", "serious": "Serious", "critical": "Critical"},
}


def thermal_title(state: Column, language: str = "zh") -> Column:
    """Title of a thermal state; NULL for an unknown one."""
    titles = THERMAL_TITLES[language]
    return F.try_element_at(F.create_map(*[F.lit(x) for p in titles.items() for x in p]), state)


def severity(state: Column) -> Column:
    """0 for nominal up to 3 for critical; NULL for an unknown state."""
    return F.nullif(F.array_position(F.array(*map(F.lit, THERMAL_TITLES["en"])), state), F.lit(0)) - 1


def display_mode(thermal: Column, applications: Column) -> Column:
    return F.when(thermal & applications, "full").when(thermal, "thermal_only").when(applications, "applications_only").otherwise("hidden")


def visible(regular: Column, bundle: Column, process: Column, own: int) -> Column:
    """Is an application shown: a regular one, with a bundle, and not the monitor itself?"""
    return F.coalesce(regular & bundle.isNotNull() & (process != own), F.lit(False))


def may_terminate(bundle: Column, protected: list[str]) -> Column:
    """An application may be ended unless it is protected or has no bundle."""
    return F.coalesce(~bundle.isin(*protected), F.lit(False))


def keep_live(states: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """States of keys that are still there; the others are purged."""
    return states.join(live.select(key).distinct(), key, "left_semi")


def pick_sampled(ranked: DataFrame, sampled: DataFrame, key: str) -> DataFrame:
    """The sampled rows behind a ranking, with its rank columns."""
    extra = [c for c in ranked.columns if c != key and c not in sampled.columns]
    return sampled.join(ranked.select(key, *extra), key)
