"""The monitor's operators over ``events``, and their streaming twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tagloom.functions import render
from tagloom.operators import monitor
from tagloom.session import Scratch, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _counter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("cpu", F.sum(F.round(F.col("value") * 100).cast("bigint")).over(w).cast("double"))


_COUNTER = "cn AS (SELECT event_id, user_id, ts, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS cpu FROM events)"


@query(f"""WITH {_COUNTER}, l AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS dt, cpu - lag(cpu) OVER w AS dc FROM cn WINDOW w AS (PARTITION BY user_id ORDER BY ts, cpu))
 SELECT event_id, user_id, round(CASE WHEN dt IS NULL THEN NULL WHEN dt <= 0 THEN 0 ELSE greatest(0, dc / nullif(dt, 0) * 100) END, 4) AS percent FROM l""")
def cpu_delta_percent(spark: SparkSession, d: str) -> DataFrame:
    return monitor.delta_percent(_counter(spark, d), "user_id", "ts", "cpu").select("event_id", "user_id", F.round("percent", 4).alias("percent"))


_RUNS = """r AS (SELECT *, count(*) FILTER (NOT coalesce(value > 80, false)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
 q AS (SELECT *, count(*) FILTER (coalesce(value > 80, false)) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS run FROM r)"""


@query(f"WITH {_RUNS} SELECT event_id, user_id, CASE WHEN value > 80 THEN run ELSE 0 END AS run, CASE WHEN value > 80 THEN run ELSE 0 END >= 2 AS sustained FROM q")
def sustained_high(spark: SparkSession, d: str) -> DataFrame:
    return monitor.breach_runs(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 80.0).select("event_id", "user_id", "run", "sustained")


@query("SELECT user_id, round(sum(value), 6) AS total FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
def top7_users(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("total"))
    return monitor.top_k(t, "total", "user_id", 7)


@query("""WITH RECURSIVE c AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type = 'error'),
 s AS (SELECT user_id, r, ts AS last, event_id, true AS fired FROM c WHERE r = 1 UNION ALL SELECT c.user_id, c.r, CASE WHEN epoch_us(c.ts) - epoch_us(s.last) >= 600000000 THEN c.ts ELSE s.last END, c.event_id, epoch_us(c.ts) - epoch_us(s.last) >= 600000000 FROM s JOIN c ON c.user_id = s.user_id AND c.r = s.r + 1)
 SELECT user_id, event_id FROM s WHERE fired""")
def notification_gate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return monitor.cooldown(e, "user_id", "ts", F.col("event_type") == "error", 600.0).select("user_id", "event_id")


@query("""WITH l AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events) SELECT user_id, ts AS last_beat, ts + INTERVAL 6 HOUR AS expired_at FROM l WHERE nx IS NULL OR epoch_us(nx) - epoch_us(ts) >= 21600000000""")
def heartbeat_timeouts(spark: SparkSession, d: str) -> DataFrame:
    return monitor.heartbeat_gaps(table(spark, d, "events"), "user_id", "ts", 21600.0)


_SNAP = "s AS (SELECT *, CASE WHEN value > 97 THEN 'critical' WHEN value > 80 THEN 'serious' ELSE 'nominal' END AS th, event_id % 3 <> 0 AS ac, CAST(event_id % 100 AS INT) AS bat, CASE WHEN user_id % 2 = 0 THEN 'ac_only' ELSE 'any' END AS pol FROM events)"


@query(f"""WITH {_SNAP}, x AS (SELECT *, CASE WHEN th = 'critical' THEN 'exit:thermal_critical' WHEN NOT ac AND bat <= 10 THEN 'exit:critical_battery' WHEN pol = 'ac_only' AND NOT ac THEN 'exit:power_disconnected' END AS ex FROM s),
 h AS (SELECT *, ex IS NULL AND th = 'serious' AS hot, count(*) FILTER (ex IS NULL AND th = 'serious') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS hn FROM x),
 l AS (SELECT *, ex IS NULL AND NOT (hot AND hn = 1) AND NOT ac AND bat <= 20 AS low FROM h), m AS (SELECT *, count(*) FILTER (low) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ln FROM l)
 SELECT event_id, coalesce(ex, CASE WHEN hot AND hn = 1 THEN 'warn:thermal_serious' WHEN low AND ln = 1 THEN 'warn:low_battery' END, 'none') AS decision FROM m""")
def safety_ladder(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    v = F.col("value")
    return monitor.decide(e, "user_id", ["ts", "event_id"], F.when(F.col("user_id") % 2 == 0, "ac_only").otherwise("any"), F.col("event_id") % 3 != 0, (F.col("event_id") % 100).cast("int"), F.when(v > 97, "critical").when(v > 80, "serious").otherwise("nominal")).select("event_id", "decision")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 AND value <= 80 THEN 20 ELSE 10 END AS interval_s,
 CASE WHEN value < 10 THEN printf('%.1f', value) ELSE printf('%.0f', value) END || '% CPU' AS cpu_text,
 CASE WHEN event_id >= 3600 THEN lpad(CAST(event_id // 3600 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST(event_id % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS duration,
 CASE WHEN (event_id % 7 + 1) / (event_id % 5 + 1.0) < 0.8 THEN 'portrait' WHEN (event_id % 7 + 1) / (event_id % 5 + 1.0) > 1.25 THEN 'landscape' ELSE 'square' END AS aspect FROM events""")
def display_texts(spark: SparkSession, d: str) -> DataFrame:
    e, i = table(spark, d, "events"), F.col("event_id")
    return e.select("event_id", monitor.interval_seconds(i % 2 != 0, F.when(F.col("value") <= 80, "nominal").otherwise("serious")).alias("interval_s"), render.cpu_text(F.col("value")).alias("cpu_text"), render.duration_text(i).alias("duration"), render.aspect_bucket(i % 7 + 1, i % 5 + 1).alias("aspect"))


@query("""WITH p AS (SELECT p_partkey, replace(p_type, ' ', '/') || '/' || p_name AS path, p_retailprice AS v FROM part), b AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS bundle FROM part UNION SELECT DISTINCT replace(p_type, ' ', '/') FROM part UNION SELECT 'nothing/here')
 SELECT bundle, count(path) AS n, round(coalesce(sum(v), 0), 4) AS total FROM b LEFT JOIN p ON p.path = b.bundle OR starts_with(p.path, b.bundle || '/') GROUP BY 1""")
def prefix_rollup(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    paths = p.select(F.concat(F.translate("p_type", " ", "/"), F.lit("/"), "p_name").alias("path"), "p_retailprice")
    b = p.select(F.substring_index("p_type", " ", 1).alias("bundle")).unionByName(p.select(F.translate("p_type", " ", "/").alias("bundle"))).unionByName(spark.createDataFrame([("nothing/here",)], "bundle string"))
    return monitor.prefix_rollup(paths, "path", "p_retailprice", b, "bundle").withColumn("total", F.round("total", 4))


@query("SELECT count(*) AS steps, round(avg(value), 9) AS mean_seconds, quantile_disc(value, 0.95) AS p95_seconds FROM events WHERE event_id >= 2")
def step_timing(spark: SparkSession, d: str) -> DataFrame:
    return monitor.step_timing(table(spark, d, "events"), "event_id", "value").withColumn("mean_seconds", F.round("mean_seconds", 9))


_HOURS = [("ip", 2024, 24, 64.0, 6.4), ("ip", 2025, 36, 64.0, 5.8), ("ip", 2026, 48, 64.0, 5.1), ("furniture", 2024, 18, 96.0, 9.6), ("furniture", 2025, 27, 96.0, 8.6), ("furniture", 2026, 36, 96.0, 7.7)]


@query("SELECT kind, year, round(n * (before - after), 6) AS saved, round((before - after) / before * 100, 6) AS cut FROM (VALUES " + ", ".join(f"('{k}', {y}, {n}, {a}::DOUBLE, {b}::DOUBLE)" for k, y, n, a, b in _HOURS) + ") v(kind, year, n, before, after)")
def hours_saved(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame(_HOURS, "kind string, year int, n int, before double, after double")
    return t.select("kind", "year", F.round(F.col("n") * (F.col("before") - F.col("after")), 6).alias("saved"), F.round(render.percent_change(F.col("before"), F.col("after")), 6).alias("cut"))


def _stream(spark: SparkSession, d: str, build) -> DataFrame:
    """Events as a file stream worked off in one slice; the result is the sink's table."""
    from tagloom.streaming import monitor as M

    scratch = Scratch(spark, "stream")
    given = table(spark, d, "events")
    out = build(M, M.read_events(spark, f"{d}/events.parquet", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)))
    M.run_slice(out, scratch.folder("out"), scratch.folder("checkpoint"))
    return spark.read.schema(out.schema).parquet(scratch.folder("out"))


@query(f"WITH {_RUNS} SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS us, run FROM q WHERE value > 80 AND run >= 2")
def stream_sustained_high(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d, lambda M, e: M.stream_breaches(e, "user_id", "ts", "value", 80.0))


@query(SQL["notification_gate"].replace("SELECT user_id, event_id FROM s WHERE fired", "SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(last) AS us FROM s WHERE fired"))
def stream_notification_gate(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d, lambda M, e: M.stream_cooldown(e.where("event_type = 'error'"), "user_id", "ts"))


@query("""WITH l AS (SELECT user_id, event_id, ts, value, lag(epoch_us(ts)) OVER w AS pu, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value))
 SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS us, round(CASE WHEN epoch_us(ts) > pu THEN greatest(0, (value - pv) / ((epoch_us(ts) - pu) / 1e6) * 100) ELSE 0 END, 4) AS percent FROM l WHERE pu IS NOT NULL""")
def stream_delta_percent(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d, lambda M, e: M.stream_delta(e, "user_id", "ts", "value")).withColumn("percent", F.round("percent", 4))


@query("""WITH l AS (SELECT user_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events)
 SELECT CAST(user_id AS VARCHAR) AS key, us FROM l WHERE nx - us >= 21600000000 OR (nx IS NULL AND us // 1000 + 21600000 < (SELECT max(us) // 1000 FROM l))""")
def stream_heartbeats(spark: SparkSession, d: str) -> DataFrame:
    """Beats followed by none in time.  A key's last beat counts once the stream's own time has passed its timeout, so keys that are still within it at the end do not."""
    return _stream(spark, d, lambda M, e: M.stream_heartbeats(e, "user_id", "ts", 21600.0))

