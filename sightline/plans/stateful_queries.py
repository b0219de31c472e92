"""Ordered folds over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.shared import scratch
from ..streaming import gates
from ..streaming import rate_limit as rl
from .common import table

DAY_MS = 86_400_000


def _events(spark, d):
    return _event_rows(spark, table(spark, d, "events"))


def _event_rows(spark, e):
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long") if spark.conf.get("spark.sql.session.timeZone") == "UTC" else F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01', CAST(ts AS TIMESTAMP_NTZ))")
    return e.select((F.col("user_id") % 100).cast("string").alias("key"), "event_id", ms.alias("at_ms"), "event_type")


def rate_limited(spark, d):
    out = rl.rate_limit(_events(spark, d), 2 * DAY_MS, 3)
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("events"), F.count_if("allowed").alias("allowed"), F.max("retry_after_ms").alias("longest_wait"))


def cost_gated(spark, d):
    e = _events(spark, d).withColumn("plan", F.when(F.col("event_type") == "purchase", "pro").otherwise("free"))
    return rl.cost_gate(e, 2, 20, 3_600_000).groupBy("reason").agg(F.count(F.lit(1)).alias("requests"))


def event_trend(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    return rl.event_trend(e, "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "events")


def _streamed(spark, d, gate):
    """The gate's rows for the event table read as a stream to its end; what it
    decides is written to the shared folder and read from there."""
    path, folder, key = f"{d}/events.parquet", scratch(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, gates.STORE)
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        source = spark.readStream.schema(spark.read.parquet(path).schema)
        # a stream's source is a folder: the table's own, or the one in which its file is
        one = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
        stream = source.option("pathGlobFilter", "events.parquet").parquet(d) if one else source.parquet(path)
        q = gate(_event_rows(spark, stream)).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(f"{folder}/out")


def cost_gated_stream(spark, d):
    x = _streamed(spark, d, lambda e: gates.stream_cost_gate(e.withColumn("plan", F.when(F.col("event_type") == "purchase", "pro").otherwise("free")), 2, 20, 3_600_000))
    return x.groupBy("reason").agg(F.count(F.lit(1)).alias("requests"))


def quota_guarded_stream(spark, d):
    """Event types as channels, two with a budget a day; a request takes one to
    three units."""
    budgets = spark.createDataFrame([("click", 9, 2), ("view", 1, 5)], "channel string, budget int, used int")
    x = _streamed(spark, d, lambda e: gates.stream_quota_guard(e.select(F.col("event_type").alias("channel"), "event_id", "at_ms", (F.col("event_id") % 3 + 1).alias("units")), budgets))
    return x.groupBy("channel").agg(F.count(F.lit(1)).alias("requests"), F.count_if("allowed").alias("allowed"), F.sum(F.when(F.col("allowed"), F.col("units"))).alias("units"), F.min("left").alias("least_left"))


QUERIES = {f.__name__: f for f in (rate_limited, cost_gated, event_trend, cost_gated_stream, quota_guarded_stream)}

ORACLE_SQL = {
    "rate_limited": """WITH RECURSIVE e AS (SELECT CAST(user_id % 100 AS VARCHAR) AS key, epoch_us(ts) // 1000 AS a, row_number() OVER (PARTITION BY user_id % 100 ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
      f AS (SELECT key, k, a, a AS s, 1 AS n, true AS ok, 0::BIGINT AS w FROM e WHERE k = 1
        UNION ALL SELECT e.key, e.k, e.a, CASE WHEN e.a - s >= 172800000 THEN e.a ELSE s END, CASE WHEN e.a - s >= 172800000 THEN 1 WHEN n >= 3 THEN n ELSE n + 1 END,
          e.a - s >= 172800000 OR n < 3, CASE WHEN e.a - s >= 172800000 OR n < 3 THEN 0 ELSE 172800000 - (e.a - s) END FROM f JOIN e ON e.key = f.key AND e.k = f.k + 1)
      SELECT key, count(*) AS events, count(*) FILTER (ok) AS allowed, max(w) AS longest_wait FROM f GROUP BY 1""",
    "cost_gated": """WITH RECURSIVE e AS (SELECT user_id % 100 AS key, epoch_us(ts) // 1000 AS a, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%Y-%m') AS m, CASE event_type WHEN 'purchase' THEN 4 ELSE 1 END AS x, row_number() OVER (PARTITION BY user_id % 100 ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
      f AS (SELECT key, k, d, m, a + 3600000 AS until, 1 AS n, 1 AS o, 'granted' AS reason FROM e WHERE k = 1
        UNION ALL SELECT key, k, d, m, CASE reason WHEN 'granted' THEN a + 3600000 ELSE until END, n + (reason = 'granted')::INT, o + (reason = 'granted')::INT, reason FROM
          (SELECT *, CASE WHEN until > a THEN 'cache_hit' WHEN n >= 2 * x THEN 'daily_quota_exceeded' WHEN o >= 20 * x THEN 'monthly_quota_exceeded' ELSE 'granted' END AS reason FROM
            (SELECT e.key, e.k, e.a, e.d, e.m, e.x, until, CASE WHEN e.d = f.d THEN n ELSE 0 END AS n, CASE WHEN e.m = f.m THEN o ELSE 0 END AS o FROM f JOIN e ON e.key = f.key AND e.k = f.k + 1)))
      SELECT reason, count(*) AS requests FROM f GROUP BY 1""",
    "event_trend": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2",
}
ORACLE_SQL["cost_gated_stream"] = ORACLE_SQL["cost_gated"]
ORACLE_SQL["quota_guarded_stream"] = """WITH RECURSIVE e AS (SELECT event_type AS c, strftime(ts, '%Y-%m-%d') AS d, event_id % 3 + 1 AS u, CASE event_type WHEN 'click' THEN 7 WHEN 'view' THEN 0 ELSE 1000000000 END AS free, row_number() OVER (PARTITION BY event_type, strftime(ts, '%Y-%m-%d') ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
  f AS (SELECT c, d, k, u, free, u <= free AS ok, CASE WHEN u <= free THEN u ELSE 0 END AS used FROM e WHERE k = 1
    UNION ALL SELECT e.c, e.d, e.k, e.u, e.free, used + e.u <= e.free, CASE WHEN used + e.u <= e.free THEN used + e.u ELSE used END FROM f JOIN e ON e.c = f.c AND e.d = f.d AND e.k = f.k + 1)
  SELECT c AS channel, count(*) AS requests, count(*) FILTER (ok) AS allowed, sum(u) FILTER (ok)::BIGINT AS units, min(CASE WHEN c IN ('click', 'view') THEN free - used END)::INT AS least_left FROM f GROUP BY 1"""
