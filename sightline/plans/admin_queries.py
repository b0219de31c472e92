"""Operational metrics over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admin
from .common import ACCOUNTS_SQL, AS_OF, DIAGNOSES_SQL, accounts, businesses, diagnoses, table

DAY = "strftime({}, '%Y-%m-%d')"


def kpi_summary(spark, d):
    return admin.kpi_summary(accounts(spark, d), diagnoses(spark, d), AS_OF)


def daily_trend(spark, d):
    return admin.daily_trend(accounts(spark, d), diagnoses(spark, d), AS_OF, 30)


def funnel(spark, d):
    return admin.funnel(accounts(spark, d), diagnoses(spark, d))


def recent_accounts(spark, d):
    return admin.recent_accounts(accounts(spark, d)).select("id", "plan", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


def failed_jobs(spark, d):
    out = admin.recent_diagnoses(diagnoses(spark, d), businesses(spark, d), 20, admin.UNSUCCESSFUL)
    return out.select("id", "business_name", "status", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def member_list(spark, d):
    return admin.list_members(accounts(spark, d), q="customer", status="active", limit=50, offset=10).select("id", "email", "plan", "status")


def latest_diagnosis(spark, d):
    out = admin.latest_diagnosis(businesses(spark, d), diagnoses(spark, d))
    return out.select("id", "name", "latest_status", F.date_format("latest_at", "yyyy-MM-dd HH:mm:ss").alias("latest_at"))


def active_diagnosis(spark, d):
    return admin.active_diagnosis(diagnoses(spark, d))


def status_tally(spark, d):
    return admin.tally(diagnoses(spark, d))


def channel_lights(spark, d):
    e = table(spark, d, "events")
    rows = e.select((F.col("user_id") % 50).alias("site_id"), F.col("event_type").alias("channel"), F.when(F.col("value") >= 99.5, "high").otherwise("low").alias("priority")).where(F.col("channel") != "view")
    return admin.channel_signal(rows)


def subscription_upsert(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_custkey").alias("business_id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
    return admin.upsert(rows.where("version % 2 = 0").groupBy("business_id").agg(F.max_by("status", "version").alias("status"), F.max("version").alias("version")), rows.where("version % 2 = 1"), "business_id", "version")


def cost_by_day(spark, d):
    e = table(spark, d, "events")
    calls = e.select(F.col("event_type").alias("provider"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 1000).alias("tokens_in"), (F.col("user_id") % 500).alias("tokens_out"))
    prices = spark.createDataFrame([("m0", 0.25, 0.5), ("m1", 0.5, 1.0), ("m2", 1.0, 2.0)], "model string, usd_in double, usd_out double")
    out = admin.cost_by_day(calls, prices)
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "provider", F.floor(F.col("usd") * 1000 + 0.4).cast("long").alias("milli_usd"), "calls")


QUERIES = {f.__name__: f for f in (kpi_summary, daily_trend, funnel, recent_accounts, failed_jobs, member_list, latest_diagnosis, active_diagnosis, status_tally, channel_lights, subscription_upsert, cost_by_day)}

ORACLE_SQL = {
    "kpi_summary": f"""WITH {ACCOUNTS_SQL}, {DIAGNOSES_SQL}, t AS (SELECT TIMESTAMP '{AS_OF}' AS now),
      a AS (SELECT count(*) AS total_accounts, count(*) FILTER (created_at >= date_trunc('day', now)) AS accounts_today, count(*) FILTER (created_at >= now - INTERVAL 7 DAY) AS accounts_7d, count(*) FILTER (plan <> 'free') AS paid_accounts FROM accounts, t),
      b AS (SELECT count(*) AS total_diagnoses, count(*) FILTER (created_at >= date_trunc('day', now)) AS diagnoses_today, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('queued', 'running') AND created_at < now - INTERVAL 10 MINUTE) AS stuck_jobs FROM diagnoses, t)
      SELECT *, paid_accounts / total_accounts AS conversion_rate FROM a, b""",
    "daily_trend": f"""WITH {ACCOUNTS_SQL}, {DIAGNOSES_SQL}, spine AS (SELECT strftime(DATE '1998-05-03' + CAST(i AS INT), '%Y-%m-%d') AS date FROM range(30) r(i))
      SELECT date, (SELECT count(*) FROM accounts WHERE strftime(created_at, '%Y-%m-%d') = date) AS signups, (SELECT count(*) FROM diagnoses WHERE strftime(created_at, '%Y-%m-%d') = date) AS diagnoses FROM spine""",
    "funnel": f"""WITH {ACCOUNTS_SQL}, {DIAGNOSES_SQL} SELECT (SELECT count(*) FROM accounts) AS signups, (SELECT count(DISTINCT business_id) FROM diagnoses) AS diagnosed, (SELECT count(DISTINCT business_id) FROM diagnoses WHERE status = 'completed') AS completed, (SELECT count(*) FROM accounts WHERE plan <> 'free') AS paid""",
    "recent_accounts": f"WITH {ACCOUNTS_SQL} SELECT id, plan, strftime(created_at, '%Y-%m-%d') AS day FROM accounts ORDER BY created_at DESC, id LIMIT 20",
    "failed_jobs": f"WITH {DIAGNOSES_SQL} SELECT id, c_name AS business_name, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS at FROM diagnoses LEFT JOIN customer ON business_id = c_custkey WHERE status IN ('failed', 'timeout', 'partial') ORDER BY created_at DESC, id LIMIT 20",
    "member_list": f"WITH {ACCOUNTS_SQL} SELECT id, email, plan, 'active' AS status FROM accounts WHERE email ILIKE '%customer%' AND c_acctbal >= 0 AND c_custkey % 11 <> 0 ORDER BY created_at DESC, id LIMIT 50 OFFSET 10",
    "latest_diagnosis": f"WITH {DIAGNOSES_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY created_at DESC, id DESC) AS k FROM diagnoses) SELECT c_custkey AS id, c_name AS name, status AS latest_status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS latest_at FROM customer LEFT JOIN l ON business_id = c_custkey AND k = 1",
    "active_diagnosis": f"WITH {DIAGNOSES_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY created_at DESC, id DESC) AS k FROM diagnoses WHERE status IN ('queued', 'running')) SELECT business_id, id FROM l WHERE k = 1",
    "status_tally": f"WITH {DIAGNOSES_SQL} SELECT count(*) AS processed, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed FROM diagnoses",
    "channel_lights": """WITH g AS (SELECT user_id % 50 AS site_id, event_type AS channel, count(*) AS rows, count(*) FILTER (value >= 99.5) AS high FROM events WHERE event_type <> 'view' GROUP BY 1, 2)
      SELECT site_id, channel, rows, high, CASE WHEN high = 0 AND rows <= 2 THEN 'green' WHEN high <= 2 THEN 'yellow' ELSE 'red' END AS light FROM g""",
    "subscription_upsert": "SELECT o_custkey AS business_id, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1",
    "cost_by_day": """WITH c AS (SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, event_type AS provider, event_id % 1000 AS i, user_id % 500 AS o, user_id % 4 AS m FROM events)
      SELECT day, provider, CAST(floor(sum(CASE m WHEN 0 THEN i * 0.25 / 1000 + o * 0.5 / 1000 WHEN 1 THEN i * 0.5 / 1000 + o * 1.0 / 1000 WHEN 2 THEN i / 1000.0 + o * 2.0 / 1000 ELSE 0 END) * 1000 + 0.4) AS BIGINT) AS milli_usd, count(*) AS calls FROM c GROUP BY 1, 2""",
}
