"""Operational metrics over accounts, businesses and diagnoses.

accounts: id, plan, created_at, blocked_at, deleted_at.  businesses: id, name,
account_id.  diagnoses: id, business_id, status, created_at.  The time of the
report is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STUCK_MINUTES = 10
PENDING = ["queued", "running"]
UNSUCCESSFUL = ["failed", "timeout", "partial"]


def _at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def kpi_summary(accounts: DataFrame, diagnoses: DataFrame, as_of: str) -> DataFrame:
    """One row: one aggregate a table instead of a statement a number."""
    now = _at(as_of)
    today, week = F.date_trunc("day", now), now - F.expr("INTERVAL 7 DAYS")
    a = accounts.agg(
        F.count(F.lit(1)).alias("total_accounts"), F.count_if(F.col("created_at") >= today).alias("accounts_today"),
        F.count_if(F.col("created_at") >= week).alias("accounts_7d"), F.count_if(F.col("plan") != "free").alias("paid_accounts"),
    )
    stuck = F.col("status").isin(PENDING) & (F.col("created_at") < now - F.expr(f"INTERVAL {STUCK_MINUTES} MINUTES"))
    d = diagnoses.agg(
        F.count(F.lit(1)).alias("total_diagnoses"), F.count_if(F.col("created_at") >= today).alias("diagnoses_today"),
        F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(stuck).alias("stuck_jobs"),
    )
    rate = F.when(F.col("total_accounts") > 0, F.col("paid_accounts") / F.col("total_accounts")).otherwise(F.lit(0.0))
    return a.join(F.broadcast(d)).withColumn("conversion_rate", rate)  # a row each


def daily_trend(accounts: DataFrame, diagnoses: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """A row for each of the last days, with zeros: signups and diagnoses."""
    now = _at(as_of)
    first = F.date_trunc("day", now) - F.expr(f"INTERVAL {days - 1} DAYS")
    spine = accounts.sparkSession.range(days).select(F.date_format(F.date_add(first.cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("date"))

    def by_day(rows: DataFrame, name: str) -> DataFrame:
        return rows.where(F.col("created_at") >= first).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias(name))

    out = spine.join(by_day(accounts, "signups"), "date", "left").join(by_day(diagnoses, "diagnoses"), "date", "left")
    return out.select("date", F.coalesce("signups", F.lit(0)).cast("long").alias("signups"), F.coalesce("diagnoses", F.lit(0)).cast("long").alias("diagnoses"))


def funnel(accounts: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """signups, businesses diagnosed and completed (distinct), paid accounts.

    Distinct businesses come from one grouping instead of two distinct counts."""
    a = accounts.agg(F.count(F.lit(1)).alias("signups"), F.count_if(F.col("plan") != "free").alias("paid"))
    b = diagnoses.where("business_id IS NOT NULL").groupBy("business_id").agg(F.coalesce(F.bool_or(F.col("status") == "completed"), F.lit(False)).alias("done"))
    d = b.agg(F.count(F.lit(1)).alias("diagnosed"), F.count_if("done").alias("completed"))
    return a.join(F.broadcast(d)).select("signups", "diagnosed", "completed", "paid")


def recent_accounts(accounts: DataFrame, k: int = 20) -> DataFrame:
    return accounts.select("id", "plan", "created_at").orderBy(F.desc_nulls_first("created_at"), "id").limit(k)


def recent_diagnoses(diagnoses: DataFrame, businesses: DataFrame, k: int = 20, statuses: list[str] | None = None) -> DataFrame:
    """The last k diagnoses with their business's name; the k rows are found
    before the join."""
    rows = diagnoses if statuses is None else diagnoses.where(F.col("status").isin(statuses))
    top = rows.orderBy(F.desc_nulls_first("created_at"), "id").limit(k)
    b = businesses.select(F.col("id").alias("business_id"), F.col("name").alias("business_name"))
    return top.join(b, "business_id", "left").select("id", "business_name", "status", "created_at")


def member_status() -> Column:
    return F.when(F.col("deleted_at").isNotNull(), "deleted").when(F.col("blocked_at").isNotNull(), "blocked").otherwise("active")


def list_members(accounts: DataFrame, q: str | None = None, plan: str | None = None, status: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of members, latest first; the page size is kept within 1..100."""
    rows = accounts.withColumn("status", member_status())
    if q and q.strip():
        rows = rows.where(F.col("email").ilike(f"%{q.strip()}%"))
    if plan in ("free", "basic", "pro", "business"):
        rows = rows.where(F.col("plan") == plan)
    if status in ("active", "blocked", "deleted"):
        rows = rows.where(F.col("status") == status)
    return rows.select("id", "email", "plan", "status", "created_at").orderBy(F.desc_nulls_first("created_at"), "id").offset(max(offset, 0)).limit(min(max(limit, 1), 100))


def latest_diagnosis(businesses: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Every business with its last diagnosis, if any (an aggregate, no sort)."""
    last = diagnoses.groupBy("business_id").agg(F.max(F.struct("created_at", "id", "status")).alias("l"))
    return businesses.join(last, businesses["id"] == last["business_id"], "left").select(businesses["id"], "name", F.col("l.status").alias("latest_status"), F.col("l.created_at").alias("latest_at"))


def active_diagnosis(diagnoses: DataFrame) -> DataFrame:
    """The last pending diagnosis of each business that has one."""
    return diagnoses.where(F.col("status").isin(PENDING)).groupBy("business_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


def due_subscriptions(subscriptions: DataFrame, businesses: DataFrame, as_of: str, statuses: list[str] = ("active", "trial")) -> DataFrame:
    """Subscriptions due for a scan, joined to their business, oldest first."""
    due = subscriptions.where(F.col("status").isin(list(statuses)) & (F.col("next_scan_at") <= _at(as_of)))
    b = businesses.select(F.col("id").alias("business_id"), "name")
    return due.join(b, "business_id").orderBy("next_scan_at", "business_id")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """old with new rows put in by key: the row with the greatest version stays,
    a new one before an old one of equal version."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


#: What a change may set of a business.
BUSINESS_FIELDS = ["name", "category", "region", "place_id", "homepage_url"]


def changed_businesses(businesses: DataFrame, changes: DataFrame) -> DataFrame:
    """businesses: id, account_id, BUSINESS_FIELDS, created_at, updated_at,
    deleted_at.  changes: id, at, account_id, a column for each field and ``set``,
    the names of the fields that the change sets (to null too).  The table after
    all changes, in the order of at.

    A change of an unknown id creates a business with what it sets; a field's value
    is that of the last change that sets it, and a name set to null is empty.  A
    business that is deleted is not changed.  Changes are summed up to one row an
    id before the tables meet, each field by the latest change that sets it."""
    last = changes.groupBy("id").agg(
        F.min("at").alias("_first"), F.max("at").alias("_last"), F.min_by("account_id", "at").alias("_account"),
        *(F.max_by(F.struct(F.col(f).alias("v")), F.when(F.array_contains("set", f), F.col("at"))).alias(f"_{f}") for f in BUSINESS_FIELDS),
    )
    x = businesses.withColumn("_old", F.lit(True)).join(last, "id", "full")
    open_ = F.col("deleted_at").isNull() & F.col("_last").isNotNull()
    new = F.col("_old").isNull()
    value = {f: F.when(open_ & F.col(f"_{f}").isNotNull(), F.col(f"_{f}.v")).otherwise(F.col(f)) for f in BUSINESS_FIELDS}
    value["name"] = F.coalesce(value["name"], F.when(open_, F.lit("")))
    return x.select(
        "id", F.when(new, F.col("_account")).otherwise(F.col("account_id")).alias("account_id"), *(value[f].alias(f) for f in BUSINESS_FIELDS),
        F.when(new, F.col("_first")).otherwise(F.col("created_at")).alias("created_at"), F.when(open_, F.col("_last")).otherwise(F.col("updated_at")).alias("updated_at"), "deleted_at",
    )


def found_businesses(businesses: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: request, id, place_id, account_id, of which one is given.  Each
    request with ``found``, the id of the business that is not deleted: by its id,
    by its place, or an account's latest (of equally new ones the greatest id);
    null if there is none.  Three joins on equal keys, each side one row a key."""
    live = businesses.where("deleted_at IS NULL")
    by_id = live.select(F.col("id"), F.col("id").alias("_by_id")).distinct()
    by_place = live.where("place_id IS NOT NULL").groupBy("place_id").agg(F.max("id").alias("_by_place"))
    by_account = live.where("account_id IS NOT NULL").groupBy("account_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("_by_account"))
    x = wanted.join(by_id, "id", "left").join(by_place, "place_id", "left").join(by_account, "account_id", "left")
    return x.select("request", F.when(F.col("id").isNotNull(), F.col("_by_id")).when(F.col("place_id").isNotNull(), F.col("_by_place")).otherwise(F.col("_by_account")).alias("found"))


def latest_scan_keywords(scans: DataFrame, keywords: DataFrame, k: int = 5) -> DataFrame:
    """The k best keywords of each business's last scan."""
    last = scans.groupBy("business_id").agg(F.max_by("scan_id", F.struct("created_at", "scan_id")).alias("scan_id"))
    w = Window.partitionBy("scan_id").orderBy(F.desc_nulls_first("score"), "created_at", "keyword")
    return keywords.join(last, "scan_id").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def job_transitions(events: DataFrame) -> DataFrame:
    """Legal events of each job: queued to running, running to completed or
    failed.  events: job_id, seq, status.  A job's events are few."""
    w = Window.partitionBy("job_id").orderBy("seq")
    before = F.coalesce(F.lag("status").over(w), F.lit("new"))
    legal = F.create_map(F.lit("new"), F.array(F.lit("queued")), F.lit("queued"), F.array(F.lit("running")), F.lit("running"), F.array(F.lit("completed"), F.lit("failed")))
    return events.withColumn("legal", F.coalesce(F.array_contains(F.try_element_at(legal, before), F.col("status")), F.lit(False)))


def tally(results: DataFrame) -> DataFrame:
    """One row: processed, completed, partial, skipped, failed."""
    return results.agg(F.count(F.lit(1)).alias("processed"), *(F.count_if(F.col("status") == s).alias(s) for s in ("completed", "partial", "skipped", "failed")))


def channel_signal(rows: DataFrame) -> DataFrame:
    """Traffic light of each site and channel from its open gap rows: none is
    green; without a high one two are green and more yellow; up to two high ones
    are yellow; else red."""
    g = rows.groupBy("site_id", "channel").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("priority") == "high").alias("high"))
    light = F.when(F.col("rows") == 0, "green").when((F.col("high") == 0) & (F.col("rows") <= 2), "green").when(F.col("high") <= 2, "yellow").otherwise("red")
    return g.withColumn("light", light)


def cost_by_day(calls: DataFrame, prices: DataFrame, zone: str = "Asia/Seoul") -> DataFrame:
    """calls: provider, model, at (UTC), tokens_in, tokens_out.  prices: model,
    usd_in, usd_out for a thousand tokens.  An unknown model costs nothing."""
    p = prices.select(F.col("model"), "usd_in", "usd_out")
    cost = F.coalesce(F.col("tokens_in") / 1000 * F.col("usd_in") + F.col("tokens_out") / 1000 * F.col("usd_out"), F.lit(0.0))
    day = F.to_date(F.from_utc_timestamp("at", zone))
    return calls.join(p, "model", "left").groupBy(day.alias("day"), "provider").agg(F.sum(cost).alias("usd"), F.count(F.lit(1)).alias("calls"))


def actions_with_completion(actions: DataFrame, completions: DataFrame, tier: str | None = None, paid: bool = True, free_rows: int = 3) -> DataFrame:
    """actions (site_id, action_id, tier, pos and more) with ``completed``: whether
    the id is among the completions (action_id).  One tier, if wanted; a site that
    does not pay sees the first free_rows, but ``total`` counts all of them."""
    done = completions.select(F.col("action_id")).distinct().withColumn("_done", F.lit(True))
    x = actions.join(done, "action_id", "left").withColumn("completed", F.coalesce("_done", F.lit(False))).drop("_done")
    x = x if tier is None else x.where(F.col("tier") == tier)
    w = Window.partitionBy("site_id")
    x = x.withColumns({"total": F.count(F.lit(1)).over(w), "_n": F.row_number().over(w.orderBy("pos", "action_id"))})
    return (x if paid else x.where(F.col("_n") <= free_rows)).drop("_n")


def latest_of(*times: Column) -> Column:
    """The latest of ISO texts, which is the greatest; empty ones don't count."""
    return F.array_max(F.array_compact(F.array(*(F.nullif(t, F.lit("")) for t in times))))
