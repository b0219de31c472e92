"""Own rule results against competitors'.

own: site_id, pos, rule_id, category, passed, action_type, priority.
rivals: site_id, rival, rule_id, passed.  rival_count: site_id, total (sites
without rivals may be missing).  Only rules of the own site count; a rival
without the rule has not passed it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scoring import grouped_items

from .scoring import lookup

#: Fixed values of the gap ranking.
PRIORITY_WEIGHT = {"high": 3, "medium": 2, "low": 1}
ACTION_BONUS = {"self_fix": 1.5, "snippet_action": 1.3, "vendor_action": 1.0, "si_action": 0.7}
TOP = 5


def gap_matrix(own: DataFrame, rivals: DataFrame) -> DataFrame:
    """own with ``rival_passed``, ``rival_total``, ``gap`` and ``place`` (gap
    descending, own order among equals)."""
    counts = rivals.groupBy("site_id", "rule_id").agg(F.count_if("passed").alias("rival_passed"))
    totals = rivals.groupBy("site_id").agg(F.count_distinct("rival").alias("rival_total"))
    m = own.join(counts, ["site_id", "rule_id"], "left").join(totals, "site_id", "left")
    passed, total = F.coalesce("rival_passed", F.lit(0)), F.coalesce("rival_total", F.lit(0))
    gap = passed / F.greatest(F.lit(1), total) - F.col("passed").cast("int")
    m = m.withColumns({"rival_passed": passed, "rival_total": total, "gap": gap})
    return m.withColumn("place", F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("gap"), "pos")))


def gap_priorities(matrix: DataFrame, k: int = TOP) -> DataFrame:
    """The k rules of a site in which rivals lead most, with rank and score."""
    score = F.col("gap") * lookup(PRIORITY_WEIGHT, F.col("priority"), 1) * lookup(ACTION_BONUS, F.col("action_type"), 1.0)
    lead = matrix.where("gap > 0").withColumn("score", score)
    lead = lead.withColumn("rank", F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("score"), "place")))
    return lead.where(F.col("rank") <= k).select("site_id", "rank", "rule_id", "action_type", "priority", "score", "rival_passed", "rival_total")


def strengths(matrix: DataFrame) -> DataFrame:
    return matrix.where(F.col("passed") & (F.col("rival_passed") < F.col("rival_total") / 2)).select("site_id", "rule_id")


def gap_summary(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("rules"), F.count_if(F.col("gap") > 0).alias("rivals_ahead"), F.count_if(F.col("gap") < 0).alias("own_ahead"), F.count_if(F.col("gap") == 0).alias("equal"), F.avg("gap").alias("avg_gap")
    )


def market_average(sites: DataFrame, rival_scores: DataFrame) -> DataFrame:
    """Mean rival score a category; a missing score counts as 0, and a site
    without rivals has 0."""
    names = ["seo", "aeo", "geo", "perf", "overall"]
    mean = rival_scores.groupBy("site_id").agg(*(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in names))
    return sites.select("site_id").join(mean, "site_id", "left").select("site_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in names))


def gap_view(rows: DataFrame, paid: bool, free_rows: int = 3) -> DataFrame:
    """Rows of a gap view: priority then gap, rank 1..5, and the first few only
    for those who don't pay.  ``needs_plan`` marks the rows behind the wall."""
    order = Window.partitionBy("site_id").orderBy(F.desc(lookup(PRIORITY_WEIGHT, F.col("priority"), 1)), F.desc("gap"), "pos")
    out = rows.withColumn("_n", F.row_number().over(order))
    out = out if paid else out.where(F.col("_n") <= free_rows)
    return out.withColumns({"rank": F.least(F.col("_n"), F.lit(5)), "needs_plan": F.col("_n") > free_rows}).drop("_n")


def gap_rows_with_rivals(rows: DataFrame, rivals: DataFrame) -> DataFrame:
    """Gap rows (rival_id and more) with their rival's name and url; rows whose
    rival is not known are left out."""
    r = rivals.select(F.col("id").alias("rival_id"), F.col("name").alias("rival_name"), F.col("url").alias("rival_url"))
    return rows.join(r, "rival_id")


#: The categories of a matrix, in their order.
CATEGORIES = ["seo", "aeo", "geo", "perf"]


def grouped_matrix(matrix: DataFrame, key: str, domain: list[str]) -> DataFrame:
    """A row for each site and value of domain with ``items``, the rows of the
    matrix (gap_matrix) with it, largest gap first; empty where there is none."""
    return grouped_items(matrix.withColumn("position", F.col("place")), key, domain)
