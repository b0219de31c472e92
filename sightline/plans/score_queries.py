"""Scores, items and link depths over stand-in rule results and link graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring
from ..operators.rules.context import link_depth
from .common import table

CATEGORIES = ["SEO", "AEO", "GEO", "PERF", "NLP"]


def _results(spark, d):
    """A supplier's lines by part as the results of 60 rules."""
    of = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    pos = F.col("rule_pos")
    x = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("site_id"), (F.col("l_partkey") % 60).alias("rule_pos")).agg((F.max("l_quantity") > 30).alias("passed"))
    return x.select(
        "site_id", "rule_pos", "passed", F.concat(of(CATEGORIES, pos), F.lit("-"), pos).alias("rule_id"), of(CATEGORIES, pos).alias("category"), of(["high", "medium", "low"], F.floor(pos / 5)).alias("severity"), of(["low", "high", "medium"], F.floor(pos / 15)).alias("expected_impact"),
        (pos % 11).cast("int").alias("rule_weight"), F.when(pos % 13 == 0, "informational").alias("score_impact"), of(scoring.ACTIONS, pos).alias("action_type"), of(["easy", "medium", "hard"], pos).alias("difficulty"),
    )


def graded_scores(spark, d):
    return scoring.category_scores(_results(spark, d))


def legacy_scores(spark, d):
    return scoring.category_scores(_results(spark, d), mode="legacy").select("site_id", "category", "score")


def overall_scores(spark, d):
    return scoring.overall_scores(scoring.category_scores(_results(spark, d)))


def ordered_items(spark, d):
    return scoring.execution_order(scoring.diagnosis_items(_results(spark, d))).select("site_id", "position", "rule_id", "priority", "impact_score", "item_id")


def item_counts(spark, d):
    return scoring.action_counts(scoring.diagnosis_items(_results(spark, d)))


def link_depths(spark, d):
    """Customers as pages of ten sites, each with links to two later ones; some
    have none, so that pages after them are out of reach."""
    k = F.col("c_custkey")
    url = lambda i: F.concat(F.lit("https://e/"), i)
    i, s = F.floor(k / 10), k % 10
    links = F.when(i % 5 == 3, F.array(url(k), url(s))).otherwise(F.array(url(i * 20 + 10 + s), url(i * 20 + 20 + s), F.lit("https://other/")))
    p = table(spark, d, "customer").select(s.alias("site_id"), url(k).alias("url"), links.alias("internal_links"), k.alias("k"))
    return link_depth(p, p.groupBy("site_id").agg(F.min_by("url", "k").alias("start_url")))


QUERIES = {f.__name__: f for f in (graded_scores, legacy_scores, overall_scores, ordered_items, item_counts, link_depths)}

_case = lambda values, key: f"CASE ({key}) % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"
_RESULTS = f"""WITH g AS (SELECT l_suppkey AS site_id, l_partkey % 60 AS pos, max(l_quantity) > 30 AS passed FROM lineitem GROUP BY 1, 2),
  r AS (SELECT *, {_case(CATEGORIES, "pos")} AS category, {_case(["high", "medium", "low"], "pos // 5")} AS severity, {_case(["low", "high", "medium"], "pos // 15")} AS impact, pos % 11 AS weight, {_case(scoring.ACTIONS, "pos")} AS action, pos % 3 AS hard, pos % 11 > 0 AND pos % 5 <> 4 AND pos % 13 <> 0 AS scored FROM g),
  w AS (SELECT *, weight * 10 * CASE severity WHEN 'high' THEN 0.2::DOUBLE WHEN 'medium' THEN 0.1::DOUBLE ELSE 0.04::DOUBLE END AS w FROM r) """
_sum = lambda value, start, sign: f"list_reduce(list_prepend({start}::DOUBLE, coalesce(list({value} ORDER BY pos) FILTER (scored), []::DOUBLE[])), lambda a, x: a {sign} x)"
_SCORES = f"""{_RESULTS}, t AS (SELECT site_id, category, {_sum("w", 0, "+")} AS total, {_sum("CASE WHEN passed THEN w ELSE 0::DOUBLE END", 0, "+")} AS earned, {_sum("CASE WHEN passed THEN 0::DOUBLE ELSE w END", 100, "-")} AS kept, count(*) FILTER (scored) AS rules, count(*) FILTER (scored AND passed) AS passed_rules FROM w GROUP BY 1, 2),
  s AS (SELECT site_id, category, CASE WHEN total > 0 THEN floor(100 * earned / total + 0.5) ELSE 0 END::INT AS score, rules, passed_rules, floor(greatest(0, kept) + 0.5)::INT AS legacy FROM t) """
_LEVEL = "CASE {} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
_ITEMS = f"""{_RESULTS}, i AS (SELECT site_id, pos, action, hard, category || '-' || pos AS rule_id, {_LEVEL.format("severity")} * {_LEVEL.format("impact")} AS p, least(100, floor(weight * 10 * CASE severity WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.3 END + 0.5))::INT AS impact_score FROM r WHERE NOT passed),
  j AS (SELECT *, CASE WHEN p >= 6 THEN 0 WHEN p >= 3 THEN 1 ELSE 2 END AS rank, sha256(site_id || '|' || rule_id) AS item_id FROM i) """

ORACLE_SQL = {
    "graded_scores": _SCORES + "SELECT site_id, category, score, rules, passed_rules FROM s",
    "legacy_scores": _SCORES + "SELECT site_id, category, legacy AS score FROM s",
    "overall_scores": _SCORES + """, p AS (SELECT site_id, coalesce(max(score) FILTER (category = 'SEO'), 0) AS seo, coalesce(max(score) FILTER (category = 'AEO'), 0) AS aeo, coalesce(max(score) FILTER (category = 'GEO'), 0) AS geo, max(score) FILTER (category = 'PERF' AND rules > 0) AS perf FROM s GROUP BY 1)
      SELECT *, CAST(floor(CASE WHEN perf IS NULL THEN (seo * 35 + aeo * 25 + geo * 25) / 85 ELSE (seo * 35 + aeo * 25 + geo * 25 + perf * 15) / 100 END + 0.5) AS INT) AS overall FROM p""",
    "ordered_items": _ITEMS + "SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY rank, hard, impact_score DESC, item_id) AS position, rule_id, ['high', 'medium', 'low'][rank + 1] AS priority, impact_score, item_id FROM j",
    "item_counts": _ITEMS + "SELECT site_id, " + ", ".join(f"count(*) FILTER (action = '{a}') AS {a}" for a in scoring.ACTIONS) + ", count(*) AS items FROM j GROUP BY 1",
    "link_depths": """WITH RECURSIVE n AS (SELECT c_custkey AS k, c_custkey % 10 AS s, c_custkey // 10 AS i FROM customer), e AS (SELECT k, s, unnest([i * 20 + 10 + s, i * 20 + 20 + s]) AS v FROM n WHERE i % 5 <> 3 UNION ALL SELECT k, s, s FROM n WHERE i % 5 = 3),
      f AS (SELECT s, min(k) AS k, 0 AS d FROM n GROUP BY 1 UNION SELECT f.s, v, d + 1 FROM f JOIN e ON e.k = f.k JOIN n ON n.k = e.v WHERE d < 60), m AS (SELECT s, k, min(d) AS d FROM f GROUP BY 1, 2)
      SELECT n.s AS site_id, max(d) AS depth, count(*) FILTER (d IS NULL) AS unreachable FROM n LEFT JOIN m ON m.k = n.k GROUP BY 1""",
}
