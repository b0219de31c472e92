"""Rule results to scores, grades, ranked items and actions.

rule_results: site_id, rule_pos, rule_id, category, passed, severity,
rule_weight, score_impact, action_type, difficulty, expected_impact (see
rules.RESULT).  Everything is grouped by site, summed before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, half_up, score100

#: Fixed values of the scoring model.
SEVERITY_WEIGHT = {"high": 0.2, "medium": 0.1, "low": 0.04}
SEVERITY_UNITS = {"high": 20, "medium": 10, "low": 4}
CATEGORY_WEIGHT = {"SEO": 0.35, "AEO": 0.25, "GEO": 0.25, "PERF": 0.15}
UNSCORED = ["informational", "not_applicable", "unavailable"]
LEVEL = {"high": 3, "medium": 2, "low": 1}
IMPACT_FACTOR = {"high": 1.0, "medium": 0.6, "low": 0.3}
GRADES = [(80, "excellent"), (60, "good"), (40, "fair")]
WORST_GRADE = "poor"
ACTIONS = ["self_fix", "snippet_action", "vendor_action", "si_action"]


def lookup(values: dict, key: Column, default=None) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def is_scored() -> Column:
    """Positive weight, no NLP rule, and not marked as outside the score."""
    return (F.col("rule_weight") > 0) & ~F.col("rule_id").startswith("NLP-") & ~F.coalesce(F.col("score_impact").isin(UNSCORED), F.lit(False))


def category_scores(results: DataFrame, mode: str = "graded") -> DataFrame:
    """site_id, category, ``score`` (int 0..100), ``rules``, ``passed_rules``.

    graded: 100 times the passed share of the scored weight; 0 without scored
    rules.  The weights are added as doubles in rule order, so halves round as
    a sequential sum does.  legacy: 100 minus the failed rules' deductions."""
    w = F.col("rule_weight") * F.lit(10) * lookup(SEVERITY_WEIGHT, F.col("severity"), 0.0)
    grouped = results.groupBy("site_id", "category").agg(
        F.array_sort(F.collect_list(F.when(is_scored(), F.struct("rule_pos", w.alias("w"), "passed")))).alias("r"),
        F.count_if(is_scored()).alias("rules"), F.count_if(is_scored() & F.col("passed")).alias("passed_rules"),
    )
    add = lambda keep: F.aggregate("r", F.lit(0.0), lambda acc, x: acc + F.when(keep(x), x["w"]).otherwise(0.0))
    total, earned, lost = add(lambda x: F.lit(True)), add(lambda x: x["passed"]), F.aggregate("r", F.lit(100.0), lambda acc, x: acc - F.when(x["passed"], 0.0).otherwise(x["w"]))
    score = F.when(total > 0, score100(100 * earned / total)).otherwise(F.lit(0)) if mode == "graded" else score100(lost)
    return grouped.select("site_id", "category", score.cast("int").alias("score"), "rules", "passed_rules")


def overall_scores(scores: DataFrame) -> DataFrame:
    """One row a site: seo, aeo, geo (0 if missing), perf (null if not
    measured), overall.  Without perf the other weights are scaled up to 1."""
    scores = scores.where("category <> 'PERF' OR rules > 0")
    p = scores.groupBy("site_id").pivot("category", list(CATEGORY_WEIGHT)).agg(F.first("score"))
    seo, aeo, geo, perf = (F.coalesce("SEO", F.lit(0)), F.coalesce("AEO", F.lit(0)), F.coalesce("GEO", F.lit(0)), F.col("PERF"))
    w = CATEGORY_WEIGHT
    rest = w["SEO"] + w["AEO"] + w["GEO"]
    with_perf = seo * w["SEO"] + aeo * w["AEO"] + geo * w["GEO"] + perf * w["PERF"]
    without = seo * (w["SEO"] / rest) + aeo * (w["AEO"] / rest) + geo * (w["GEO"] / rest)
    return p.select("site_id", seo.cast("int").alias("seo"), aeo.cast("int").alias("aeo"), geo.cast("int").alias("geo"), perf.cast("int").alias("perf"), score100(F.when(perf.isNotNull(), with_perf).otherwise(without)).alias("overall"))


def grade(score: Column) -> Column:
    """Null, NaN and negative scores are poor."""
    s = score.cast("double")
    out = F.when(s.isNull() | F.isnan(s), F.lit(WORST_GRADE))
    for cut, name in GRADES:
        out = out.when(s >= cut, name)
    return out.otherwise(F.lit(WORST_GRADE))


def traffic_signal(score: Column) -> Column:
    s = score.cast("double")
    return F.when(s.isNull() | F.isnan(s), "red").when(s >= 80, "green").when(s >= 40, "yellow").otherwise("red")


def priority(severity: Column, impact: Column) -> Column:
    product = lookup(LEVEL, severity, 0) * lookup(LEVEL, impact, 0)
    return F.when(product >= 6, "high").when(product >= 3, "medium").otherwise("low")


def impact_score(weight: Column, severity: Column) -> Column:
    return clamp(half_up(weight * 10 * lookup(IMPACT_FACTOR, severity, 0.0)), 0, 100).cast("int")


def diagnosis_items(results: DataFrame) -> DataFrame:
    """Failed rules with priority and impact; ids are a hash of site and rule."""
    return results.where(~F.col("passed")).select(
        F.sha2(F.concat_ws("|", F.col("site_id").cast("string"), "rule_id"), 256).alias("item_id"),
        "site_id", "rule_id", "category", "action_type", "difficulty", "rule_pos",
        priority(F.col("severity"), F.col("expected_impact")).alias("priority"), impact_score(F.col("rule_weight"), F.col("severity")).alias("impact_score"),
    )


def execution_order(items: DataFrame) -> DataFrame:
    """items with ``position``: priority, then easier, then larger impact, then id."""
    order = Window.partitionBy("site_id").orderBy(lookup({"high": 0, "medium": 1, "low": 2}, F.col("priority"), 3), lookup({"easy": 0, "medium": 1, "hard": 2}, F.col("difficulty"), 3), F.desc("impact_score"), "item_id")
    return items.withColumn("position", F.row_number().over(order))


def action_counts(items: DataFrame) -> DataFrame:
    """One row a site with the number of items of each action, zeros included."""
    return items.groupBy("site_id").agg(*(F.count_if(F.col("action_type") == a).alias(a) for a in ACTIONS), F.count(F.lit(1)).alias("items"))


def grouped_items(items: DataFrame, key: str, domain: list[str], sites: DataFrame | None = None) -> DataFrame:
    """A row for each site and each value of domain, with ``items``: the site's
    items whose key it is, by position; empty where there is none.

    sites: site_id, for sites without items; else those of items.  Items of other
    values are left out.  A site's items are summed up once, in order, and the
    domain is laid out from that row, so no join with it is needed."""
    fields = [c for c in items.columns if c != "site_id"]
    per_site = items.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("position", *(c for c in fields if c != "position")))).alias("_all"))
    if sites is not None:
        per_site = sites.select("site_id").distinct().join(per_site, "site_id", "left")
    kind = items.groupBy().agg(F.collect_list(F.struct("position", *(c for c in fields if c != "position"))).alias("x")).schema["x"].dataType
    of = lambda value: lambda i: i[key] == value
    every = F.coalesce("_all", F.array().cast(kind))
    groups = F.array(*(F.struct(F.lit(v).alias(key), F.filter(every, of(v)).alias("items")) for v in domain))
    return per_site.select("site_id", F.inline(groups))


def with_rules(items: DataFrame, results: DataFrame) -> DataFrame:
    """items with ``rule``, the result that each comes from (its outcome, severity
    and weight), null if there is none; of a rule's several results the last counts."""
    rule = results.groupBy("site_id", "rule_id").agg(F.max_by(F.struct("passed", "severity", "rule_weight", "score_impact"), "rule_pos").alias("rule"))
    return items.join(rule, ["site_id", "rule_id"], "left")


#: The modules that a diagnosis may ask for, in their order.
MODULES = ["SEO", "AEO", "GEO"]


def module_results(results: DataFrame, requests: DataFrame) -> DataFrame:
    """A row for each requested site and each of MODULES with ``results``: the
    module's results in rule order, empty for a module that was not asked for.

    requests: site_id, modules (array; null asks for all).  Results of modules
    that a site did not ask for are dropped before they are summed up."""
    asked = requests.select("site_id", F.coalesce("modules", F.array(*map(F.lit, MODULES))).alias("_asked"))
    mine = results.where(F.col("category").isin(MODULES)).join(asked, "site_id").where(F.array_contains("_asked", F.col("category"))).drop("_asked").withColumn("position", F.col("rule_pos"))
    return grouped_items(mine, "category", MODULES, requests).withColumnRenamed("items", "results")


def top_issues(items: DataFrame, k: int = 5, ai_generated: str | None = None) -> DataFrame:
    """The first k items of a site by priority, among those that are not
    machine-written or are of high priority."""
    if ai_generated:
        items = items.where(~F.col(ai_generated) | (F.col("priority") == "high"))
    order = Window.partitionBy("site_id").orderBy(lookup({"high": 0, "medium": 1, "low": 2}, F.col("priority"), 3), "rule_pos")
    return items.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def today_one(actions: DataFrame) -> DataFrame:
    """The action of each site to do today: the lowest priority number among
    self-made fixes, else among all; the first of equals by position."""
    key = F.struct((F.col("action_type") != "self_fix").cast("int"), F.col("priority"), F.col("pos"))
    return actions.groupBy("site_id").agg(F.min_by("action_id", key).alias("action_id"))
