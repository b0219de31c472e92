"""Thresholds of the speed rules against measured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of n values a sketch's rank is off by n / ACCURACY at most.
ACCURACY = 10_000


def exact_ranks(values: DataFrame, ranks: dict[str, tuple[float, Column]]) -> DataFrame:
    """values: rule_id, m.  ranks: by name the share of values and the wanted place
    (from 1) in a rule's order, of the rule's number of values ``n``; a place is
    at most 1 from its share of n.  One row a rule with a column a rank.

    A sketch gives two values between which each wanted place must lie, twice its
    error below and above.  Values are counted, those below a bracket are summed,
    and only the few within are put in order, so no task sorts or holds a rule's
    values.  The result does not depend on the sketch."""
    slack = 2 / ACCURACY
    points = [min(1.0, max(0.0, q + side)) for q, _ in ranks.values() for side in (-slack, slack)]
    found = values.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("m", F.array(*map(F.lit, points)), ACCURACY).alias("cuts"))
    brackets = F.array(*(F.struct(F.lit(name).alias("name"), F.col("cuts")[2 * i].alias("low"), F.col("cuts")[2 * i + 1].alias("high"), k.cast("long").alias("k")) for i, (name, (_, k)) in enumerate(ranks.items())))
    wanted = F.broadcast(found.select("rule_id", brackets.alias("brackets")))  # a row a rule
    counts = values.groupBy("rule_id", "m").agg(F.count(F.lit(1)).alias("c")).join(wanted, "rule_id")
    low = lambda i: F.col("brackets")[i]["low"]
    below = counts.groupBy("rule_id").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("m") < low(i), F.col("c"))), F.lit(0)) for i in range(len(ranks)))).alias("below"))
    inside = counts.select("rule_id", "m", "c", F.posexplode(F.transform("brackets", lambda b: F.when(F.col("m").between(b["low"], b["high"]), b))).alias("i", "b")).where("b IS NOT NULL")
    inside = inside.join(F.broadcast(below), "rule_id").select("rule_id", "m", "c", "b.name", (F.col("b.k") - F.col("below")[F.col("i")]).alias("k"))
    at = F.sum("c").over(Window.partitionBy("rule_id", "name").orderBy("m"))
    hit = inside.withColumn("upto", at).where("k <= upto AND k > upto - c")
    return hit.groupBy("rule_id").agg(*(F.max(F.when(F.col("name") == name, F.col("m"))).alias(name) for name in ranks))


def calibrate(samples: DataFrame, rules: dict[str, tuple[Column, Column]], tight: float = 0.95, loose: float = 0.1) -> DataFrame:
    """A row for each rule (metric, passed): pass rate, median (mean of the middle
    two), nearest-rank p90 and p95, and whether to raise or lower the threshold.
    Null and NaN metrics are left out; without samples there are no rows."""
    one = lambda name, metric, passed: F.struct(F.lit(name).alias("rule_id"), F.nanvl(metric.cast("double"), F.lit(None).cast("double")).alias("m"), F.coalesce(passed, F.lit(False)).alias("passed"))
    long = samples.select(F.inline(F.array(*(one(name, *r) for name, r in rules.items()))))
    rates = long.groupBy("rule_id").agg(F.avg(F.col("passed").cast("double")).alias("pass_rate"))
    n = F.col("n")
    found = exact_ranks(long.where("m IS NOT NULL").select("rule_id", "m"), {"lo": (0.5, F.floor((n + 1) / 2)), "hi": (0.5, F.ceil((n + 1) / 2)), "p90": (0.9, F.ceil(n * 0.9)), "p95": (0.95, F.ceil(n * 0.95))})
    out = rates.join(found, "rule_id", "left")
    advice = F.when(F.col("pass_rate") > tight, "raise").when(F.col("pass_rate") < loose, "lower").otherwise("keep")
    return out.select("rule_id", "pass_rate", ((F.col("lo") + F.col("hi")) / 2).alias("median"), "p90", "p95", advice.alias("advice"))


#: The marks and words of a calibration report.
MARKS = {"keep": "✅", "raise": "⬆️", "lower": "⬇️"}
REASONS = {"keep": "good", "raise": "too permissive, consider stricter threshold", "lower": "too strict, consider more lenient threshold"}


def calibration_text(report: DataFrame, thresholds: dict[str, str], made_at: str) -> DataFrame:
    """One row ``text``: the report of ``calibrate`` for people, in Markdown, rules
    in the order of thresholds (rule_id to how it is written); rules that are not
    there come last by name.  There are as many rows as rules."""
    two = lambda c: F.format_string("%.2f", c)
    share = F.concat(F.format_string("%.1f", F.col("pass_rate") * 100), F.lit("%"))
    of = lambda values, key: F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for pair in values.items() for v in pair)), key), F.lit(""))
    order = F.array_position(F.array(*map(F.lit, thresholds)), F.col("rule_id"))
    lines = F.array(
        F.concat(F.lit("### "), of(MARKS, F.col("advice")), F.lit(" "), "rule_id"), F.concat(F.lit("- **현재 임계값**: "), of(thresholds, F.col("rule_id"))), F.concat(F.lit("- **Pass Rate**: "), share),
        *(F.concat(F.lit(f"- **{name}**: "), two(F.coalesce(F.col(c), F.lit(0.0)))) for name, c in (("Median", "median"), ("P90", "p90"), ("P95", "p95"))),
        F.concat(F.lit("- **권고**: "), F.upper("advice")), F.concat(F.lit("- **사유**: Pass rate: "), share, F.lit(" ("), of(REASONS, F.col("advice")), F.lit(")")), F.lit(""),
    )
    one = report.select(F.struct(F.when(order > 0, order).otherwise(len(thresholds) + 1).alias("o"), "rule_id", lines.alias("lines")).alias("r"), "advice")
    all_ = one.agg(F.array_sort(F.collect_list("r")).alias("r"), F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("advice") == a).alias(a) for a in MARKS))
    head = F.array(F.lit("# PERF 규칙 보정 보고서"), F.lit(""), F.lit(f"생성 시각: {made_at}"), F.concat(F.lit("총 규칙 수: "), "n"), F.lit(""), F.lit("## 요약"), F.lit(""), F.concat(F.lit("- Keep: "), "keep", F.lit(" 규칙")), F.concat(F.lit("- Raise (임계값 강화): "), "raise", F.lit(" 규칙")), F.concat(F.lit("- Lower (임계값 완화): "), "lower", F.lit(" 규칙")), F.lit(""), F.lit("## 규칙별 상세"), F.lit(""))
    return all_.select(F.array_join(F.concat(head, F.flatten(F.transform("r", lambda x: x["lines"]))), "\n").alias("text"))
