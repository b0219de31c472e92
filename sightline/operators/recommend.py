"""Recommendation texts from templates, and budgets for paid providers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import recommendation_quality, render
from .keywords import numbered

#: A text below this quality is replaced; a budget warns at these shares.
GOOD_ENOUGH = 70
ALERTS = [(1.0, "exhausted"), (0.8, "near_limit")]
ESTIMATE = (300, 150)


def improve(items: DataFrame, templates: DataFrame, profiles: DataFrame) -> DataFrame:
    """items: site_id, rule_id, text.  templates: rule_id, template.  profiles:
    site_id, values (a map).  ``text`` becomes the rendered template where it is
    of low quality and the template's is better; ``source`` says which it is."""
    t = templates.groupBy("rule_id").agg(F.min("template").alias("template"))
    x = items.join(t, "rule_id", "left").join(profiles.select("site_id", "values"), "site_id", "left")
    new = F.when(F.col("template").isNotNull(), render(F.col("template"), F.coalesce("values", F.create_map().cast("map<string,string>"))))
    old_q, new_q = recommendation_quality(F.col("text")), recommendation_quality(new)
    better = new.isNotNull() & (old_q < GOOD_ENOUGH) & (new_q > old_q)
    x = x.withColumns({"source": F.when(better, "template").otherwise("rule"), "quality": F.when(better, new_q).otherwise(old_q), "text": F.when(better, new).otherwise(F.col("text"))})
    return x.drop("template", "values")


def choose_provider(requests: DataFrame, providers: DataFrame, daily_usd: float) -> DataFrame:
    """requests: day, pos.  providers: rank, provider, usd_in, usd_out (for a
    thousand tokens; a local one costs 0).  The first provider serves while the
    day's budget lasts, at an estimated cost a request; then the first free one,
    else none.  A request's place in its day stands for what was spent before."""
    cost = F.col("usd_in") * ESTIMATE[0] / 1000 + F.col("usd_out") * ESTIMATE[1] / 1000
    p = providers.agg(F.min_by(F.struct("provider", cost.alias("cost")), "rank").alias("first"), F.min_by("provider", F.when(cost == 0, F.col("rank"))).alias("free"))
    x = numbered(requests, "day", "pos", "n").join(F.broadcast(p))  # one row
    spent = F.col("n") * F.col("first.cost")
    fits = spent <= daily_usd + 1e-12
    alert = None
    for share, name in ALERTS:
        alert = F.when(spent + 1e-12 >= share * daily_usd, name) if alert is None else alert.when(spent + 1e-12 >= share * daily_usd, name)
    alert = F.when(F.col("first.cost") > 0, alert)
    return x.select("day", "pos", F.when(fits, F.col("first.provider")).otherwise(F.col("free")).alias("provider"), F.when(fits, F.col("first.cost")).otherwise(F.lit(0.0)).alias("usd"), alert.alias("alert"))
