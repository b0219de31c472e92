"""Competitor discovery and ranking from search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import site


def popularity(rank: Column, reviews: Column, authority: Column, mentions: Column) -> Column:
    """0.4 / rank + 0.3 log reviews + 0.2 authority + 0.1 log mentions; a missing
    rank counts as 100, missing reviews or mentions as 1, authority as 0."""
    r = F.when(rank.isNull() | (rank == 0), F.lit(100)).otherwise(rank)
    scaled = lambda c: F.log10(F.coalesce(c, F.lit(1)) + 1) / 4
    return F.lit(0.4) / r + scaled(reviews) * 0.3 + F.coalesce(authority, F.lit(0)) / 100 * 0.2 + scaled(mentions) * 0.1


def rank_competitors(found: DataFrame, k: int | None = None) -> DataFrame:
    """found (site_id, pos, rank, reviews, authority, mentions, ...) with
    ``popularity`` and ``place``; the k best of a site if k is given."""
    out = found.withColumn("popularity", popularity(F.col("rank"), F.col("reviews"), F.col("authority"), F.col("mentions")))
    out = out.withColumn("place", F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("popularity"), "pos")))
    return out if k is None else out.where(F.col("place") <= k)


def merge_mentions(results: DataFrame) -> DataFrame:
    """One row a site and url: its first result (by pos) and ``mentions``, the
    number of results with that url."""
    rest = [c for c in results.columns if c not in ("site_id", "url", "mentions")]
    merged = results.groupBy("site_id", "url").agg(F.min_by(F.struct(*rest), "pos").alias("_f"), F.count(F.lit(1)).alias("mentions"))
    return merged.select("site_id", "url", "_f.*", "mentions")


def drop_excluded(results: DataFrame, excluded: DataFrame, words: list[str] = (), hosts: list[str] = ()) -> DataFrame:
    """Without results whose host is an excluded site of their site_id or below
    it, whose url or name has one of words, or whose url has one of hosts.

    excluded: site_id, excluded_url.  A host is matched through its suffixes,
    so the join is on equal keys."""
    labels = F.split(site(F.col("url")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    x = excluded.select("site_id", site(F.col("excluded_url")).alias("_host")).where("_host <> ''").distinct()
    hit = results.select("site_id", "url", F.explode(suffixes).alias("_host")).join(x, ["site_id", "_host"], "left_semi").select("site_id", "url").distinct()
    out = results.join(hit, ["site_id", "url"], "left_anti")
    url, name = F.lower("url"), F.lower(F.coalesce("name", F.lit("")))
    for w in words:
        out = out.where(~url.contains(w.lower()) & ~name.contains(w.lower()))
    for h in hosts:
        out = out.where(~url.contains(h.lower()))
    return out


#: Where a competitor comes from, strongest first.
SOURCES = ["serp", "ai", "manual", "ai_name"]


def merge_sources(found: DataFrame) -> DataFrame:
    """found: site_id, source, pos, name, url (null for names only).  The first
    of each key stays: a url, or a source and name where there is none."""
    key = F.coalesce(F.col("url"), F.concat_ws(":", "source", "name"))
    order = F.struct(F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source")), "pos")
    rest = [c for c in found.columns if c != "site_id"]
    merged = found.withColumn("_key", key).groupBy("site_id", "_key").agg(F.min_by(F.struct(*rest), order).alias("_f"), F.min(order).alias("_o"))
    out = merged.select("site_id", "_f.*", "_o")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("site_id").orderBy("_o"))).drop("_o")


def buildable_queries(profiles: DataFrame, keywords: int = 3) -> DataFrame:
    """Search queries of a profile: region and industry, then region and each of
    the first keywords."""
    base = F.array(F.concat_ws(" ", "region", "industry"))
    more = F.transform(F.slice(F.coalesce("target_keywords", F.array().cast("array<string>")), 1, keywords), lambda k: F.concat_ws(" ", F.col("region"), k))
    return profiles.select("site_id", F.posexplode(F.concat(base, more)).alias("pos", "query"))


#: Questions to AI services by facet, in their order.  A template is
#: used where all that it names is known; ``{keyword}`` is one of the first three,
#: in words of their own where the region is not known.
FACETS = [
    ("brand-mention", "{name}에 대해 알려줘"),
    ("brand-mention", "{name}는 어떤 곳인가요?"),
    ("industry-region", "{region}에서 가장 인기있는 {industry} 추천해줘"),
    ("industry-region", "{region} {industry} 어디가 좋아?"),
    ("service-recommendation", "{region}에서 {keyword} 잘하는 곳 추천해줘"),
    ("service-recommendation", "{keyword} 잘하는 곳 추천해줘"),
    ("comparative", "{region} {industry} 인기 매장 5개 비교해줘"),
]
MOST_QUESTIONS, MOST_KEYWORDS = 10, 3


def _with_keyword(template: Column):
    return lambda k: F.replace(template, F.lit("{keyword}"), k)


def _of_facet(facet: str):
    return lambda q: F.struct(q.alias("query"), F.lit(facet).alias("facet"))


def facet_questions(profiles: DataFrame, templates: list[tuple[str, str]] = FACETS, facet: str | None = None, most: int = MOST_QUESTIONS) -> DataFrame:
    """profiles: site_id, business_name, region, industry, target_keywords.
    site_id, ``place``, ``query``, ``facet``: each template filled in, the first
    ``most`` of a site; with facet only its own.

    White space is made one blank; a blank field is unknown, a blank keyword is
    passed over.  A template with a keyword but no region is for profiles without
    a region."""
    none = F.array().cast("array<string>")
    tidy = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    x = profiles.select("site_id", *(tidy(F.col(c)).alias(k) for k, c in (("name", "business_name"), ("region", "region"), ("industry", "industry"))), F.slice(F.filter(F.transform(F.coalesce("target_keywords", none), tidy), lambda k: k != ""), 1, MOST_KEYWORDS).alias("keywords"))
    empty, parts = F.array().cast("array<struct<query:string,facet:string>>"), []
    for of, text in templates:
        if facet is not None and of != facet:
            continue
        filled, known = F.lit(text), F.lit(True)
        for field in ("name", "region", "industry"):
            if "{" + field + "}" in text:
                filled, known = F.replace(filled, F.lit("{" + field + "}"), F.col(field)), known & (F.col(field) != "")
        if "{keyword}" in text:
            known = known if "{region}" in text else known & (F.col("region") == "")
            filled = F.transform("keywords", _with_keyword(filled))
        else:
            filled = F.array(filled)
        parts.append(F.when(known, F.transform(filled, _of_facet(of))).otherwise(empty))
    return x.select("site_id", F.posexplode(F.slice(F.concat(empty, *parts), 1, most)).alias("place", "q")).select("site_id", (F.col("place") + 1).alias("place"), "q.query", "q.facet")


def authority(https: Column, hsts: Column, sitemap: Column, robots_txt: Column, structured_data: Column, social_meta: Column, canonical_consistent: Column, content_length: Column) -> Column:
    """Domain authority (0..100) estimated from capped on-page signals (fixed
    weights); a missing signal counts for nothing."""
    flag = lambda x, n: F.coalesce(x, F.lit(False)).cast("double") * n
    capped = lambda x, n, most: F.least(F.coalesce(x, F.lit(0)).cast("double") * n, F.lit(float(most)))
    raw = flag(https, 10) + flag(hsts, 5) + flag(sitemap, 10) + flag(robots_txt, 5) + capped(structured_data, 5, 25) + capped(social_meta, 2, 15) + flag(canonical_consistent, 10) + capped(content_length, 1, 100) * 0.2
    return F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw * 0.9)) + 0.5).cast("int")


def heuristic_authority(signals: DataFrame) -> DataFrame:
    """site_id, ``authority``, ``backlinks`` and ``domains`` of each site's signals."""
    da = authority(*map(F.col, ("https", "hsts", "sitemap", "robots_txt", "structured_data", "social_meta", "canonical_consistent", "content_length")))
    return signals.select("site_id", da.alias("authority"), F.floor(da * 5 + 0.5).cast("int").alias("backlinks"), F.floor(da * 0.8 + 0.5).cast("int").alias("domains"))


def site_signals(pages: DataFrame) -> DataFrame:
    """What heuristic_authority takes from pages (site_id, meta, canonical_host,
    host, word_count, types): social tags, whether every canonical host there is
    is the site's (true without any), words up to 500 by 5, kinds of structured
    data."""
    social = F.size(F.map_filter("meta", lambda k, _: k.startswith("og:") | k.startswith("twitter:")))
    return pages.groupBy("site_id").agg(
        F.max(social).alias("social_meta"), F.coalesce(F.bool_and(F.col("canonical_host") == F.col("host")), F.lit(True)).alias("canonical_consistent"),
        (F.least(F.sum("word_count"), F.lit(500)) / 5).alias("content_length"), F.size(F.array_distinct(F.flatten(F.collect_set("types")))).alias("structured_data"),
    )
