"""One row a site with all that rules look at.

The main page is the one whose url is the site's start url, else the first.
Facts over all pages are aggregates of the same grouping, so a site costs one
shuffle of its page rows' narrow columns and of one main page.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import urls
from ...functions.language import LANGUAGE, with_language
from ...sources.shared import cut
from ..competitors import authority

PERF = "struct<strategy:string,performance:double,lcp:double,fid:double,cls:double,inp:double,ttfb:double,fcp:double>"
BACKLINK = "struct<domain_authority:double,https_enforced:boolean,hsts:boolean,canonical_consistent:boolean,structured_data:int,social_meta:int>"
NLP = LANGUAGE
PROFILE = {"business_name": "string", "industry": "string", "region": "string", "main_services": "array<string>", "target_keywords": "array<string>"}


def site_context(pages: DataFrame, profiles: DataFrame | None = None, sites: DataFrame | None = None, perf: DataFrame | None = None, backlinks: DataFrame | None = None, nlp: DataFrame | None = None, a11y_measured: bool = True) -> DataFrame:
    """pages: rows of sources.pages.  profiles: site_id and PROFILE.  sites:
    site_id, start_url, sitemap_used, http_protocol, redirect_chain_length.
    perf, backlinks, nlp: site_id and the fields of their structs; a site
    without them has a null struct."""
    if sites is None:
        sites = pages.select("site_id").distinct().selectExpr("site_id", "string(null) start_url", "false sitemap_used", "string(null) http_protocol", "int(null) redirect_chain_length")
    link = F.exists(F.concat(F.coalesce("internal_links", F.array().cast("array<string>")), F.coalesce("external_links", F.array().cast("array<string>"))), lambda x: x.rlike(r"(?i)/sitemap[^/]*\.xml"))
    desc = F.when(F.length(F.trim("description")) > 0, F.trim("description"))
    p = urls.path(F.col("url"))
    start = sites.select("site_id", "start_url")
    x = pages.join(start, "site_id")
    first = F.struct(F.when(F.col("url") == F.col("start_url"), 0).otherwise(1), "pos")
    fields = [c for c in pages.columns if c != "site_id"]
    canonical_host = F.when(F.col("canonical_url").isNotNull(), urls.host(F.col("canonical_url")))
    canonical = F.col("canonical_url").isNull() | urls.same_site(F.col("canonical_url"), F.col("url"))
    s = x.groupBy("site_id").agg(
        F.min_by(F.struct(*fields), first).alias("page"), F.count(F.lit(1)).alias("pages"), F.count_distinct("url").alias("urls"), F.max(urls.path_depth(F.col("url"))).alias("deepest"),
        F.bool_or(link).alias("sitemap_link"), F.count(desc).alias("descriptions"), F.count_distinct(desc).alias("distinct_descriptions"), F.bool_or(F.col("status_code").between(400, 499)).alias("broken"),
        F.min(canonical_host).alias("canonical_from"), F.max(canonical_host).alias("canonical_to"), F.count_if(p != "/").alias("paths"), F.count_if((p != "/") & p.endswith("/")).alias("slashed"), F.bool_and(canonical).alias("canonical_same_site"),
    )
    s = s.join(sites, "site_id").select("site_id", "page.*", "pages", "urls", "deepest", "sitemap_link", "descriptions", "distinct_descriptions", "broken", "paths", "slashed", "canonical_same_site", "canonical_from", "canonical_to", "start_url", "sitemap_used", "http_protocol", "redirect_chain_length")
    if profiles is None:
        for c, t in PROFILE.items():
            s = s.withColumn(c, F.lit(None).cast(t))
    else:
        s = s.join(profiles.select("site_id", *PROFILE), "site_id", "left")
    for name, table, kind in (("perf", perf, PERF), ("backlink", backlinks, BACKLINK), ("nlp", nlp, NLP)):
        if table is None:
            s = s.withColumn(name, F.lit(None).cast(kind))
        else:
            s = s.join(table.select("site_id", F.struct(*(c for c in table.columns if c != "site_id")).cast(kind).alias(name)), "site_id", "left")
    return s if a11y_measured else s.withColumn("a11y", F.lit(None).cast("array<string>"))


def with_measures(context: DataFrame) -> DataFrame:
    """A context with what its pages themselves tell about language (``nlp``) and
    authority (``backlink``), where no provider has measured it.  Both are
    expressions on the site's row.

    Authority is estimated from https of the start url (else the main page's), a
    sitemap, the main page's structured data, social tags and words, and whether
    every canonical url of the site is on its start host (true without any).  Headers
    are not recorded, so strict transport security counts as absent."""
    start = F.coalesce("start_url", "url")
    https = F.lower(start).startswith("https://")
    consistent = F.coalesce((F.col("canonical_from") == urls.host(start)) & (F.col("canonical_to") == urls.host(start)), F.lit(True))
    items, social = F.coalesce(F.col("facts.items"), F.lit(0)), F.coalesce(F.size(F.map_filter("meta", lambda k, _: k.startswith("og:") | k.startswith("twitter:"))), F.lit(0))
    estimate = authority(https, F.lit(False), F.coalesce("sitemap_used", F.lit(False)), F.lit(False), items, social, consistent, F.least(F.coalesce("word_count", F.lit(0)), F.lit(500)) / 5)
    own = F.struct(estimate, https, F.lit(False), consistent, items, social).cast(BACKLINK)
    said = with_language(context.withColumnRenamed("nlp", "_measured"))
    return said.withColumns({"nlp": F.coalesce("_measured", "nlp"), "backlink": F.coalesce("backlink", own)}).drop("_measured")


#: Frontiers of link_depth that are kept apart until they are put into one table.
PIECES = 16


def link_depth(pages: DataFrame, start: DataFrame) -> DataFrame:
    """Clicks from each site's start page to its pages by internal links: a row
    a site with the largest depth and the number of pages out of reach.

    Frontiers are joined until no page is new, a round a click.  pages: site_id,
    url, internal_links.  start: site_id, start_url."""
    bare = lambda c: F.regexp_replace(c, r"[/#]+$", "")
    pages = cut(pages.select("site_id", bare(F.col("url")).alias("u"), F.transform("internal_links", bare).alias("links")))
    known = cut(pages.select("site_id", "u").distinct())
    edges = pages.select("site_id", "u", F.explode("links").alias("v")).distinct().join(known.withColumnRenamed("u", "v"), ["site_id", "v"], "left_semi")
    edges = cut(edges.where("u <> v"))
    seen = cut(start.select("site_id", bare(F.col("start_url")).alias("u")).distinct().join(known, ["site_id", "u"], "left_semi").withColumn("d", F.lit(0)))
    front = seen
    for d in count(1):
        new = front.join(edges, ["site_id", "u"]).select("site_id", F.col("v").alias("u")).distinct().join(seen, ["site_id", "u"], "left_anti")
        front = cut(new.withColumn("d", F.lit(d)))
        if not front.take(1):
            break
        seen = seen.unionByName(front)
        if d % PIECES == 0:
            seen = cut(seen)
    return known.join(seen, ["site_id", "u"], "left").groupBy("site_id").agg(F.coalesce(F.max("d"), F.lit(0)).alias("depth"), F.count_if(F.col("d").isNull()).alias("unreachable"))
