"""Redirect chains and the order of a crawl, from tables of what was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from .robots import robots_allowed

#: Statuses that redirect and how many redirects are followed.
REDIRECTS = [301, 302, 303, 307, 308]
MOST_HOPS = 3
#: Fixed value: pages of a site that are visited.
MOST_PAGES = 50


def resolve(base: Column, location: Column) -> Column:
    """location as seen from base: absolute, by scheme, by root, by query or by
    folder, without dot segments; null where there is nothing to resolve."""
    loc = F.trim(location)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = urls.path(base)
    folder = F.regexp_replace(path, "[^/]*$", "")
    tail = F.regexp_extract(loc, r"([?#].*)$", 1)
    bare = F.regexp_replace(loc, r"[?#].*$", "")
    full = F.when(bare == "", path).when(bare.startswith("/"), bare).otherwise(F.concat(folder, bare))
    step = lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))
    parts = F.split(F.regexp_replace(full, "^/", ""), "/")
    flat = F.aggregate(parts, F.array().cast("array<string>"), step)
    last = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(flat) > 0), F.lit("/")).otherwise(F.lit(""))
    near = F.concat(origin, F.lit("/"), F.array_join(flat, "/"), last, tail)
    return (
        F.when(loc.isNull() | (loc == ""), F.lit(None).cast("string"))
        .when(loc.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(loc.rlike(r"^(?i)https?://[^/?#]+$"), F.concat(loc, F.lit("/"))).otherwise(loc))
        .when(loc.startswith("//"), F.concat(urls.scheme(base), F.lit(":"), loc))
        .when(origin == "", F.lit(None).cast("string"))
        .otherwise(near)
    )


def redirect_chains(starts: DataFrame, hops: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """starts: id, url.  hops: url, status, location, a row a url that was
    fetched.  id, ``url``, ``final_url``, ``status``, ``chain_length``,
    ``looped`` and ``reason``.

    From each url a redirect with a location is followed, most times at the
    furthest; one that leads where no fetch may go ends in CONNECTION_REFUSED.  A
    location that does not resolve, or none, ends the chain at the redirect
    itself.  reason is null for a page that came; HTTP_4xx and HTTP_5xx by the
    last status; CONNECTION_REFUSED for a url that was not fetched or may not be.
    looped says that a chain came back to a url it had.  Of several rows of a url
    the one with the least status and location counts.  Where a redirect leads is worked out once a
    fetched url; a round joins the chains with these, so there is a shuffle of
    narrow rows for each hop that is allowed."""
    went = hops.groupBy("url").agg(F.min(F.struct("status", "location")).alias("h")).select(F.col("url").alias("_at"), "h.status", "h.location")
    target = F.when(F.col("status").isin(REDIRECTS), resolve(F.col("_at"), F.col("location")))
    known = went.select("_at", F.col("status").alias("_status"), target.alias("_next")).withColumn("_public", urls.is_public(F.col("_next")))
    none, first = F.lit(None), F.col("url")
    x = starts.select("id", "url", first.alias("final_url"), F.array("url").alias("_seen"), urls.is_public(first).alias("_open"), none.cast("int").alias("status"), F.when(~urls.is_public(first), F.lit("CONNECTION_REFUSED")).alias("reason"))
    for k in range(most + 1):
        goes = F.col("_next").isNotNull() & F.lit(k < most)
        step = F.col("_open") & goes & F.coalesce("_public", F.lit(False))
        end = F.col("_open") & ~step
        refused = goes | F.col("_status").isNull()
        x = x.join(known, F.col("final_url") == F.col("_at"), "left").select(
            "id", "url", F.when(step, F.col("_next")).otherwise(F.col("final_url")).alias("final_url"), F.when(step, F.concat("_seen", F.array("_next"))).otherwise(F.col("_seen")).alias("_seen"), step.alias("_open"),
            F.when(end & ~refused, F.col("_status")).otherwise(F.col("status")).alias("status"), F.when(end, F.when(refused, F.lit("CONNECTION_REFUSED")).otherwise(urls.status_failure(F.col("_status")))).otherwise(F.col("reason")).alias("reason"),
        )
    return x.select("id", "url", "final_url", "status", (F.size("_seen") - 1).alias("chain_length"), (F.size(F.array_distinct("_seen")) < F.size("_seen")).alias("looped"), "reason")


def crawl_order(sites: DataFrame, links: DataFrame, sitemap: DataFrame, robots: DataFrame, agent: str, most: int | Column = MOST_PAGES) -> DataFrame:
    """Which pages of a site a crawl visits and in what order.

    sites: site_id, start_url.  links: site_id, pos, url, the links of its start
    page in their order.  sitemap: site_id, pos, url, priority.  robots: site_id,
    status, body.  site_id, ``place`` (1 is the start page), ``url``, ``source``.

    A site with a sitemap is crawled by it, highest priority first, else by its
    links, most telling kind of path first; equals as they stand.  Left out are
    urls where no fetch may go, of another site, forbidden by robots.txt, and a
    url that came before.  A site whose start url may not be fetched, or that
    robots.txt forbids, has no rows.  most: pages of a site, a number or a column
    of sites.  Candidates are filtered and cut to the first of each url before
    they are ranked within their site."""
    s = sites.select("site_id", urls.normalize(F.col("start_url")).alias("start_url"), (F.lit(most) if isinstance(most, int) else most).alias("_most"))
    s = robots_allowed(s.where(urls.is_public(F.col("start_url"))).withColumnRenamed("start_url", "url"), robots, agent).where("allowed").select("site_id", F.col("url").alias("_start"), "_most")
    mapped = sitemap.select("site_id", F.lit("sitemap").alias("source"), F.struct((-F.coalesce("priority", F.lit(0.0))).alias("first"), F.col("pos").cast("long").alias("pos")).alias("at"), "url")
    linked = links.select("site_id", F.lit("links").alias("source"), F.struct(urls.crawl_priority(F.col("url")).cast("double").alias("first"), F.col("pos").cast("long").alias("pos")).alias("at"), "url")
    has = sitemap.select("site_id").distinct().withColumn("_mapped", F.lit(True))
    found = mapped.unionByName(linked.join(has, "site_id", "left_anti"))
    found = found.where(urls.is_public(F.col("url"))).join(s, "site_id").where(urls.same_site(F.col("url"), F.col("_start")) & (F.col("url") != F.col("_start")))
    found = found.groupBy("site_id", "source", "url", "_most").agg(F.min("at").alias("at"))
    found = robots_allowed(found, robots, agent).where("allowed")
    place = F.row_number().over(Window.partitionBy("site_id").orderBy("at", "url")) + 1
    rest = found.withColumn("place", place).where(F.col("place") <= F.col("_most")).select("site_id", "place", "url", "source")
    return s.where("_most > 0").select("site_id", F.lit(1).alias("place"), F.col("_start").alias("url"), F.lit("start").alias("source")).unionByName(rest)
