"""Pages to rule results, scores and actions, a site a host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import scoring
from ..operators.rules import RULES, evaluate, rule_table, site_context, with_measures
from ..operators.rules.context import link_depth
from ..sources.pages import parse_pages
from ..sources.shared import cut
from .common import spread, table


def parsed(spark: SparkSession, d: str) -> DataFrame:
    p = spread(table(spark, d, "pages"))
    return parse_pages(p.select(urls.site(F.col("url")).alias("site_id"), F.col("page_id").alias("pos"), "url", "html", F.lit(200).alias("status_code")))


def sites(spark: SparkSession, d: str) -> DataFrame:
    """The hosts, from the urls alone, so that pages are parsed once."""
    found = table(spark, d, "pages").select(urls.site(F.col("url")).alias("site_id")).distinct()
    return found.selectExpr("site_id", "string(null) start_url", "false sitemap_used", "string(null) http_protocol", "int(null) redirect_chain_length")


def results(spark: SparkSession, d: str, rules: list | None = None) -> DataFrame:
    return evaluate(with_measures(site_context(parsed(spark, d), sites=sites(spark, d))), rules)


#: The rules that count in scores; without measurements those of PERF do not.
SCORED = [r for r in RULES if r.category in scoring.CATEGORY_WEIGHT and r.category != "PERF"]


def host_pages(spark, d):
    return parsed(spark, d).select("site_id", "url", "title", "h1", "word_count", F.size("internal_links").alias("internal_links"), F.size("headings").alias("headings"), F.array_join("a11y", ",").alias("a11y"))


def host_rule_results(spark, d):
    """All rules; clicks are counted from a host's first url."""
    p = cut(parsed(spark, d))
    depth = link_depth(p, p.groupBy("site_id").agg(F.min("url").alias("start_url"))).withColumnRenamed("depth", "link_depth")
    context = with_measures(site_context(p, sites=sites(spark, d))).join(depth, "site_id", "left")
    return evaluate(context).select("site_id", "rule_id", "category", "passed", "severity", "rule_weight", "score_impact")


def host_scores(spark, d):
    s = scoring.overall_scores(scoring.category_scores(results(spark, d, SCORED)))
    return s.withColumn("grade", scoring.grade(F.col("overall"))).withColumn("signal", scoring.traffic_signal(F.col("overall")))


def host_actions(spark, d):
    items = scoring.execution_order(scoring.diagnosis_items(results(spark, d)))
    return items.select("site_id", "position", "rule_id", "category", "priority", "impact_score", "action_type", "difficulty")


def host_action_counts(spark, d):
    return scoring.action_counts(scoring.diagnosis_items(results(spark, d)))


def host_link_depth(spark, d):
    p = parsed(spark, d).select("site_id", "url", "internal_links")
    return link_depth(p, p.groupBy("site_id").agg(F.min("url").alias("start_url")))


URL_RULES = ["SEO-PAGE-DEPTH-001", "SEO-DUPLICATE-CONTENT-001", "SEO-TRAILING-SLASH-001"]


def host_url_rules(spark, d):
    """The rules that only look at all urls of a host."""
    r = results(spark, d, [r for r in RULES if r.rule_id in URL_RULES])
    return r.select("site_id", "rule_id", "passed", "score_impact")


def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.site(u).alias("site"), urls.path(u).alias("path"), urls.path_depth(u).alias("depth"), urls.is_public(u).alias("is_public"), urls.crawl_priority(u).alias("crawl_priority"))


def rule_catalogue(spark, d):
    return rule_table(spark)


QUERIES = {f.__name__: f for f in (host_pages, host_rule_results, host_scores, host_actions, host_action_counts, host_link_depth, host_url_rules, url_parts, rule_catalogue)}

_PARTS = """p AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM pages),
q AS (SELECT *, regexp_replace(host, '^www\\.', '') AS site, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS depth FROM p)"""

#: Whether a fetch may go to a url, found from the whole url.
_PUBLIC = """v AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS kind, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)', 1)) AS h FROM q),
w AS (SELECT *, CASE WHEN regexp_matches(h, '^[0-9]{1,3}([.][0-9]{1,3}){3}$') THEN TRY_CAST(split_part(h, '.', 1) AS INT) END AS a, TRY_CAST(split_part(h, '.', 2) AS INT) AS b FROM v),
x AS (SELECT *, coalesce(kind IN ('http', 'https') AND h NOT IN ('', 'localhost', 'metadata.google.internal') AND NOT regexp_matches(h, '[.](localhost|local|internal)$') AND NOT regexp_matches(h, '^\\[(::1?|f[cd].*|fe[89ab].*|::ffff:.*)\\]$')
  AND NOT coalesce(a IN (0, 10, 127) OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 198 AND b IN (18, 19)), false), false) AS is_public FROM w)"""

ORACLE_SQL = {
    "url_parts": f"WITH {_PARTS}, {_PUBLIC} SELECT page_id, scheme, host, site, path, depth::INT AS depth, is_public, CASE WHEN regexp_matches(lower(path), '/faq') THEN 0 WHEN regexp_matches(lower(path), '/about') THEN 1 WHEN regexp_matches(lower(path), '/services?') THEN 2 WHEN regexp_matches(lower(path), '/contact') THEN 3 WHEN regexp_matches(lower(path), '/products?') THEN 4 ELSE 5 END AS crawl_priority FROM x",
    "host_url_rules": f"""WITH {_PARTS}, s AS (SELECT site AS site_id, max(depth) <= 3 AS d, count(DISTINCT url) = count(*) AS u, count(*) FILTER (path <> '/') AS n, count(*) FILTER (path <> '/' AND ends_with(path, '/')) AS e FROM q GROUP BY 1)
      SELECT site_id, 'SEO-PAGE-DEPTH-001' AS rule_id, d AS passed, NULL::VARCHAR AS score_impact FROM s UNION ALL SELECT site_id, 'SEO-DUPLICATE-CONTENT-001', u, NULL FROM s
      UNION ALL SELECT site_id, 'SEO-TRAILING-SLASH-001', n < 2 OR e = 0 OR e = n, CASE WHEN n < 2 THEN 'not_applicable' END FROM s""",
}
