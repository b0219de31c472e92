"""Text scores, lists in answers, exclusion, templates, budgets, scopes and
sitemaps over the driver's tables in their roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import channels, citations, competitors, platform, recommend, site_text
from ..sources import artefacts, sitemaps
from .common import spread, table

RULES = ["SEO-CANONICAL-001", "PERF-LCP-001", "GEO-REVIEW-001", "SEO-TITLE-001", "SEO-H1-001", "AEO-FAQ-001"]
SOURCES = ["website", "naver_place", "other"]
KINDS = ["review", "map", "blog", "reservation"]


def text_scores(spark, d):
    """Whole documents with their first eight words as title."""
    t = F.col("text")
    title = F.array_join(F.slice(F.split(F.coalesce(t, F.lit("")), " "), 1, 8), " ")
    third = lambda c: F.floor(c * 1000 + 0.5).cast("long")
    return spread(table(spark, d, "documents")).select(
        "doc_id", T.occurrences(t, F.lit("An")).alias("occurrences"), third(T.keyword_density(t, F.lit("an")) * 10).alias("density"), third(T.readability(t)).alias("readability"), third(T.alignment(title, F.coalesce(t, F.lit("")))).alias("alignment"), T.recommendation_quality(t).alias("quality"),
    )


def listed_names(spark, d):
    """Parts as answers with numbered lists."""
    k = F.col("p_partkey")
    answer = F.concat(F.lit("ok\n[추천업체]\n\n1. n"), k % 5, F.lit(" (a)\n2) 'n"), k % 3, F.lit("' - b\n3. n"), k % 5, F.lit("\nend\n4. no"))
    return table(spark, d, "part").select("p_partkey", F.array_join(citations.listed_names(answer, F.lit("n0")), ",").alias("names"))


def rivals_after_exclusion(spark, d):
    """Customers as rivals on hosts by number; a nation excludes one host."""
    k = F.col("c_custkey")
    host = F.concat(F.when(k % 4 == 0, "").when(k % 4 == 1, "www.").when(k % 4 == 2, "a.b.").otherwise("x"), F.lit("shop"), k % 10, F.when(k % 6 == 0, ".mall").otherwise(".example"))
    rivals = table(spark, d, "customer").select(F.col("c_nationkey").alias("site_id"), k.alias("rival"), F.concat(F.lit("https://"), host, F.lit("/p")).alias("url"), F.when(k % 7 == 0, "The List").alias("name"))
    excluded = table(spark, d, "nation").select(F.col("n_nationkey").alias("site_id"), F.concat(F.lit("https://www.shop"), F.col("n_nationkey") % 10, F.lit(".example/x")).alias("excluded_url"))
    return competitors.drop_excluded(rivals, excluded, words=["list"], hosts=[".mall"]).select("site_id", "rival", "url")


def recommendation_texts(spark, d):
    """Part names as recommendations; rules of some sizes have templates."""
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item"), (F.col("p_partkey") % 50).alias("site_id"), F.concat(F.lit("R"), F.col("p_size") % 4).alias("rule_id"), F.col("p_name").alias("text"))
    templates = spark.createDataFrame([("R0", "{name} 고객이 검색할 때 보이도록 예: 메뉴 3개와 가격을 홈페이지 첫 화면에 적어 두면 도움이 돼요. {x}"), ("R1", "short {name}")], "rule_id string, template string")
    profiles = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("site_id"), F.create_map(F.lit("name"), F.col("n_name")).alias("values"))
    return recommend.improve(items, templates, profiles).select("item", "text", "source", "quality")


def provider_choice(spark, d):
    """Events as requests of their day: what providers served and what it cost."""
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("pos"))
    providers = spark.createDataFrame([(2, "local", 0.0, 0.0), (1, "paid", 0.5, 1.0)], "rank int, provider string, usd_in double, usd_out double")
    x = recommend.choose_provider(e, providers, 3.0)
    return x.groupBy("day", "provider", "alert").agg(F.count(F.lit(1)).alias("requests"), F.floor(F.sum("usd") * 1000 + 0.5).cast("long").alias("usd_thousandths"))


def scoped_results(spark, d):
    """Lines as rule results of surfaces by their numbers."""
    of = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (F.col(c) % len(values) + 1).cast("int"))
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", of(RULES, "l_partkey").alias("rule_id"), of(SOURCES, "l_suppkey").alias("source_type"), of(KINDS, "l_orderkey").alias("surface_kind"), (F.col("l_partkey") % 4 == 0).alias("passed"), (F.col("l_partkey") % 8).cast("int").alias("rule_weight"), F.lit("high").alias("severity"), F.lit("high").alias("expected_impact"))
    return platform.apply_scope(r).select("l_orderkey", "l_linenumber", "scope", "passed", "rule_weight", "severity")


def merged_presence(spark, d):
    """Orders as sites, their lines as surfaces."""
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("site_id"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey")).alias("pos"), F.when(F.col("l_partkey") % 3 == 0, " ").when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("p"), "l_partkey")).alias("name"), F.when(F.col("l_suppkey") % 4 != 0, F.array(F.concat(F.lit("s"), F.col("l_suppkey") % 5), F.concat(F.lit("p"), F.col("l_partkey") % 3))).alias("services"))
    m = platform.merge_presence(x)
    return m.select("site_id", "name", F.array_join("services", ",").alias("services"))


def sitemap_places(spark, d):
    """Parts as sites with a sitemap of three entries, or an index."""
    k = F.col("p_partkey")
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="x"><url><loc> https://e/'), k, F.lit("?a=1&amp;b=2</loc></url><ns:url>\n<ns:loc>https://e/b</ns:loc><ns:priority>0."), k % 10, F.lit("</ns:priority></ns:url><url><loc>https://e/c</loc><priority>0.5</priority></url></urlset>"))
    index = F.lit("<sitemapindex><sitemap><loc>https://e/s1.xml</loc></sitemap><sitemap><loc>https://e/s2.xml</loc></sitemap></sitemapindex>")
    x = table(spark, d, "part").select(k.alias("site_id"), F.when(k % 7 == 0, index).when(k % 7 == 1, "no sitemap").otherwise(xml).alias("xml"))
    return sitemaps.sitemap_order(sitemaps.sitemap_urls(x)).select("site_id", F.col("place").cast("int").alias("place"), "url", "kind")


def missing_topics(spark, d):
    """Expected topics that a whole document lacks."""
    expected = F.array(F.lit("An"), F.lit("ation"), F.lit("Zzz"), F.lit("heit"))
    found = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("zzz"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "documents").select("doc_id", F.array_join(site_text.missing_topics(expected, found, F.coalesce("text", F.lit(""))), ",").alias("missing"))


def viewports(spark, d):
    """Pages as they are, with a viewport by their number put before them."""
    mark = F.element_at(F.array(F.lit(""), F.lit('<META name="viewport" content="width=device-width, initial-scale=1">'), F.lit("<meta name='viewport' content='width=500'>")), (F.col("page_id") % 3 + 1).cast("int"))
    html = F.concat(mark, F.coalesce("html", F.lit("")))
    return table(spark, d, "pages").select("page_id", channels.viewport(html).alias("viewport"), channels.missing_viewport(html).alias("missing"))


def action_links(spark, d):
    """Orders as diagnoses: lines shipped by some suppliers as rivals, returned
    ones as gap rows, all as actions."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("diagnosis_id"), F.col("l_linenumber").alias("pos")).agg(F.min("l_suppkey").alias("s"), F.max("l_returnflag").alias("flag"))
    of = artefacts.linked(x.where("s % 3 = 0").select("diagnosis_id", "pos"), x.where("flag = 'R'").select("diagnosis_id", "pos"), x.select("diagnosis_id", "pos", F.concat(F.lit("a"), "s").alias("action_ref")))
    return of["actions"].select("diagnosis_id", "pos", "action_ref")


QUERIES = {f.__name__: f for f in (missing_topics, viewports, action_links, text_scores, listed_names, rivals_after_exclusion, recommendation_texts, provider_choice, scoped_results, merged_presence, sitemap_places)}

_BREAK = r"""'[\s.,!?;:()\[\]{}"''“”‘’·…/|<>]+'"""
_words = lambda t, n=1: f"list_filter(regexp_split_to_array({t}, {_BREAK}), lambda w: length(w) >= {n})"
_trimmed = lambda parts: f"list_filter({parts}, lambda s: trim(s) <> '')"
_quality = lambda t: (
    f"greatest(0, 100 - CASE WHEN length({t}) < 20 THEN 40 WHEN length({t}) < 50 THEN 15 WHEN length({t}) > 300 THEN 20 WHEN length({t}) > 200 THEN 10 ELSE 0 END - CASE WHEN len(regexp_extract_all({t}, '하세요|하십시오|해주세요|바랍니다')) > 3 THEN 15 ELSE 0 END"
    f" - CASE WHEN length(regexp_replace({t}, '[^A-Za-z]', '', 'g')) > 0.3 * length({t}) THEN 15 ELSE 0 END - CASE WHEN regexp_matches({t}, '\\d|예:|예를|처럼|''[^'']+''') THEN 0 ELSE 15 END - CASE WHEN regexp_matches({t}, '고객|방문|검색|AI|홈페이지|업체') THEN 0 ELSE 10 END)::INT"
)
_case = lambda values, key: "CASE " + key + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"

ORACLE_SQL = {
    "missing_topics": "SELECT doc_id, concat_ws(',', CASE WHEN NOT contains(l, 'an') THEN 'An' END, CASE WHEN NOT contains(l, 'ation') THEN 'ation' END, CASE WHEN doc_id % 2 = 1 AND NOT contains(l, 'zzz') THEN 'Zzz' END, CASE WHEN NOT contains(l, 'heit') THEN 'heit' END) AS missing FROM (SELECT doc_id, lower(coalesce(text, '')) AS l FROM documents)",
    "viewports": """WITH h AS (SELECT page_id, ['', '<META name="viewport" content="width=device-width, initial-scale=1">', '<meta name=''viewport'' content=''width=500''>'][page_id % 3 + 1] || coalesce(html, '') AS h FROM pages),
      v AS (SELECT page_id, nullif(regexp_extract(h, '(?i)<meta\\s+name=["'']viewport["'']\\s+content=["'']([^"'']*)["'']', 1), '') AS v FROM h)
      SELECT page_id, v AS viewport, NOT (contains(coalesce(v, ''), 'width=device-width') OR contains(coalesce(v, ''), 'width=100%')) AS missing FROM v""",
    "action_links": """WITH x AS (SELECT l_orderkey AS k, l_linenumber AS pos, min(l_suppkey) AS s, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2), r AS (SELECT DISTINCT k FROM x WHERE s % 3 = 0),
      g AS (SELECT k, sha256('gap|' || k || '|' || pos) AS id, row_number() OVER (PARTITION BY k ORDER BY pos) AS n FROM x JOIN r USING (k) WHERE flag = 'R'), a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) AS n FROM x)
      SELECT k AS diagnosis_id, pos, coalesce(id, 'a' || s) AS action_ref FROM a LEFT JOIN g USING (k, n)""",
    "text_scores": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS l FROM documents),
      u AS (SELECT *, {_words("l")} AS w, {_words("t")} AS v, len({_trimmed("regexp_split_to_array(t, '[.!?。！？\\n]+')")}) AS s, len({_trimmed("regexp_split_to_array(t, '\\n\\s*\\n')")}) AS p, list_distinct({_words("lower(array_to_string(string_split(t, ' ')[1:8], ' '))", 2)}) AS h FROM t)
      SELECT doc_id, ((length(l) - length(replace(l, 'an', ''))) / 2)::INT AS occurrences, CAST(floor(CASE WHEN len(w) = 0 THEN 0 ELSE floor(len(list_filter(w, lambda x: contains(x, 'an'))) / len(w) * 10000 + 0.5) / 10000 END * 10 * 1000 + 0.5) AS BIGINT) AS density,
        CAST(floor(greatest(0, least(100, 100 - greatest(0, CASE WHEN s > 0 THEN len(v) / s ELSE 0 END - 25) - 5 * greatest(0, CASE WHEN p > 0 THEN s / p ELSE 0 END - 5))) * 1000 + 0.5) AS BIGINT) AS readability,
        CAST(floor(CASE WHEN len(h) = 0 THEN 0 ELSE len(list_filter(h, lambda x: contains(l, x))) / len(h) END * 1000 + 0.5) AS BIGINT) AS alignment, {_quality("t")} AS quality FROM u""",
    "listed_names": "SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 5 <> 0 THEN 'n' || (p_partkey % 5) END, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 3 <> p_partkey % 5 THEN 'n' || (p_partkey % 3) END) AS names FROM part",
    "rivals_after_exclusion": """SELECT c_nationkey AS site_id, c_custkey AS rival, 'https://' || CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'www.' WHEN 2 THEN 'a.b.' ELSE 'x' END || 'shop' || (c_custkey % 10) || '.example/p' AS url FROM customer
      WHERE c_custkey % 6 <> 0 AND c_custkey % 7 <> 0 AND NOT (c_custkey % 4 <> 3 AND c_custkey % 10 = c_nationkey % 10)""",
    "recommendation_texts": f"""WITH i AS (SELECT p_partkey AS item, p_name AS old, coalesce(n_name, '{{name}}') AS n, p_size % 4 AS r FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 50),
      j AS (SELECT *, CASE r WHEN 0 THEN n || ' 고객이 검색할 때 보이도록 예: 메뉴 3개와 가격을 홈페이지 첫 화면에 적어 두면 도움이 돼요. {{x}}' WHEN 1 THEN 'short ' || n END AS new FROM i), q AS (SELECT *, {_quality("old")} AS a, {_quality("coalesce(new, '')")} AS b FROM j)
      SELECT item, CASE WHEN new IS NOT NULL AND a < 70 AND b > a THEN new ELSE old END AS text, CASE WHEN new IS NOT NULL AND a < 70 AND b > a THEN 'template' ELSE 'rule' END AS source, CASE WHEN new IS NOT NULL AND a < 70 AND b > a THEN b ELSE a END AS quality FROM q""",
    "provider_choice": """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS n FROM events)
      SELECT day, CASE WHEN n <= 10 THEN 'paid' ELSE 'local' END AS provider, CASE WHEN n >= 10 THEN 'exhausted' WHEN n >= 8 THEN 'near_limit' END AS alert, count(*) AS requests, sum(CASE WHEN n <= 10 THEN 300 ELSE 0 END)::BIGINT AS usd_thousandths FROM e GROUP BY 1, 2, 3""",
    "scoped_results": f"""WITH r AS (SELECT *, {_case(RULES, f"l_partkey % {len(RULES)}")} AS rule, {_case(SOURCES, f"l_suppkey % {len(SOURCES)}")} AS src, {_case(KINDS, f"l_orderkey % {len(KINDS)}")} AS kind, l_partkey % 8 AS w FROM lineitem),
      s AS (SELECT *, CASE WHEN src = 'website' THEN 'scored' WHEN rule LIKE 'SEO-CANONICAL%' OR rule LIKE 'PERF-%' THEN 'ignored' WHEN kind IN ('review', 'map', 'reservation') THEN CASE WHEN kind = 'review' AND rule LIKE 'GEO-REVIEW%' THEN 'scored' ELSE 'ignored' END
        WHEN rule LIKE 'GEO-%' OR rule LIKE 'AEO-%' OR rule LIKE 'SEO-TITLE%' THEN 'scored' ELSE 'reweighted' END AS scope FROM r)
      SELECT l_orderkey, l_linenumber, scope, l_partkey % 4 = 0 OR scope = 'ignored' AS passed, CASE WHEN scope = 'ignored' THEN 0 WHEN scope = 'reweighted' THEN ceil(w / 2) ELSE w END::INT AS rule_weight, CASE scope WHEN 'ignored' THEN 'low' ELSE 'high' END AS severity FROM s""",
    "merged_presence": """WITH n AS (SELECT l_orderkey AS site_id, arg_min('p' || l_partkey, (l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey) FILTER (l_partkey % 3 = 1) AS name FROM lineitem GROUP BY 1),
      s AS (SELECT l_orderkey AS site_id, 's' || (l_suppkey % 5) AS s, ((l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey) * 2 AS o FROM lineitem WHERE l_suppkey % 4 <> 0 UNION ALL SELECT l_orderkey, 'p' || (l_partkey % 3), ((l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey) * 2 + 1 FROM lineitem WHERE l_suppkey % 4 <> 0),
      g AS (SELECT site_id, s, min(o) AS o FROM s GROUP BY 1, 2), l AS (SELECT site_id, string_agg(s, ',' ORDER BY o) AS services FROM g GROUP BY 1) SELECT site_id, name, coalesce(services, '') AS services FROM n LEFT JOIN l USING (site_id)""",
    "sitemap_places": """WITH k AS (SELECT p_partkey AS k, p_partkey % 10 AS p FROM part WHERE p_partkey % 7 > 1), u AS (SELECT k, 0 AS pos, 'https://e/' || k || '?a=1&b=2' AS url, 0 AS r FROM k UNION ALL SELECT k, 1, 'https://e/b', p FROM k UNION ALL SELECT k, 2, 'https://e/c', 5 FROM k)
      SELECT k AS site_id, row_number() OVER (PARTITION BY k ORDER BY r DESC, pos)::INT AS place, url, 'url' AS kind FROM u UNION ALL SELECT p_partkey, 1, 'https://e/s1.xml', 'index' FROM part WHERE p_partkey % 7 = 0""",
}
