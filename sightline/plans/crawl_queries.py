"""robots.txt, redirects and crawl orders over the driver's tables in their roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crawl, robots
from .common import pick, pick_sql, spread, table

AGENT = "Sightline-Bot"
FOLDERS = ["a", "b", "a/b", "shop", "shop/new", "B", "x.y", ""]
ENDS = ["", "/", "/index.html", "/p.php?id=1", "?q=a", "/a/b/c.html#top", ".html", "/new$"]
SHAPES = ["Disallow: /{0}", "Allow: /{1}/", "disallow:/*.html$", "ALLOW : /{0}/*/c", "Disallow:", "Disallow: /*?", "Allow: /{1}  # kept", "Crawl-delay: 3", "# only a remark", "Disallow: /{0}.(html)+", "Allow: /"]
NAMES = ["*", AGENT, "other", "SIGHTLINE-BOT"]


def _body(k):
    """Six rule lines after three agents, at places that follow from k."""
    line = lambda n: F.replace(F.replace(pick(SHAPES, k * 5 + n * 3), F.lit("{0}"), pick(FOLDERS, k + n)), F.lit("{1}"), pick(FOLDERS, k * 3 + n))
    agent = lambda n: F.concat(F.lit("User-Agent: "), pick(NAMES, F.floor(k / 3) + n))
    return F.concat_ws("\n", agent(0), line(0), line(1), agent(1), F.when(k % 2 == 0, agent(2)), line(2), line(3), line(4), F.when(k % 5 == 0, F.concat(agent(0), F.lit("\r\n"), line(5))))


def _body_sql(k: str) -> str:
    line = lambda n: f"replace(replace({pick_sql(SHAPES, f'{k} * 5 + {n * 3}')}, '{{0}}', {pick_sql(FOLDERS, f'{k} + {n}')}), '{{1}}', {pick_sql(FOLDERS, f'{k} * 3 + {n}')})"
    agent = lambda n: f"'User-Agent: ' || {pick_sql(NAMES, f'{k} // 3 + {n}')}"
    return f"concat_ws(chr(10), {agent(0)}, {line(0)}, {line(1)}, {agent(1)}, CASE WHEN {k} % 2 = 0 THEN {agent(2)} END, {line(2)}, {line(3)}, {line(4)}, CASE WHEN {k} % 5 = 0 THEN {agent(0)} || chr(13) || chr(10) || {line(5)} END)"


def robots_checks(spark, d):
    """Customers as sites with a robots.txt of their own, events as their pages."""
    c = F.col("c_custkey")
    files = table(spark, d, "customer").select(c.alias("site_id"), F.when(c % 13 == 0, 404).otherwise(200).alias("status"), F.when(c % 17 != 0, _body(c)).alias("body"))
    i = F.col("event_id")
    url = F.concat(F.lit("https://e.example/"), pick(FOLDERS, i), pick(ENDS, F.floor(i / 8)))
    pages = table(spark, d, "events").select("event_id", (i % 200).alias("site_id"), url.alias("url"))
    return robots.robots_allowed(pages, files, AGENT).select("event_id", "allowed")


def _hops(spark, d):
    """Events as fetched urls: a third redirect, to absolute, host or root urls,
    to folders beside them, to nowhere or to where no fetch may go."""
    i = F.col("event_id")
    j = (i * 7 + 3) % 1000
    name = lambda k: F.concat(F.lit("https://h"), k % 5, F.lit(".example/d/p"), k)
    location = F.when(i % 11 == 0, name(j)).when(i % 11 == 1, F.concat(F.lit("//h"), j % 5, F.lit(".example/d/p"), j)).when(i % 11 == 2, F.concat(F.lit("/d/p"), i + 5)).when(i % 11 == 3, F.concat(F.lit("../d/./p"), i - 5)).when(i % 11 == 4, F.lit("http://10.0.0.8/")).when(i % 11 == 5, F.lit("")).when(i % 11 == 6, F.concat(F.lit("p"), i))
    status = F.when(i % 11 < 7, pick([301, 302, 307, 308, 303], i)).otherwise(pick([200, 404, 200, 503, 300], i))
    return table(spark, d, "events").where(i % 97 != 0).select(name(i).alias("url"), status.alias("status"), location.alias("location"))


def redirect_chains(spark, d):
    """Events as urls to fetch, over the stand-in table of what was fetched."""
    i = F.col("event_id")
    starts = table(spark, d, "events").select(i.alias("id"), F.concat(F.lit("https://h"), i % 5, F.lit(".example/d/p"), i).alias("url"))
    return crawl.redirect_chains(starts, _hops(spark, d)).withColumnRenamed("id", "event_id")


KINDS = ["faq", "about-us", "x", "Services", "contact", "product", "no", "no/deep"]


def crawl_orders(spark, d):
    """Orders as sites, their lines as links, every third site with a sitemap of
    its lines too; budgets by the order's number."""
    o, n = F.col("o_orderkey"), F.col("l_linenumber")
    host = lambda k: F.concat(F.lit("https://s"), k, F.lit(".example"))
    sites = table(spark, d, "orders").select(o.alias("site_id"), F.when(o % 19 == 0, "http://localhost").otherwise(host(o)).alias("start_url"), (o % 6).alias("budget"))
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    x = spread(table(spark, d, "lineitem")).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_discount").alias("l_discount"))
    url = F.concat(F.when(p % 7 == 0, F.lit("https://other.example")).when(p % 7 == 1, F.concat(F.lit("https://www.s"), k, F.lit(".example"))).otherwise(host(k)), F.lit("/"), pick(KINDS, p), F.when(p % 3 == 0, "").otherwise(F.concat(F.lit("/"), p % 2)))
    links = x.select(k.alias("site_id"), n.alias("pos"), url.alias("url"))
    sitemap = x.where(k % 3 == 0).select(k.alias("site_id"), n.alias("pos"), url.alias("url"), F.when(n % 2 == 0, F.col("l_discount")).alias("priority"))
    files = table(spark, d, "orders").where(o % 4 == 0).select(o.alias("site_id"), F.lit(200).alias("status"), F.lit("User-agent: *\nDisallow: /no\nAllow: /no/deep/1\n").alias("body"))
    return crawl.crawl_order(sites, links, sitemap, files, AGENT, F.col("budget"))


QUERIES = {f.__name__: f for f in (robots_checks, redirect_chains, crawl_orders)}

_NAME = lambda k: f"'https://h' || ({k}) % 5 || '.example/d/p' || ({k})"

ORACLE_SQL = {
    "robots_checks": f"""WITH l AS (SELECT k, n, trim(regexp_replace(x, '#.*', '')) AS x FROM (SELECT c_custkey AS k, unnest(regexp_split_to_array({_body_sql("c_custkey")}, '\\r\\n|\\r|\\n')) AS x, generate_subscripts(regexp_split_to_array({_body_sql("c_custkey")}, '\\r\\n|\\r|\\n'), 1) AS n FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 17 <> 0)),
      f AS (SELECT k, n, lower(trim(split_part(x, ':', 1))) AS name, trim(substr(x, strpos(x, ':') + 1)) AS v FROM l WHERE contains(x, ':')),
      g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY n) AS g FROM (SELECT *, (name = 'user-agent' AND coalesce(lag(name) OVER (PARTITION BY k ORDER BY n), '') <> 'user-agent')::INT AS new FROM f)),
      a AS (SELECT DISTINCT k, g, lower(v) AS agent FROM g WHERE name = 'user-agent' AND lower(v) IN ('*', '{AGENT.lower()}')), own AS (SELECT k, bool_or(agent <> '*') AS own FROM a GROUP BY 1),
      r AS (SELECT a.k, v, name = 'allow' AS allow FROM g JOIN a USING (k, g) JOIN own USING (k) WHERE name IN ('allow', 'disallow') AND v <> '' AND (agent <> '*') = own),
      q AS (SELECT k, length(v) AS n, allow, '(?s)^' || replace(regexp_replace(CASE WHEN ends_with(v, '$') THEN v[:-2] ELSE v END, '([\\\\.+?^${{}}()|\\[\\]])', '\\\\\\1', 'g'), '*', '.*') || CASE WHEN ends_with(v, '$') THEN '$' ELSE '' END AS p FROM r),
      e AS (SELECT event_id, event_id % 200 AS k, split_part('/' || {pick_sql(FOLDERS, "event_id")} || {pick_sql(ENDS, "event_id // 8")}, '#', 1) AS t FROM events),
      b AS (SELECT event_id, max(n * 2 + allow::INT) % 2 = 1 AS allowed FROM e JOIN q USING (k) WHERE regexp_matches(t, p) GROUP BY 1)
      SELECT event_id, coalesce(allowed, true) AS allowed FROM e LEFT JOIN b USING (event_id)""",
    "redirect_chains": f"""WITH RECURSIVE h AS (SELECT event_id AS i, {_NAME("event_id")} AS url, CASE WHEN event_id % 11 < 7 THEN {pick_sql([301, 302, 307, 308, 303], "event_id")} ELSE {pick_sql([200, 404, 200, 503, 300], "event_id")} END AS status,
        CASE event_id % 11 WHEN 0 THEN {_NAME("(event_id * 7 + 3) % 1000")} WHEN 1 THEN {_NAME("(event_id * 7 + 3) % 1000")} WHEN 2 THEN 'https://h' || event_id % 5 || '.example/d/p' || (event_id + 5) WHEN 3 THEN 'https://h' || event_id % 5 || '.example/d/p' || (event_id - 5)
          WHEN 4 THEN 'http://10.0.0.8/' WHEN 6 THEN {_NAME("event_id")} END AS t FROM events WHERE event_id % 97 <> 0),
      c AS (SELECT event_id, {_NAME("event_id")} AS url, {_NAME("event_id")} AS at, 0 AS k, [{_NAME("event_id")}] AS seen FROM events
        UNION ALL SELECT event_id, c.url, h.t, k + 1, list_append(seen, h.t) FROM c JOIN h ON h.url = c.at WHERE k < 3 AND h.status BETWEEN 301 AND 308 AND h.t IS NOT NULL AND NOT starts_with(h.t, 'http://10.')),
      z AS (SELECT event_id, max(k) AS k FROM c GROUP BY 1)
      SELECT c.event_id, c.url, c.at AS final_url, CASE WHEN refused THEN NULL ELSE h.status END AS status, c.k AS chain_length, len(list_distinct(seen)) < len(seen) AS looped, CASE WHEN refused THEN 'CONNECTION_REFUSED' WHEN h.status >= 500 THEN 'HTTP_5xx' WHEN h.status >= 400 THEN 'HTTP_4xx' END AS reason
      FROM c JOIN z ON c.event_id = z.event_id AND c.k = z.k LEFT JOIN h ON h.url = c.at, LATERAL (SELECT h.status IS NULL OR (c.k < 3 AND h.status BETWEEN 301 AND 308 AND coalesce(starts_with(h.t, 'http://10.'), false)) AS refused)""",
    "crawl_orders": f"""WITH s AS (SELECT o_orderkey AS k, 'https://s' || o_orderkey || '.example/' AS start, o_orderkey % 6 AS most FROM orders WHERE o_orderkey % 19 <> 0),
      x AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p, min(l_discount) AS v FROM lineitem GROUP BY 1, 2),
      u AS (SELECT k, n, v, CASE p % 7 WHEN 1 THEN 'https://www.s' ELSE 'https://s' END || k || '.example' AS h, '/' || {pick_sql(KINDS, "p")} || CASE WHEN p % 3 = 0 THEN '' ELSE '/' || p % 2 END AS path FROM x WHERE p % 7 <> 0),
      r AS (SELECT *, h || path AS url, CASE WHEN k % 3 = 0 THEN -CASE WHEN n % 2 = 0 THEN v ELSE 0 END WHEN contains(lower(path), '/faq') THEN 0 WHEN contains(lower(path), '/about') THEN 1 WHEN contains(lower(path), '/service') THEN 2 WHEN contains(lower(path), '/contact') THEN 3 WHEN contains(lower(path), '/product') THEN 4 ELSE 5 END AS f FROM u),
      g AS (SELECT k, url, min({{'f': f, 'n': n}}) AS o FROM r WHERE NOT (k % 4 = 0 AND starts_with(path, '/no') AND NOT starts_with(path, '/no/deep/1')) GROUP BY 1, 2),
      p AS (SELECT k, url, row_number() OVER (PARTITION BY k ORDER BY o, url) + 1 AS place, most FROM g JOIN s USING (k))
      SELECT k AS site_id, place::INT AS place, url, CASE WHEN k % 3 = 0 THEN 'sitemap' ELSE 'links' END AS source FROM p WHERE place <= most UNION ALL SELECT k, 1, start, 'start' FROM s WHERE most > 0""",
}
