"""Recorded answers of measuring services, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keywords
from ..sources import payloads
from .common import pick, pick_sql, table

BROKEN = ['{"lighthouseResult":', "[1, 2]", "<html>", "  ", '{"lighthouseResult":{"audits":{}}}', '{"lighthouseResult":{"categories":5,"audits":{}}}']
NAMES = ["<b>행복</b> 카페", "Clinic 1", "서울 병원", "A & B", "", "Café <i>x</i>", "치과 앞 식당"]
LINKS = ["https://shop{0}.example/p", " https://me.example/{0} ", "", "https://www.Instagram.com/{0}", "https://x{0}.example/hospital", None, "http://youtube.com/c"]
PLACES = ["서울 강남구 1", "", None, "Rue de l’Est 5"]


def _speed_body():
    """Audits by number, some missing, as strings or in place of the newer one;
    every seventh body is no such answer."""
    k = F.col("p_partkey")
    audit = lambda name, value: F.concat(F.lit(f'"{name}":{{"numericValue":'), value, F.lit("}"))
    audits = F.concat_ws(",", audit("largest-contentful-paint", F.concat(1000 + k % 3000, F.lit("."), k % 10)), F.when(k % 3 != 0, audit("max-potential-fid", F.concat(F.when(k % 5 == 0, '"').otherwise(""), k % 200, F.when(k % 5 == 0, '"').otherwise("")))),
                         audit("cumulative-layout-shift", F.concat(F.lit("0."), k % 40)), F.when(k % 4 != 0, audit("interaction-to-next-paint", F.when(k % 8 == 1, "null").otherwise((k % 400).cast("string")))), audit("interactive", k % 500), audit("server-response-time", k % 900))
    body = F.concat(F.lit('{"lighthouseResult":{"categories":{'), F.when(k % 11 != 0, F.concat(F.lit('"performance":{"score":0.'), 10 + k % 90, F.lit("}"))).otherwise(""), F.lit('},"audits":{'), audits, F.lit("}}}"))
    return F.when(k % 7 == 0, pick(BROKEN, F.floor(k / 7))).when(k % 29 != 0, body)


def speed_measures(spark, d):
    """Parts as sites whose speed was measured."""
    k = F.col("p_partkey")
    x = table(spark, d, "part").select(k.alias("site_id"), pick(["mobile", "desktop"], k).alias("strategy"), pick([200, 200, 200, None, 429], k).alias("status"), _speed_body().alias("body"))
    m = payloads.page_speed(x)
    whole = lambda c, n=1: F.floor(F.col(c) * n + 0.5).cast("long").alias(c)
    return m.select("site_id", "strategy", whole("performance"), whole("lcp"), whole("fid"), whole("cls", 1000), whole("inp"), whole("ttfb"), whole("fcp"), "problem")


def local_rivals(spark, d):
    """Customers as searches with up to five places each."""
    c = F.col("c_custkey")
    quoted = lambda v: F.when(v.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), v, F.lit('"')))
    place = lambda n: F.when(F.lit(n) <= c % 6, F.concat(F.lit('{"title":'), quoted(pick(NAMES, c * 3 + n)), F.lit(',"link":'), quoted(F.replace(pick(LINKS, c + n * 5), F.lit("{0}"), (c % 9).cast("string"))), F.lit(',"roadAddress":'), quoted(pick(PLACES, c + n)), F.lit(',"address":"old","description":'), quoted(F.when(c % 4 == 0, pick(NAMES, c + n))), F.lit("}")))
    body = F.when(c % 23 == 0, F.lit('{"items":')).otherwise(F.concat(F.lit('{"total":1,"items":['), F.concat_ws(",", *map(place, range(1, 6))), F.lit("]}")))
    found = payloads.local_search(table(spark, d, "customer").select(c.alias("query_id"), F.when(c % 3 != 0, "me.example").alias("self_domain"), pick([200, None, 200, 500, 200], c).alias("status"), body.alias("body")))
    return found.select("query_id", "self_rank", "problem", F.explode_outer("rivals").alias("r")).select("query_id", "self_rank", "problem", F.col("r.rank").alias("rank"), F.col("r.name").alias("name"), F.col("r.url").alias("url"), F.col("r.snippet").alias("snippet"))


SHAPES = ['{"domain_authority":%,"da":1,"links":"12"}', '{"results":[{"da":" % ","external_links":%.6}],"linking_root_domains":true}', '{"x":{"y":[{"domainAuthority":%}]},"totalLinks":"many","z":[{"links":-4}]}', "[]", '{"da":"","results":[{"linkingRootDomains":%}]}', '{"a":{"b":{"c":{"d":{"e":{"da":9}}}}}}', "{"]
#: What each shape says: authority, backlinks and domains.
_SAID = {"authority": ["$.domain_authority", "$.results[0].da", "$.x.y[0].domainAuthority", "$.da"], "backlinks": ["$.links", "$.results[0].external_links", "$.z[0].links"], "domains": ["$.results[0].linkingRootDomains"]}


def domain_links(spark, d):
    """Parts as sites with answers of a service of link counts."""
    k = F.col("p_partkey")
    x = table(spark, d, "part").select(k.alias("site_id"), pick([200, 200, 404], F.floor(k / 7)).alias("status"), F.replace(pick(SHAPES, k), F.lit("%"), (k % 150).cast("string")).alias("body"))
    return payloads.link_counts(x, "moz")


TEXTS = ["Café Nord", "강남 맛집", "a b", "x"]


def channel_signals(spark, d):
    """Suppliers as keywords with the answers of three services."""
    k = F.col("s_suppkey")
    text = F.concat(pick(TEXTS, k), F.lit(" "), k)
    x = table(spark, d, "supplier").select(text.alias("text"), k)
    blog = x.where(k % 5 != 0).select("text", pick([200, 200, 500], k).alias("status"), F.concat(F.lit('{"total":'), F.when(k % 7 == 0, '"9"').otherwise((k * 3).cast("string")), F.lit("}")).alias("body"))
    entry = lambda name, pc, mobile: F.concat(F.lit('{"relKeyword":"'), name, F.lit('","monthlyPcQcCnt":'), pc, F.lit(',"monthlyMobileQcCnt":'), mobile, F.lit("}"))
    ads = x.where(k % 6 != 0).select("text", F.lit(200).alias("status"), F.when(k % 11 == 0, F.lit('{"keywordList":[]}')).otherwise(F.concat(F.lit('{"keywordList":['), entry(F.lit("other"), F.lit("1"), F.lit("2")), F.when(k % 4 != 0, F.concat(F.lit(","), entry(F.upper(F.replace("text", F.lit(" "), F.lit(""))), F.lit('"< 10"'), (k * 10).cast("string")))).otherwise(""), F.lit("]}"))).alias("body"))
    trend = x.where(k % 4 != 3).select("text", pick([200, None], k).alias("status"), F.when(k % 9 == 0, F.lit('{"results":[{"data":[]}]}')).otherwise(F.concat(F.lit('{"results":[{"data":[{"ratio":'), k % 13, F.lit('},{"ratio":99},{"ratio":'), F.when(k % 10 == 0, '"5"').otherwise((k % 17).cast("string")), F.lit("}]}]}"))).alias("body"))
    s = keywords.collect_signals(x.select("text"), payloads.blog_documents(blog), payloads.search_volume(ads), payloads.search_trend(trend))
    return s.select("text", *(F.col(c).cast("long").alias(c) for c in ("docs", "volume", "trend7d")), "blog", "search_ad", "datalab")


QUERIES = {f.__name__: f for f in (speed_measures, local_rivals, domain_links, channel_signals)}

_k = "p_partkey"
_PROBLEM = "CASE WHEN status >= 400 THEN 'http_' || status WHEN trim(coalesce(body, '')) = '' THEN 'no_payload' WHEN NOT json_valid(body) THEN 'not_json' {0} END"
_num = lambda path: f"CASE WHEN json_type(j, '{path}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN json_extract(j, '{path}')::DOUBLE END"
_audit = lambda *names: "coalesce(" + ", ".join(_num(f'$.lighthouseResult.audits."{n}".numericValue') for n in names) + ", 0)"
_found = lambda key: "coalesce(" + ", ".join(f"CASE json_type(j, '{p}') WHEN 'VARCHAR' THEN CASE WHEN trim(json_extract_string(j, '{p}')) = '' THEN 0 ELSE try_cast(trim(json_extract_string(j, '{p}')) AS DOUBLE) END WHEN 'BOOLEAN' THEN NULL ELSE try_cast(json_extract_string(j, '{p}') AS DOUBLE) END" for p in _SAID[key]) + ", 0)"
_speed = f"""CASE WHEN {_k} % 7 = 0 THEN {pick_sql(BROKEN, f"{_k} // 7")} WHEN {_k} % 29 <> 0 THEN '{{"lighthouseResult":{{"categories":{{' || CASE WHEN {_k} % 11 <> 0 THEN '"performance":{{"score":0.' || (10 + {_k} % 90) || '}}' ELSE '' END || '}},"audits":{{' || concat_ws(',',
    '"largest-contentful-paint":{{"numericValue":' || (1000 + {_k} % 3000) || '.' || ({_k} % 10) || '}}', CASE WHEN {_k} % 3 <> 0 THEN '"max-potential-fid":{{"numericValue":' || CASE WHEN {_k} % 5 = 0 THEN '"' ELSE '' END || ({_k} % 200) || CASE WHEN {_k} % 5 = 0 THEN '"' ELSE '' END || '}}' END,
    '"cumulative-layout-shift":{{"numericValue":0.' || ({_k} % 40) || '}}', CASE WHEN {_k} % 4 <> 0 THEN '"interaction-to-next-paint":{{"numericValue":' || CASE WHEN {_k} % 8 = 1 THEN 'null' ELSE ({_k} % 400)::VARCHAR END || '}}' END, '"interactive":{{"numericValue":' || ({_k} % 500) || '}}', '"server-response-time":{{"numericValue":' || ({_k} % 900) || '}}') || '}}}}}}' END"""
_fill = lambda values, key, by: f"replace({pick_sql(values, key)}, '{{0}}', ({by})::VARCHAR)"
_q = lambda v: f"CASE WHEN {v} IS NULL THEN 'null' ELSE '\"' || {v} || '\"' END"
_place = lambda n: f"""CASE WHEN {n} <= c % 6 THEN '{{"title":' || {_q(pick_sql(NAMES, f"c * 3 + {n}"))} || ',"link":' || {_q(_fill(LINKS, f"c + {n * 5}", "c % 9"))} || ',"roadAddress":' || {_q(pick_sql(PLACES, f"c + {n}"))} || ',"address":"old","description":' || CASE WHEN c % 4 = 0 THEN {_q(pick_sql(NAMES, f"c + {n}"))} ELSE 'null' END || '}}' END"""
_bare = lambda v: f"trim(regexp_replace(coalesce({v}, ''), '<[^>]*>', '', 'g'))"
_no = lambda words, where: " AND ".join(f"NOT contains({where}, '{w}')" for w in words)

ORACLE_SQL = {
    "speed_measures": f"""WITH b AS (SELECT {_k} AS site_id, {pick_sql(["mobile", "desktop"], _k)} AS strategy, {pick_sql([200, 200, 200, None, 429], _k)} AS status, {_speed} AS body FROM part),
      j AS (SELECT *, CASE WHEN json_valid(coalesce(body, '')) THEN body::JSON END AS j FROM b),
      p AS (SELECT *, {_PROBLEM.format("WHEN coalesce(json_type(j, '$.lighthouseResult.audits'), '') <> 'OBJECT' OR coalesce(json_type(j, '$.lighthouseResult.categories'), '') <> 'OBJECT' THEN 'incomplete'")} AS problem FROM j)
      SELECT site_id, strategy, CASE WHEN problem IS NULL THEN floor(coalesce({_num("$.lighthouseResult.categories.performance.score")}, 0) * 100 + 0.5)::BIGINT END AS performance, {", ".join(f"CASE WHEN problem IS NULL THEN floor({_audit(*v)} * {1000 if k == 'cls' else 1} + 0.5)::BIGINT END AS {k}" for k, v in payloads.AUDITS.items())}, problem FROM p""",
    "local_rivals": f"""WITH c AS (SELECT c_custkey AS c FROM customer), b AS (SELECT c, CASE WHEN c % 3 <> 0 THEN 'me.example' END AS self, {pick_sql([200, None, 200, 500, 200], "c")} AS status, CASE WHEN c % 23 = 0 THEN '{{"items":' ELSE '{{"total":1,"items":[' || concat_ws(',', {", ".join(map(_place, range(1, 6)))}) || ']}}' END AS body FROM c),
      p AS (SELECT *, {_PROBLEM.format("")} AS problem FROM b), i AS (SELECT c, self, n, json_extract(body, '$.items[' || (n - 1) || ']') AS x FROM p, range(1, 6) AS t(n) WHERE problem IS NULL AND json_array_length(body, '$.items') >= n),
      u AS (SELECT c, self, n, {_bare("x->>'$.title'")} AS name, nullif(trim(coalesce(x->>'$.link', '')), '') AS link, coalesce(x->>'$.roadAddress', x->>'$.address') AS place, nullif(x->>'$.description', '') AS d FROM i),
      v AS (SELECT *, coalesce(link, 'https://map.naver.com/p/search/' || url_encode(concat_ws(' ', nullif(name, ''), nullif(place, '')))) AS url, lower(coalesce(link, 'https://map.naver.com/p/search/' || url_encode(concat_ws(' ', nullif(name, ''), nullif(place, '')))) || ' ' || name) AS hay FROM u),
      k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n) AS rank, coalesce(contains(url, self), false) AS own FROM v WHERE {_no(payloads.MEDICAL, "hay")} AND {_no(payloads.SOCIAL, "lower(url)")}), s AS (SELECT c, max(rank) AS self_rank FROM k WHERE own GROUP BY 1)
      SELECT p.c AS query_id, self_rank::INT AS self_rank, problem, rank::INT AS rank, name, url, {_bare("d")} AS snippet FROM (SELECT c, rank, name, url, d FROM k WHERE NOT own) k RIGHT JOIN p USING (c) LEFT JOIN s USING (c) WHERE d IS NOT NULL
      UNION ALL SELECT p.c, self_rank::INT, problem, rank::INT, name, url, NULL FROM (SELECT c, rank, name, url, d FROM k WHERE NOT own) k RIGHT JOIN p USING (c) LEFT JOIN s USING (c) WHERE d IS NULL""",
    "domain_links": f"""WITH b AS (SELECT {_k} AS site_id, {pick_sql([200, 200, 404], f"{_k} // 7")} AS status, replace({pick_sql(SHAPES, _k)}, '%', ({_k} % 150)::VARCHAR) AS body FROM part), j AS (SELECT *, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM b), p AS (SELECT *, {_PROBLEM.format("")} AS problem FROM j)
      SELECT site_id, CASE WHEN problem IS NULL THEN least(100, greatest(0, floor({_found("authority")} + 0.5)))::BIGINT END AS authority, CASE WHEN problem IS NULL THEN greatest(0, floor({_found("backlinks")} + 0.5))::BIGINT END AS backlinks, CASE WHEN problem IS NULL THEN greatest(0, floor({_found("domains")} + 0.5))::BIGINT END AS domains, problem FROM p""",
    "channel_signals": f"""WITH x AS (SELECT s_suppkey AS k, {pick_sql(TEXTS, "s_suppkey")} || ' ' || s_suppkey AS text FROM supplier)
      SELECT text, CASE WHEN k % 5 <> 0 AND k % 3 <> 2 AND k % 7 <> 0 THEN k * 3 END AS docs, CASE WHEN k % 6 = 0 OR k % 11 = 0 THEN NULL WHEN k % 4 = 0 THEN 3 ELSE 10 + k * 10 END AS volume, CASE WHEN k % 4 <> 3 AND k % 9 <> 0 AND k % 10 <> 0 THEN k % 17 - k % 13 END AS trend7d,
        CASE WHEN k % 5 = 0 THEN 'skipped' WHEN k % 3 = 2 THEN 'failed' ELSE 'complete' END AS blog, CASE WHEN k % 6 = 0 THEN 'skipped' ELSE 'complete' END AS search_ad, CASE WHEN k % 4 = 3 THEN 'skipped' ELSE 'complete' END AS datalab FROM x""",
}
