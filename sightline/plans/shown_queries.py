"""What owners are shown, over the driver's tables in their roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import platform, views
from .common import diagnoses, spread, table

TYPES = [*views.ASSETS, "OTHER"]
PLATFORMS = list(platform.SOURCE_LABELS)


def _assets(spark, d):
    """Documents as stored texts of types by their number."""
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % len(TYPES) + 1).cast("int"))
    return table(spark, d, "documents").select((F.col("doc_id") % 50).alias("business_id"), F.col("doc_id").alias("pos"), kind.alias("type"), F.col("text").alias("code"))


def asset_view_free(spark, d):
    return views.asset_view(_assets(spark, d), paid=False)


def asset_view_paid(spark, d):
    return views.asset_view(_assets(spark, d), paid=True)


def _rivals(spark, d):
    """Suppliers as rivals of their nation's site; some without a name or rank."""
    k = F.col("s_suppkey")
    source = F.when(k % 3 == 0, "naver_serp").when(k % 3 == 1, "gpt_grounded").otherwise("mock")
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("site_id"), k.alias("pos"), source.alias("source"), F.when(k % 5 != 0, F.concat(F.lit(" "), "s_name", F.lit("  "))).alias("name"), F.when(k % 7 != 0, k % 11).alias("rank"))


def rival_view(spark, d):
    return views.rival_view(_rivals(spark, d))


def rival_view_hidden(spark, d):
    return views.rival_view(_rivals(spark, d), anonymous=True)


def radar_preview(spark, d):
    """Parts as keywords of the site of their size."""
    k = F.col("p_partkey")
    verdict = F.element_at(F.array(*map(F.lit, ("now", "good", "normal", "wait"))), (k % 4 + 1).cast("int"))
    x = table(spark, d, "part").select(F.col("p_size").alias("site_id"), k.alias("pos"), F.col("p_name").alias("keyword"), F.when(k % 3 != 0, (k % 9 - 4) / 8).alias("trend7d"), F.when(k % 5 != 0, k % 30).alias("docs"), verdict.alias("verdict"))
    return views.radar_preview(x)


def job_claim(spark, d):
    """Orders as jobs: how many of a status after a claim, and the jobs claimed."""
    x = views.claim(diagnoses(spark, d).withColumn("attempts", F.lit(0)), 5)
    return x.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"), F.sum("attempts").alias("attempts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("claimed"), F.col("id")))), lambda i: i.cast("string")), ",").alias("claimed"))  # five at most


def topic_relevance(spark, d):
    """A part's words as terms, its size's neighbours as references."""
    refs = F.when(F.col("p_size") % 5 != 0, F.array(F.lit("Gre"), F.lit("burnished chocolate"), F.lit(""), F.lit("AN"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", views.relevance(F.split("p_name", " "), refs).alias("relevance"))


def evidence_items(spark, d):
    """Events as evidence: an object, a list of a number and a truth value, words."""
    k, s = F.col("event_id"), F.col("event_id").cast("string")
    one = F.concat(F.lit('{"source": "'), "event_type", F.lit('", "serpRank": null, "rank": '), s, F.lit(', "note": [1]}'))
    raw = F.when(k % 4 == 0, one).when(k % 4 == 1, F.concat(F.lit("["), s, F.lit(", true]"))).when(k % 4 == 2, F.lit('"measured"'))
    return views.evidence_items(spread(table(spark, d, "events")).select(k.alias("id"), raw.alias("evidence")))


def platform_presence(spark, d):
    """Documents as texts of platform pages of types by their number."""
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, PLATFORMS)), (i % len(PLATFORMS) + 1).cast("int"))
    label = F.element_at(F.array(*map(F.lit, platform.SOURCE_LABELS.values())), (i % len(PLATFORMS) + 1).cast("int"))
    x = spread(table(spark, d, "documents")).select(i.alias("site_id"), kind.alias("source_type"), F.lit("https://shop.example/").alias("url"), F.when(i % 2 == 0, F.concat(F.lit(" N"), i, F.lit(" | "), label)).alias("h1"), F.concat(F.lit("T"), i).alias("title"), F.when(i % 3 == 0, "booking 02-123-4567").alias("description"), F.create_map().cast("map<string,string>").alias("meta"), F.col("text").alias("body_text"))
    return platform.platform_presence(x).select("site_id", "name", "description", "phone", F.array_join("services", " ").alias("services"), *platform.HINTS, "confidence")


QUERIES = {f.__name__: f for f in (asset_view_free, asset_view_paid, rival_view, rival_view_hidden, radar_preview, job_claim, topic_relevance, evidence_items, platform_presence)}

_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_CLASSES = dict(views.COPY_CLASSES) | {"technical-jargon": r"(?i)\b(?:SERP|snippet|AEO|GEO|SEO)\b|grounded|스니펫|메타태그|robots\.txt|schema\.org|JSON-?LD|마이크로데이터|구조화\s*데이터|크롤(?:링|러)"}
_ASSETS = f"""WITH a AS (SELECT doc_id % 50 AS business_id, doc_id AS pos, {_list([v[0] for v in views.ASSETS.values()])}[doc_id % 5 + 1] AS kind, {_list([v[1] for v in views.ASSETS.values()])}[doc_id % 5 + 1] AS title, text AS content FROM documents)
  SELECT * FROM a WHERE kind IS NOT NULL AND {_TRIM.format("coalesce(content, '')")} <> '' AND NOT ({" OR ".join(f"regexp_matches(content, '{p}')" for p in _CLASSES.values())})"""
_RIVALS = """WITH r AS (SELECT s_nationkey AS site_id, s_suppkey AS pos, s_suppkey % 3 AS s, trim(s_name) AS name, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 7 <> 0 THEN s_suppkey % 11 END AS rank FROM supplier WHERE s_suppkey % 3 < 2 AND s_suppkey % 5 <> 0),
  x AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY s, coalesce(rank, 0), pos) AS place, row_number() OVER (PARTITION BY site_id, s ORDER BY coalesce(rank, 0), pos) AS k FROM r) SELECT site_id, place, {} AS name, CASE s WHEN 0 THEN 'naver' ELSE 'ai' END AS channel, rank FROM x"""
_HINT = ", ".join(f"regexp_matches(t, '(?i){p}') AS {name}" for name, p in platform.HINTS.items())

ORACLE_SQL = {
    "asset_view_free": _ASSETS + " AND kind IN ('place_intro', 'review_request')",
    "asset_view_paid": _ASSETS,
    "rival_view": _RIVALS.format("name"),
    "rival_view_hidden": _RIVALS.format("CASE s WHEN 0 THEN '네이버에서 앞선 옆집' ELSE 'AI에서 앞선 옆집' END || CASE WHEN k > 1 THEN ' ' || k ELSE '' END"),
    "radar_preview": f"""WITH x AS (SELECT p_size AS site_id, p_partkey AS k, p_name AS keyword, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS place FROM part)
      SELECT site_id, place, keyword, CASE WHEN k % 3 <> 0 AND k % 9 > 4 THEN '{views.GROWING}' WHEN k % 5 <> 0 AND k % 30 <= 10 THEN '{views.FEW}' ELSE '{views.NOTICED}' END AS reason, CASE WHEN k % 4 < 2 THEN 'good' WHEN k % 4 = 2 THEN 'mid' ELSE 'wait' END AS status FROM x WHERE place <= 5""",
    "job_claim": """WITH q AS (SELECT o_orderkey AS id, o_orderstatus AS s, CASE WHEN o_orderstatus = 'O' THEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) END <= 5 AS mine FROM orders)
      SELECT CASE WHEN mine THEN 'running' WHEN s = 'F' THEN 'completed' WHEN s = 'O' THEN 'queued' ELSE 'failed' END AS status, count(*) AS jobs, count(*) FILTER (mine) AS attempts, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (mine), '') AS claimed FROM q GROUP BY 1""",
    "topic_relevance": """WITH t AS (SELECT p_partkey, p_size, lower(unnest(string_split(p_name, ' '))) AS w FROM part)
      SELECT p_partkey, CASE WHEN any_value(p_size) % 5 = 0 THEN 0.5 ELSE count(*) FILTER (contains(w, 'gre') OR contains('gre', w) OR contains('burnished chocolate', w) OR contains(w, 'an') OR contains('an', w)) / count(*) END AS relevance FROM t GROUP BY 1""",
    "evidence_items": f"""SELECT event_id AS id, 1 AS place, '출처' AS label, event_type AS detail FROM events WHERE event_id % 4 = 0 UNION ALL SELECT event_id, 2, '순위', event_id::VARCHAR FROM events WHERE event_id % 4 = 0
      UNION ALL SELECT event_id, 1, '확인 근거 1', event_id::VARCHAR FROM events WHERE event_id % 4 = 1 UNION ALL SELECT event_id, 2, '확인 근거 2', '{views.FOUND}' FROM events WHERE event_id % 4 = 1
      UNION ALL SELECT event_id, 1, '확인 근거', CASE WHEN event_id % 4 = 2 THEN '직접 확인했어요.' ELSE '{views.UNKNOWN}' END FROM events WHERE event_id % 4 >= 2""",
    "platform_presence": f"""WITH b AS (SELECT doc_id AS i, coalesce(text, '') AS body, CASE WHEN doc_id % 3 = 0 THEN 'booking 02-123-4567' ELSE list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?\\n]'), lambda x: {_TRIM.format('x')}), lambda x: length(x) >= 20)[1] END AS description FROM documents),
      x AS (SELECT *, body || ' ' || coalesce(description, '') AS t FROM b), w AS (SELECT *, list_filter(regexp_extract_all(t, '{platform.WORD}'), lambda w: NOT list_contains({_list(platform.NO_SERVICE)}, w)) AS ws FROM x),
      u AS (SELECT *, list_filter(ws, lambda w, k: list_position(ws, w) = k) AS us FROM w)
      SELECT i AS site_id, CASE WHEN i % 2 = 0 THEN 'N' || i ELSE 'T' || i END AS name, description, nullif(regexp_extract(t, '{platform.PHONE}'), '') AS phone,
        array_to_string((list_filter({_list(platform.SERVICE_FIRST)}, lambda s: list_contains(us, s)) || list_filter(us, lambda s: NOT list_contains({_list(platform.SERVICE_FIRST)}, s)))[1:12], ' ') AS services, {_HINT},
        CASE WHEN length(body) < 80 THEN 'low' WHEN i % 8 IN (3, 6) THEN 'medium' ELSE 'high' END AS confidence FROM u""",
}
