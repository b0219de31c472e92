"""Views, lookups and row expressions over the driver's tables in their roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import admin, citations, competitors, gap, keywords, platform, scoring, site_text
from .analysis_queries import _GAP_SQL, _gap_rows
from .common import table


def market_average(spark, d):
    """Suppliers as rivals of their nation's site; some were not measured."""
    s = table(spark, d, "supplier")
    part = lambda k: F.when(F.col("s_suppkey") % k != 0, F.col("s_suppkey") % (40 + k))
    scores = s.select(F.col("s_nationkey").alias("site_id"), part(2).alias("seo"), part(3).alias("aeo"), part(5).alias("geo"), part(7).alias("perf"), part(11).alias("overall"))
    out = gap.market_average(table(spark, d, "nation").select(F.col("n_nationkey").alias("site_id")), scores)
    return out.select("site_id", *(F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(c) for c in out.columns[1:]))


def gap_view_free(spark, d):
    rows = gap.gap_view(gap.gap_matrix(*_gap_rows(spark, d)), paid=False)
    return rows.select("site_id", "rule_id", "rank", "needs_plan")


def gap_view_paid(spark, d):
    rows = gap.gap_view(gap.gap_matrix(*_gap_rows(spark, d)), paid=True)
    return rows.select("site_id", "rule_id", "rank", "needs_plan")


def gap_rows_with_rivals(spark, d):
    """Returned lines as gap rows; suppliers with a positive balance are known."""
    rows = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("diagnosis_id"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("rival_id"))
    rivals = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("https://"), "s_suppkey", F.lit(".example/")).alias("url"))
    return gap.gap_rows_with_rivals(rows, rivals)


def top_issues(spark, d):
    own, _ = _gap_rows(spark, d)
    items = own.where("NOT passed").select("site_id", "rule_id", "priority", F.col("pos").alias("rule_pos"), (F.col("pos") % 2 == 0).alias("ai"))
    return scoring.top_issues(items, 5, "ai").select("site_id", "rule_id", "position")


def today_one(spark, d):
    own, _ = _gap_rows(spark, d)
    return scoring.today_one(own.where("NOT passed").select("site_id", F.col("rule_id").alias("action_id"), "action_type", (F.col("pos") % 5).alias("priority"), "pos"))


def due_subscriptions(spark, d):
    """Customers as subscriptions that are due by their key."""
    c = table(spark, d, "customer")
    s = c.select(F.col("c_custkey").alias("business_id"), F.when(F.col("c_acctbal") < 0, "cancelled").when(F.col("c_custkey") % 2 == 0, "trial").otherwise("active").alias("status"), (F.lit("1998-06-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("c_custkey") % 7).cast("int"))).alias("next_scan_at"))
    due = admin.due_subscriptions(s, c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "1998-06-03 12:00:00")
    return due.select("business_id", "name", "status", F.date_format("next_scan_at", "yyyy-MM-dd").alias("day"))


def job_transitions(spark, d):
    """A customer's orders as the events of a job."""
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "completed", "failed"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return admin.job_transitions(table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("seq"), status.alias("status")))


def latest_scan_keywords(spark, d):
    """Orders as scans, their lines as keywords."""
    scans = table(spark, d, "orders").select(F.col("o_custkey").alias("business_id"), F.col("o_orderkey").alias("scan_id"), F.col("o_orderdate").alias("created_at"))
    words = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_quantity").alias("score"), F.col("l_linenumber").alias("created_at"), F.concat(F.lit("k"), "l_partkey").alias("keyword"))
    return admin.latest_scan_keywords(scans, words, 3).select("scan_id", "keyword", "place")


def actions_with_completion(spark, d):
    """Open rules of a nation as actions; part sizes that some customer's key
    has are completed."""
    own, _ = _gap_rows(spark, d)
    a = own.where("NOT passed").select("site_id", F.concat_ws("-", "site_id", "rule_id").alias("action_id"), F.col("action_type").alias("tier"), "pos")
    done = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat_ws("-", "c_nationkey", F.concat(F.lit("R"), F.col("c_custkey") % 50)).alias("action_id"))
    return admin.actions_with_completion(a, done, paid=False).select("site_id", "action_id", "completed", "total")


def evidence_by_name(spark, d):
    """Customers' segments looked up among later suppliers of the same number."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit(" n"), F.col("c_custkey") % 70, F.lit(" ")).alias("name"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("n"), F.col("s_suppkey") % 60, F.lit(" ")).alias("name"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("evidence"))
    return citations.evidence_by_name(c, s)


def probe_attach(spark, d):
    """Event types as runs, users as texts by their highest value."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("run_id"), F.concat(F.lit("u"), "user_id").alias("text")).agg(F.max("event_id").alias("score"))
    probes = spark.createDataFrame([("click", 80), ("view", 40)], "run_id string, score int")
    return keywords.attach_probe(e, probes, 4)


def run_status(spark, d):
    state = lambda c: F.when(F.col(c) % 2 == 0, "complete").otherwise("complete" if c == "user_id" else "skipped")
    return keywords.run_status(table(spark, d, "events").select(*(state("user_id").alias(c) if k else state("event_id").alias(c) for k, c in enumerate(keywords.CHANNELS))))


def authority_estimate(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    x = s.select(k.alias("site_id"), (k % 2 == 0).alias("https"), (k % 3 == 0).alias("hsts"), (k % 5 == 0).alias("sitemap"), F.when(k % 7 != 0, k % 4 == 0).alias("robots_txt"), (k % 9).alias("structured_data"), (k % 11).alias("social_meta"), (k % 2 == 1).alias("canonical_consistent"), (k % 150).alias("content_length"))
    return competitors.heuristic_authority(x)


def site_signals(spark, d):
    """Parts as pages of the site of their size."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    x = p.select(
        F.col("p_size").alias("site_id"), F.map_from_arrays(F.array(F.lit("og:title"), F.lit("viewport"), F.concat(F.lit("twitter:"), k % 3)), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("meta"),
        F.when(k % 2 == 0, F.concat(F.lit("h"), F.when(k % 50 == 0, 0).otherwise(F.col("p_size")))).alias("canonical_host"), F.concat(F.lit("h"), "p_size").alias("host"), (k % 90).alias("word_count"), F.array(F.concat(F.lit("T"), k % 5)).alias("types"),
    )
    return competitors.site_signals(x)


def topic_coverage(spark, d):
    words = table(spark, d, "part").select(F.col("p_size").alias("site_id"), F.element_at(F.split("p_name", " "), 1).alias("word")).groupBy("site_id", "word").agg(F.count(F.lit(1)).alias("n"))
    topics = words.where(F.col("word") < "f").select("site_id", "word")
    return site_text.topic_coverage(words, topics)


def surface_kinds(spark, d):
    """Pages with a source type by their number and marks in some paths."""
    k = F.col("page_id") % 9
    kind = F.element_at(F.array(*map(F.lit, ("website", "naver_blog", "instagram", "youtube", "naver_place", "kakao_place", "other", "other", "other"))), (k + 1).cast("int"))
    mark = F.element_at(F.array(*map(F.lit, ("", "booking/", "review/", "maps/"))), (F.col("page_id") % 4 + 1).cast("int"))
    url = F.concat(F.lit("https://www.x"), F.col("page_id") % 10, F.lit(".example/"), mark)
    return table(spark, d, "pages").select("page_id", platform.surface_kind(kind, url).alias("kind"))


def fetch_checks(spark, d):
    """Addresses made of event numbers: which may be fetched, and what a status
    or a message says."""
    i = F.col("event_id")
    host = F.when(i % 10 == 0, "localhost").when(i % 10 == 1, F.concat(F.lit("a"), i % 5, F.lit(".internal"))).when(i % 10 == 2, "[::1]").when(i % 10 == 3, "shop.example").otherwise(F.concat_ws(".", i % 256, F.floor(i / 3) % 256, i % 7, F.lit(1)))
    url = F.concat(F.when(i % 13 == 0, "ftp").when(i % 2 == 0, "http").otherwise("https"), F.lit("://"), host, F.lit("/p"))
    message = F.element_at(F.array(*map(F.lit, ("Request timed out", "getaddrinfo ENOTFOUND x", "socket hang up", "The operation was Aborted"))), (i % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", urls.is_public(url).alias("is_public"), urls.status_failure((i % 7) * 100).alias("status_failure"), urls.fetch_error(message).alias("fetch_error"))


def grades(spark, d):
    """Grades, lights and verdicts of scores, priorities and impacts of rules."""
    i = F.col("event_id")
    score, level = F.when(i % 17 != 0, (i % 111 - 5)), lambda k: F.element_at(F.array(*map(F.lit, ("high", "medium", "low"))), (F.floor(i / k) % 3 + 1).cast("int"))
    ai = F.when(i % 3 != 0, i % 101)
    return table(spark, d, "events").select(
        "event_id", scoring.grade(score).alias("grade"), scoring.traffic_signal(score).alias("signal"), scoring.priority(level(1), level(3)).alias("priority"), scoring.impact_score(i % 12, level(1)).alias("impact"),
        keywords.radar_verdict(score).alias("radar"), keywords.creator_verdict(score).alias("creator"), keywords.creator_score(i % 97, ai).alias("combined"),
    )


def next_scans(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format(keywords.next_scan(F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm").alias("next_scan"))


def search_queries(spark, d):
    """A customer's nation as region, segment as trade, two keywords."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return competitors.buildable_queries(c.select(F.col("c_custkey").alias("site_id"), F.col("n_name").alias("region"), F.col("c_mktsegment").alias("industry"), F.array(F.lit("best"), F.lit("cheap")).alias("target_keywords")))


def latest_measure(spark, d):
    """The latest of a line's days of shipping and around; some are empty or null."""
    text = lambda k, n: F.date_format(F.date_add("l_shipdate", (F.col(k) % n - n // 2).cast("int")), "yyyy-MM-dd")
    x = table(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", admin.latest_of(text("l_linenumber", 1), F.when(F.col("l_linenumber") % 2 == 0, text("l_partkey", 31)).otherwise(""), F.when(F.col("l_linenumber") % 3 == 0, text("l_suppkey", 21))).alias("latest"))


QUERIES = {f.__name__: f for f in (
    market_average, gap_view_free, gap_view_paid, gap_rows_with_rivals, top_issues, today_one, due_subscriptions, job_transitions, latest_scan_keywords, actions_with_completion, evidence_by_name, probe_attach, run_status,
    authority_estimate, site_signals, topic_coverage, surface_kinds, fetch_checks, grades, next_scans, search_queries, latest_measure,
)}

_VIEW_SQL = _GAP_SQL + ", v AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, gap DESC, pos) AS k FROM m) SELECT site_id, rule_id, least(k, 5) AS rank, k > 3 AS needs_plan FROM v"
_LEVEL = "CASE floor(event_id / {k})::BIGINT % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"

ORACLE_SQL = {
    "market_average": "SELECT n_nationkey AS site_id, " + ", ".join(f"CAST(floor(coalesce(avg(CASE WHEN s_suppkey IS NULL THEN NULL WHEN s_suppkey % {k} <> 0 THEN s_suppkey % {40 + k} ELSE 0 END), 0) * 1e6 + 0.5) AS BIGINT) AS {c}" for k, c in ((2, "seo"), (3, "aeo"), (5, "geo"), (7, "perf"), (11, "overall"))) + " FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    "gap_view_free": _VIEW_SQL + " WHERE k <= 3",
    "gap_view_paid": _VIEW_SQL,
    "gap_rows_with_rivals": "SELECT l_suppkey AS rival_id, l_orderkey AS diagnosis_id, l_linenumber AS pos, s_name AS rival_name, 'https://' || s_suppkey || '.example/' AS rival_url FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' AND s_acctbal > 0",
    "top_issues": _GAP_SQL + ", t AS (SELECT site_id, rule_id, row_number() OVER (PARTITION BY site_id ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, pos) AS position FROM own WHERE NOT passed AND (pos % 2 = 1 OR priority = 'high')) SELECT * FROM t WHERE position <= 5",
    "today_one": _GAP_SQL + ", t AS (SELECT site_id, rule_id AS action_id, row_number() OVER (PARTITION BY site_id ORDER BY CASE WHEN action_type = 'self_fix' THEN 0 ELSE 1 END, pos % 5, pos) AS k FROM own WHERE NOT passed) SELECT site_id, action_id FROM t WHERE k = 1",
    "due_subscriptions": "SELECT c_custkey AS business_id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'trial' ELSE 'active' END AS status, strftime(DATE '1998-06-01' + CAST(c_custkey % 7 AS INT), '%Y-%m-%d') AS day FROM customer WHERE c_acctbal >= 0 AND c_custkey % 7 <= 2",
    "job_transitions": """WITH e AS (SELECT o_custkey AS job_id, o_orderkey AS seq, CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END AS status FROM orders),
      f AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY job_id ORDER BY seq), 'new') AS before FROM e)
      SELECT job_id, seq, status, (before = 'new' AND status = 'queued') OR (before = 'queued' AND status = 'running') OR (before = 'running' AND status IN ('completed', 'failed')) AS legal FROM f""",
    "latest_scan_keywords": """WITH l AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders),
      k AS (SELECT l_orderkey AS scan_id, 'k' || l_partkey AS keyword, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, 'k' || l_partkey) AS place FROM lineitem JOIN l ON l_orderkey = o_orderkey AND n = 1)
      SELECT * FROM k WHERE place <= 3""",
    "actions_with_completion": _GAP_SQL + """, a AS (SELECT site_id, site_id || '-' || rule_id AS action_id, count(*) OVER (PARTITION BY site_id) AS total, row_number() OVER (PARTITION BY site_id ORDER BY pos, rule_id) AS k FROM own WHERE NOT passed)
      SELECT site_id, action_id, action_id IN (SELECT c_nationkey || '-R' || (c_custkey % 50) FROM customer WHERE c_acctbal < 0) AS completed, total FROM a WHERE k <= 3""",
    "evidence_by_name": "WITH e AS (SELECT s_suppkey % 60 AS n, arg_max(s_name, s_suppkey) AS evidence FROM supplier GROUP BY 1) SELECT c_custkey AS id, ' n' || (c_custkey % 70) || ' ' AS name, evidence FROM customer LEFT JOIN e ON n = c_custkey % 70",
    "probe_attach": """WITH e AS (SELECT event_type AS run_id, 'u' || user_id AS text, max(event_id) AS score FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, text) AS k FROM e)
      SELECT run_id, text, score, CASE WHEN k <= 4 THEN CASE run_id WHEN 'click' THEN 80 WHEN 'view' THEN 40 END END AS probe FROM r""",
    "run_status": "SELECT CASE WHEN count(*) = 0 THEN 'skipped' WHEN bool_and(event_id % 2 = 0) THEN 'complete' ELSE 'partial' END AS status FROM events",
    "authority_estimate": """WITH r AS (SELECT s_suppkey AS k, (CASE WHEN s_suppkey % 2 = 0 THEN 10.0 ELSE 10.0 END + CASE WHEN s_suppkey % 3 = 0 THEN 5 ELSE 0 END + CASE WHEN s_suppkey % 5 = 0 THEN 10 ELSE 0 END + CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 4 = 0 THEN 5 ELSE 0 END
        + least(s_suppkey % 9 * 5, 25) + least(s_suppkey % 11 * 2, 15) + least(s_suppkey % 150, 100)::DOUBLE * 0.2::DOUBLE)::DOUBLE AS raw FROM supplier), a AS (SELECT k, CAST(floor(least(100.0, greatest(0.0, raw * 0.9::DOUBLE)) + 0.5) AS INT) AS da FROM r)
      SELECT k AS site_id, da AS authority, da * 5 AS backlinks, CAST(floor(da * 0.8::DOUBLE + 0.5) AS INT) AS domains FROM a""",
    "site_signals": """SELECT p_size AS site_id, 2 AS social_meta, bool_and(p_partkey % 2 = 1 OR p_partkey % 50 <> 0) AS canonical_consistent, least(sum(p_partkey % 90), 500) / 5 AS content_length, count(DISTINCT p_partkey % 5) AS structured_data FROM part GROUP BY 1""",
    "topic_coverage": "SELECT p_size AS site_id, round(count(*) FILTER (split_part(p_name, ' ', 1) < 'f') / count(*), 4) AS coverage FROM part GROUP BY 1",
    "surface_kinds": """WITH x AS (SELECT page_id, page_id % 9 AS s, page_id % 4 AS m FROM pages)
      SELECT page_id, CASE s WHEN 0 THEN 'website' WHEN 1 THEN 'blog' WHEN 2 THEN 'social' WHEN 3 THEN 'video' ELSE CASE m WHEN 1 THEN 'reservation' WHEN 2 THEN 'review' WHEN 3 THEN 'map' ELSE CASE WHEN s IN (4, 5) THEN 'place' ELSE 'other' END END END AS kind FROM x""",
    "fetch_checks": """WITH x AS (SELECT event_id, event_id % 10 AS h, event_id % 256 AS a, floor(event_id / 3)::BIGINT % 256 AS b FROM events)
      SELECT event_id, event_id % 13 <> 0 AND h NOT IN (0, 1, 2) AND (h = 3 OR NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127))) AS is_public,
        CASE WHEN event_id % 7 >= 5 THEN 'HTTP_5xx' WHEN event_id % 7 = 4 THEN 'HTTP_4xx' END AS status_failure, CASE event_id % 4 WHEN 1 THEN 'DNS_FAILED' WHEN 2 THEN 'CONNECTION_REFUSED' ELSE 'TIMEOUT' END AS fetch_error FROM x""",
    "grades": f"""WITH x AS (SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN event_id % 111 - 5 END AS s, {_LEVEL.format(k=1)} AS l, {_LEVEL.format(k=3)} AS m, event_id % 97 AS n, CASE WHEN event_id % 3 <> 0 THEN event_id % 101 END AS ai FROM events),
      y AS (SELECT *, CASE l WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END * CASE m WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS p, event_id % 12 * 10 * CASE l WHEN 'high' THEN 10 WHEN 'medium' THEN 6 ELSE 3 END / 10 AS i FROM x)
      SELECT event_id, CASE WHEN s >= 80 THEN 'excellent' WHEN s >= 60 THEN 'good' WHEN s >= 40 THEN 'fair' ELSE 'poor' END AS grade, CASE WHEN s >= 80 THEN 'green' WHEN s >= 40 THEN 'yellow' ELSE 'red' END AS signal,
        CASE WHEN p >= 6 THEN 'high' WHEN p >= 3 THEN 'medium' ELSE 'low' END AS priority, CAST(least(floor(i + 0.5), 100) AS INT) AS impact, CASE WHEN s >= 80 THEN 'excellent' WHEN s >= 65 THEN 'good' WHEN s >= 45 THEN 'fair' ELSE 'weak' END AS radar,
        CASE WHEN s >= 85 THEN 'excellent' WHEN s >= 70 THEN 'good' WHEN s >= 50 THEN 'fair' ELSE 'weak' END AS creator, CAST(floor(n * 0.52::DOUBLE + coalesce(ai, n) * 0.48::DOUBLE + 0.5) AS INT) AS combined FROM y""",
    "next_scans": "WITH k AS (SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day FROM events) SELECT event_id, strftime(day + CAST(8 - isodow(day) AS INT) - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M') AS next_scan FROM k",
    "search_queries": "WITH c AS (SELECT c_custkey, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT c_custkey AS site_id, 0 AS pos, n_name || ' ' || c_mktsegment AS query FROM c UNION ALL SELECT c_custkey, 1, n_name || ' best' FROM c UNION ALL SELECT c_custkey, 2, n_name || ' cheap' FROM c",
    "latest_measure": "SELECT l_orderkey, l_linenumber, strftime(greatest(l_shipdate, CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate + to_days(CAST(l_partkey % 31 - 15 AS INT)) END, CASE WHEN l_linenumber % 3 = 0 THEN l_shipdate + to_days(CAST(l_suppkey % 21 - 10 AS INT)) END), '%Y-%m-%d') AS latest FROM lineitem",
}
