"""Gap, competitor, citation, keyword, text and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration, citations, competitors, gap, keywords, site_text
from .common import spread, table

_PRIORITY = "CASE WHEN s_suppkey % 3 = 0 THEN 'high' WHEN s_suppkey % 3 = 1 THEN 'medium' ELSE 'low' END"
_ACTION = "CASE WHEN p % 4 = 0 THEN 'self_fix' WHEN p % 4 = 1 THEN 'snippet_action' WHEN p % 4 = 2 THEN 'vendor_action' ELSE 'si_action' END"


def _gap_rows(spark, d):
    """A site a nation: part sizes are rules, suppliers of the nation rivals."""
    line = table(spark, d, "lineitem")
    part = table(spark, d, "part").select("p_partkey", F.concat(F.lit("R"), F.col("p_size").cast("string")).alias("rule_id"), F.col("p_size").alias("pos"))
    supp = table(spark, d, "supplier")
    x = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    rivals = x.groupBy(F.col("s_nationkey").alias("site_id"), F.col("s_suppkey").alias("rival"), "rule_id").agg((F.avg("l_quantity") > 25).alias("passed"))
    own = x.groupBy(F.col("s_nationkey").alias("site_id"), "rule_id", "pos").agg((F.avg("l_discount") > 0.05).alias("passed"))
    own = own.withColumns({
        "category": F.lit("SEO"), "action_type": F.expr(_ACTION.replace("p %", "pos %")), "priority": F.when(F.col("pos") % 3 == 0, "high").when(F.col("pos") % 3 == 1, "medium").otherwise("low"),
    })
    return own, rivals


def gap_matrix(spark, d):
    m = gap.gap_matrix(*_gap_rows(spark, d))
    return m.select("site_id", "rule_id", "passed", "rival_passed", "rival_total", F.floor(F.col("gap") * 1e6 + 0.5).cast("long").alias("gap_millionths"), "place")


def gap_top5(spark, d):
    return gap.gap_priorities(gap.gap_matrix(*_gap_rows(spark, d))).select("site_id", "rank", "rule_id", "action_type", "priority", "rival_passed")


def gap_summary(spark, d):
    s = gap.gap_summary(gap.gap_matrix(*_gap_rows(spark, d)))
    return s.withColumn("avg_gap", F.floor(F.col("avg_gap") * 1e6 + 0.5).cast("long"))


def gap_strengths(spark, d):
    return gap.strengths(gap.gap_matrix(*_gap_rows(spark, d)))


_GAP_SQL = """WITH x AS (SELECT s_nationkey AS site_id, s_suppkey AS rival, 'R' || p_size AS rule_id, p_size AS pos, l_quantity, l_discount FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
rivals AS (SELECT site_id, rival, rule_id, avg(l_quantity) > 25 AS passed FROM x GROUP BY 1, 2, 3),
own AS (SELECT site_id, rule_id, pos, avg(l_discount) > 0.05 AS passed, CASE pos % 4 WHEN 0 THEN 'self_fix' WHEN 1 THEN 'snippet_action' WHEN 2 THEN 'vendor_action' ELSE 'si_action' END AS action_type, CASE pos % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority FROM x GROUP BY 1, 2, 3),
n AS (SELECT site_id, count(DISTINCT rival) AS rival_total FROM rivals GROUP BY 1), c AS (SELECT site_id, rule_id, count(*) FILTER (passed) AS rival_passed FROM rivals GROUP BY 1, 2),
m0 AS (SELECT site_id, rule_id, pos, passed, action_type, priority, rival_passed, rival_total, rival_passed / rival_total - passed::INT AS gap FROM own JOIN c USING (site_id, rule_id) JOIN n USING (site_id)),
m AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY gap DESC, pos) AS place FROM m0) """


def competitor_rank(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("reviews"))
    c = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = c.select(F.col("c_nationkey").alias("site_id"), F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("rival"), (F.col("c_custkey") % 30).alias("rank"), "reviews", F.when(F.col("c_acctbal") > 0, F.floor(F.col("c_acctbal") / 100)).alias("authority"), F.lit(None).cast("long").alias("mentions"))
    top = competitors.rank_competitors(rows, 5)
    return top.select("site_id", "place", "rival", F.floor(F.col("popularity") * 1e6 + 0.5).cast("long").alias("popularity"))


def competitor_merge(spark, d):
    """Clicks as search results: the same user's results merge by url."""
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("site_id"), F.concat(F.lit("https://h"), (F.col("event_id") % 97).cast("string"), F.lit(".example/")).alias("url"), F.col("event_id").alias("pos"), F.col("event_type").alias("name"))
    return competitors.merge_mentions(e).select("site_id", "url", "pos", "name", "mentions")


def competitor_sources(spark, d):
    e = table(spark, d, "events")
    source = F.element_at(F.array(*map(F.lit, competitors.SOURCES)), (F.col("event_id") % 4 + 1).cast("int"))
    found = e.select((F.col("user_id") % 20).alias("site_id"), source.alias("source"), F.col("event_id").alias("pos"), F.concat(F.lit("n"), (F.col("event_id") % 53).cast("string")).alias("name"), F.when(F.col("event_id") % 4 != 3, F.concat(F.lit("u"), (F.col("event_id") % 31).cast("string"))).alias("url"))
    return competitors.merge_sources(found).select("site_id", "place", "source", "name", "url")


def citation_metrics(spark, d):
    a = table(spark, d, "conversations").where("role = 'assistant'")
    rows = a.select((F.col("conv_id") % 10).alias("site_id"), F.col("turn").alias("pos"), F.lit("").alias("query"), F.col("text").alias("response"), F.element_at(F.array(F.lit("the"), F.lit("que"), F.lit("der")), (F.col("conv_id") % 3 + 1).cast("int")).alias("business_name"), F.lit("https://www.example.com/x").alias("url"))
    x = citations.cited(rows)
    return x.groupBy("site_id").agg(F.count(F.lit(1)).alias("citations"), F.count_if("mentioned").alias("mentions"), F.count_if("url_cited").alias("urls"), F.sum(F.floor(F.col("prominence") * 1000 + 0.5)).cast("long").alias("prominence_thousandths"))


def recommended_competitors(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("site_id"), F.col("event_id").alias("pos"), F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("query"), F.array(F.concat(F.lit("n"), (F.col("event_id") % 13).cast("string")), F.concat(F.lit("n"), (F.col("user_id") % 7).cast("string")), F.lit(" ")).alias("names"))
    return citations.recommended(e, 5).select("site_id", "place", "name", "queries", "sample_query")


def keyword_scores(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    s = p.select(k.alias("keyword"), (k % 3).alias("hop"), F.when(k % 7 != 0, k * 37 % 20000).alias("docs"), F.when(k % 5 != 0, k * 91 % 12000).alias("volume"), F.when(k % 4 != 0, (k % 41 - 20) / 64).alias("trend7d"), F.when(k % 7 != 0, "complete").otherwise("skipped").alias("blog"), F.when(k % 5 != 0, "complete").otherwise("failed").alias("search_ad"), F.when(k % 4 != 0, "complete").otherwise("skipped").alias("datalab"))
    out = keywords.keyword_scores(s)
    return out.select("keyword", F.col("c_volume").cast("int").alias("c_volume"), F.col("c_saturation").cast("int").alias("c_saturation"), F.col("c_trend").cast("int").alias("c_trend"), F.col("c_confidence").cast("int").alias("c_confidence"), F.col("score").cast("int").alias("score"), "state", F.size("reasons").cast("int").alias("reasons"))


def keyword_expand(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("seed_id"), F.col("p_name").alias("seed"))
    return keywords.expand(p).select("seed_id", F.col("place").cast("int").alias("place"), "text", F.col("hop").cast("int").alias("hop"))


def quota_guard(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("channel"), F.col("event_id").alias("pos"))
    budgets = spark.createDataFrame([("click", 300, 50), ("view", 10, 20), ("error", 120, 0)], "channel string, budget long, used long")
    return keywords.quota_guard(e, budgets).groupBy("channel").agg(F.count(F.lit(1)).alias("requests"), F.count_if("allowed").alias("allowed"), F.max(F.when(F.col("allowed"), F.col("pos"))).alias("last_allowed"))


def _pages(spark, d):
    return spread(table(spark, d, "documents")).select(F.col("source").alias("site_id"), F.col("doc_id").alias("page"), "text")


def tf_idf_terms(spark, d):
    pages = _pages(spark, d)
    w = site_text.tf_idf(site_text.page_terms(pages, F.col("text")), pages)
    return w.groupBy("site_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("occurrences"), F.max("df").alias("largest_df"), F.floor(F.max("tf_idf") * 1e6 + 0.5).cast("long").alias("largest_weight"))


def duplicate_pages(spark, d):
    pages = _pages(spark, d)
    return site_text.duplicate_sets(site_text.page_sets(pages, F.col("text")), pages)


def cannibalisation(spark, d):
    pages = _pages(spark, d).select("site_id", "page", F.substring("text", 1, 60).alias("title"), F.lit("").alias("h1"), F.array().cast("array<string>").alias("h2"), F.col("text").alias("body"))
    words = spark.createDataFrame([("ation",), ("theran",), ("heit",), ("loser",), ("copyright",), ("x",)], "keyword string")
    k = pages.select("site_id").distinct().join(F.broadcast(words), F.lit(True))
    return site_text.cannibalisation(pages, k)


def calibration_report(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_quantity").alias("lcp"), F.col("l_extendedprice").alias("ttfb"), F.col("l_tax").alias("cls"))
    r = {"PERF-LCP-001": (F.col("lcp"), F.col("lcp") <= 49), "PERF-TTFB-001": (F.col("ttfb"), F.col("ttfb") < 2000), "PERF-CLS-001": (F.col("cls"), F.col("cls") <= 0.04)}
    out = calibration.calibrate(s, r)
    return out.select("rule_id", F.floor(F.col("pass_rate") * 1e6 + 0.5).cast("long").alias("pass_millionths"), *(F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(c) for c in ("median", "p90", "p95")), "advice")


QUERIES = {
    f.__name__: f
    for f in (gap_matrix, gap_top5, gap_summary, gap_strengths, competitor_rank, competitor_merge, competitor_sources, citation_metrics, recommended_competitors, keyword_scores, keyword_expand, quota_guard, tf_idf_terms, duplicate_pages, cannibalisation, calibration_report)
}

_MODIFIERS = ", ".join(f"({i}, '{m}')" for i, m in enumerate(keywords.MODIFIERS))
_TERMS_SQL = "terms AS (SELECT site_id, page, term, count(*) AS n FROM (SELECT source AS site_id, doc_id AS page, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents) WHERE length(term) >= 2 GROUP BY 1, 2, 3)"

ORACLE_SQL = {
    "gap_matrix": _GAP_SQL + "SELECT site_id, rule_id, passed, rival_passed, rival_total, CAST(floor(gap * 1e6 + 0.5) AS BIGINT) AS gap_millionths, place FROM m",
    "gap_top5": _GAP_SQL + """, s AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY gap * (CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) * CAST(CASE action_type WHEN 'self_fix' THEN 1.5 WHEN 'snippet_action' THEN 1.3 WHEN 'vendor_action' THEN 1.0 ELSE 0.7 END AS DOUBLE) DESC, place) AS rank FROM m WHERE gap > 0)
      SELECT site_id, rank, rule_id, action_type, priority, rival_passed FROM s WHERE rank <= 5""",
    "gap_summary": _GAP_SQL + "SELECT site_id, count(*) AS rules, count(*) FILTER (gap > 0) AS rivals_ahead, count(*) FILTER (gap < 0) AS own_ahead, count(*) FILTER (gap = 0) AS equal, CAST(floor(avg(gap) * 1e6 + 0.5) AS BIGINT) AS avg_gap FROM m GROUP BY 1",
    "gap_strengths": _GAP_SQL + "SELECT site_id, rule_id FROM m WHERE passed AND rival_passed < rival_total / 2",
    "competitor_rank": """WITH o AS (SELECT o_custkey, count(*) AS reviews FROM orders GROUP BY 1),
      c AS (SELECT c_nationkey AS site_id, c_custkey AS rival, 0.4::DOUBLE / CASE WHEN c_custkey % 30 = 0 THEN 100 ELSE c_custkey % 30 END + log10(coalesce(reviews, 1) + 1) / 4 * 0.3::DOUBLE + coalesce(CASE WHEN c_acctbal > 0 THEN floor(c_acctbal / 100) END, 0) / 100 * 0.2::DOUBLE + log10(2) / 4 * 0.1::DOUBLE AS pop FROM customer LEFT JOIN o ON c_custkey = o_custkey),
      r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY pop DESC, rival) AS place FROM c) SELECT site_id, place, rival, CAST(floor(pop * 1e6 + 0.5) AS BIGINT) AS popularity FROM r WHERE place <= 5""",
    "competitor_merge": "SELECT user_id % 20 AS site_id, 'https://h' || (event_id % 97) || '.example/' AS url, min(event_id) AS pos, arg_min(event_type, event_id) AS name, count(*) AS mentions FROM events GROUP BY 1, 2",
    "competitor_sources": """WITH f AS (SELECT user_id % 20 AS site_id, event_id AS pos, event_id % 4 AS s, ['serp', 'ai', 'manual', 'ai_name'][event_id % 4 + 1] AS source, 'n' || (event_id % 53) AS name, CASE WHEN event_id % 4 <> 3 THEN 'u' || (event_id % 31) END AS url FROM events),
      k AS (SELECT *, row_number() OVER (PARTITION BY site_id, coalesce(url, source || ':' || name) ORDER BY s, pos) AS n FROM f)
      SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY s, pos) AS place, source, name, url FROM k WHERE n = 1""",
    "citation_metrics": """WITH r AS (SELECT conv_id % 10 AS site_id, coalesce(text, '') AS t, ['the', 'que', 'der'][conv_id % 3 + 1] AS b FROM conversations WHERE role = 'assistant'), x AS (SELECT *, instr(lower(t), b) - 1 AS i FROM r)
      SELECT site_id, count(*) AS citations, count(*) FILTER (i >= 0) AS mentions, count(*) FILTER (contains(lower(t), 'example.com')) AS urls, CAST(sum(CASE WHEN i < 0 THEN 0 ELSE floor((1 - i / length(t)) * 1000 + 0.5) END) AS BIGINT) AS prominence_thousandths FROM x GROUP BY 1""",
    "recommended_competitors": """WITH e AS (SELECT user_id % 20 AS site_id, event_id AS pos, 0 AS k, 'n' || (event_id % 13) AS name FROM events UNION ALL SELECT user_id % 20, event_id, 1, 'n' || (user_id % 7) FROM events),
      g AS (SELECT site_id, name, count(DISTINCT pos) AS queries, 'q' || min(pos) AS sample_query, min(pos * 2 + k) AS o FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY queries DESC, o) AS place FROM g)
      SELECT site_id, place, name, queries, sample_query FROM r WHERE place <= 5""",
    "keyword_scores": """WITH s AS (SELECT p_partkey AS keyword, p_partkey % 3 AS hop, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey * 37 % 20000 END AS docs, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey * 91 % 12000 END AS volume, CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 41 - 20) / 64 END AS t FROM part),
      a AS (SELECT *, CASE WHEN docs IS NOT NULL AND volume > 0 THEN floor(docs / volume * 100 + 0.5) / 100 END AS sat FROM s),
      b AS (SELECT *, CASE hop WHEN 0 THEN 100 WHEN 1 THEN 82 ELSE 65 END AS r, CASE WHEN volume IS NULL OR volume <= 0 THEN 15 ELSE least(100, greatest(0, floor(log10(volume + 1) / 4 * 100 + 0.5))) END AS v,
        CASE WHEN sat IS NULL THEN 40 WHEN sat <= 0.25 THEN 95 WHEN sat <= 0.8 THEN 75 WHEN sat <= 1.5 THEN 55 ELSE 30 END AS sa, CASE WHEN t IS NULL THEN 45 ELSE least(100, greatest(0, floor(50 + t * 150 + 0.5))) END AS tr,
        floor(((keyword % 7 <> 0)::INT + (keyword % 5 <> 0)::INT + (keyword % 4 <> 0)::INT) / 3 * 100 + 0.5) AS cf FROM a),
      c AS (SELECT *, floor(r * 0.15::DOUBLE + v * 0.35::DOUBLE + sa * 0.3::DOUBLE + tr * 0.1::DOUBLE + cf * 0.1::DOUBLE + 0.5) AS sc FROM b)
      SELECT keyword, v::INT AS c_volume, sa::INT AS c_saturation, tr::INT AS c_trend, cf::INT AS c_confidence, sc::INT AS score, CASE WHEN sc >= 70 THEN 'good' WHEN sc >= 45 THEN 'mid' ELSE 'wait' END AS state,
        greatest(1, (coalesce(volume, 0) >= 1000)::INT + coalesce(sat <= 0.5, false)::INT + (coalesce(t, 0) > 0.1)::INT + (sc < 45)::INT)::INT AS reasons FROM c""",
    "keyword_expand": f"""WITH s AS (SELECT p_partkey AS seed_id, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS seed FROM part), t AS (SELECT *, string_split(seed, ' ') AS w FROM s), m(i, m) AS (VALUES {_MODIFIERS}),
      c AS (SELECT seed_id, 0 AS o, seed AS text, 0 AS hop FROM t
        UNION ALL SELECT seed_id, 10 + i, seed || ' ' || w[i], 1 FROM t, range(1, 12) r(i) WHERE i <= len(w) AND w[i] <> seed
        UNION ALL SELECT seed_id, 100 + i, seed || ' ' || m, 1 FROM t, m UNION ALL SELECT seed_id, 200 + i, w[1] || ' ' || m, 2 FROM t, m),
      d AS (SELECT seed_id, text, min(o) AS o, arg_min(hop, o) AS hop FROM c GROUP BY 1, 2), e AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY o) AS place FROM d)
      SELECT seed_id, place::INT AS place, text, hop::INT AS hop FROM e WHERE place <= 30""",
    "quota_guard": """WITH b(channel, l) AS (VALUES ('click', 250), ('view', 0), ('error', 120)), e AS (SELECT event_type AS channel, event_id AS pos, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events)
      SELECT e.channel, count(*) AS requests, count(*) FILTER (l IS NULL OR k <= l) AS allowed, max(pos) FILTER (l IS NULL OR k <= l) AS last_allowed FROM e LEFT JOIN b ON e.channel = b.channel GROUP BY 1""",
    "tf_idf_terms": f"""WITH {_TERMS_SQL}, total AS (SELECT site_id, page, sum(n) AS total FROM terms GROUP BY 1, 2), df AS (SELECT site_id, term, count(*) AS df FROM terms GROUP BY 1, 2), pn AS (SELECT source AS site_id, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1)
      SELECT site_id, count(*) AS terms, sum(n)::BIGINT AS occurrences, max(df) AS largest_df, CAST(floor(max(n / total * (ln((pages + 1) / (df + 1)) + 1)) * 1e6 + 0.5) AS BIGINT) AS largest_weight FROM terms JOIN total USING (site_id, page) JOIN df USING (site_id, term) JOIN pn USING (site_id) GROUP BY 1""",
    "duplicate_pages": f"""WITH {_TERMS_SQL}, c AS (SELECT site_id, page, count(*) AS c FROM terms GROUP BY 1, 2), i AS (SELECT a.site_id, a.page AS p, b.page AS q, count(*) AS i FROM terms a JOIN terms b ON a.site_id = b.site_id AND a.term = b.term AND a.page < b.page GROUP BY 1, 2, 3),
      h AS (SELECT i.site_id, count(*) AS high FROM i JOIN c x ON i.site_id = x.site_id AND p = x.page JOIN c y ON i.site_id = y.site_id AND q = y.page WHERE i / (x.c + y.c - i) > 0.7 GROUP BY 1), n AS (SELECT source AS site_id, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1)
      SELECT site_id, n AS pages, coalesce(high, 0) AS duplicate_pairs, floor(coalesce(high, 0) / (n * (n - 1) / 2) * 10000 + 0.5) / 10000 AS duplicate_ratio FROM n LEFT JOIN h USING (site_id)""",
    "cannibalisation": """WITH k(keyword) AS (VALUES ('ation'), ('theran'), ('heit'), ('loser'), ('copyright')), p AS (SELECT source AS site_id, doc_id AS page, lower(text) AS t, lower(substr(text, 1, 60)) AS title FROM documents)
      SELECT site_id, keyword, count(DISTINCT page) AS pages FROM p, k WHERE contains(title, keyword) OR (length(t) - length(replace(t, keyword, ''))) / length(keyword) >= 3 GROUP BY 1, 2 HAVING count(DISTINCT page) >= 2""",
    "calibration_report": " UNION ALL ".join(
        f"SELECT '{r}' AS rule_id, CAST(floor(avg((({p}))::INT) * 1e6 + 0.5) AS BIGINT) AS pass_millionths, CAST(floor(quantile_cont({c}, 0.5) * 1000 + 0.5) AS BIGINT) AS median, CAST(floor(quantile_disc({c}, 0.9) * 1000 + 0.5) AS BIGINT) AS p90, CAST(floor(quantile_disc({c}, 0.95) * 1000 + 0.5) AS BIGINT) AS p95, CASE WHEN avg(({p})::INT) > 0.95 THEN 'raise' WHEN avg(({p})::INT) < 0.1 THEN 'lower' ELSE 'keep' END AS advice FROM lineitem"
        for r, c, p in (("PERF-LCP-001", "l_quantity", "l_quantity <= 49"), ("PERF-TTFB-001", "l_extendedprice", "l_extendedprice < 2000"), ("PERF-CLS-001", "l_tax", "l_tax <= 0.04"))
    ),
}
