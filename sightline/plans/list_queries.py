"""Grouped lists, reports, nouns, questions and authors' keywords over the
driver's tables in their roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import korean
from ..functions.language import WORD_END
from ..operators import admin, calibration, channels, citations, competitors, creator, gap, platform, scoring
from ..functions import text as T
from ..functions import urls
from ..sources import reports
from . import analysis_queries
from .common import pick, pick_sql, spread, table
from .score_queries import _ITEMS, _RESULTS, _SCORES, _results


def _items(spark, d):
    return scoring.execution_order(scoring.diagnosis_items(_results(spark, d)))


def items_by_action(spark, d):
    """Every supplier, also one without lines, and its items by action."""
    every = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site_id"))
    g = scoring.grouped_items(_items(spark, d), "action_type", scoring.ACTIONS, every)
    return g.select("site_id", "action_type", F.size("items").alias("n"), F.array_join(F.transform("items", lambda i: i["rule_id"]), ",").alias("rules"))


def items_with_rules(spark, d):
    x = scoring.with_rules(_items(spark, d), _results(spark, d))
    return x.select("site_id", "position", "rule_id", F.col("rule.passed").alias("passed"), F.col("rule.severity").alias("severity"), F.col("rule.rule_weight").alias("rule_weight"), F.col("rule.score_impact").alias("score_impact"))


ASKED = [["SEO"], ["AEO", "GEO"], None, [], ["GEO", "SEO", "PERF"]]


def module_results(spark, d):
    s = F.col("s_suppkey")
    asked = F.when(s % 5 == 0, F.array(F.lit("SEO"))).when(s % 5 == 1, F.array(F.lit("AEO"), F.lit("GEO"))).when(s % 5 == 3, F.array().cast("array<string>")).when(s % 5 == 4, F.array(F.lit("GEO"), F.lit("SEO"), F.lit("PERF")))
    g = scoring.module_results(_results(spark, d), table(spark, d, "supplier").select(s.alias("site_id"), asked.alias("modules")))
    return g.select("site_id", "category", F.array_join(F.transform("results", lambda r: F.concat(r["rule_id"], F.when(r["passed"], "+").otherwise("-"))), ",").alias("results"))


def site_reports(spark, d):
    return reports.site_reports(scoring.overall_scores(scoring.category_scores(_results(spark, d))), _items(spark, d))


THRESHOLDS = {"PERF-LCP-001": "2500ms", "PERF-CLS-001": "0.1"}


def calibration_text(spark, d):
    r = analysis_queries.calibration_report(spark, d)
    r = r.select("rule_id", (F.col("pass_millionths") / 1e6).alias("pass_rate"), *((F.col(c) / 1000).alias(c) for c in ("median", "p90", "p95")), "advice")
    return calibration.calibration_text(r, THRESHOLDS, "2026-01-01T00:00:00.000Z")


TALK = ["강남 커피숍에서 커피를 마셨습니다.", "커피는 따뜻한 음료이다! 메뉴가 다양한 카페", "우리 동네 맛집을 추천했다, 맛집", "가격이 12,000원 입니다 커피", "Seoul 카페로부터 3km 거리", ""]


def top_nouns(spark, d):
    """Documents as pages with two Korean sentences after each."""
    i = F.col("doc_id")
    pages = table(spark, d, "documents").select(F.col("source").alias("site_id"), i.alias("page"), F.concat_ws(" ", "text", pick(TALK, i), pick(TALK, i * 5 + 2)).alias("t"))
    return korean.top_nouns(pages, F.col("t"), 5).select("page", "place", "word", "n")


def facet_questions(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(
        k.alias("site_id"), F.when(k % 4 != 0, F.concat(F.lit(" "), "p_brand", F.lit("  "), k % 9)).alias("business_name"), pick(["서울", " ", None, "Paris  10"], F.floor(k / 4)).alias("region"), F.when(k % 3 != 0, F.col("p_type")).alias("industry"),
        F.when(k % 5 != 0, F.slice(F.array(F.lit(" "), F.lit("a  b"), F.lit("{name}"), F.lit(None), F.lit("커피"), F.lit("x")), F.lit(1), (k % 7).cast("int"))).alias("target_keywords"),
    )
    return competitors.facet_questions(p, most=6)


def creator_keywords(spark, d):
    """Parts as keywords, a third with measured signals."""
    k = F.col("p_partkey")
    x = table(spark, d, "part").select(F.concat("p_name", F.lit(" "), pick(["추천", "맛집", "😀", "é"], k), F.lit(" "), k).alias("text"), (k % 12).alias("pos"), (k % 3).alias("hop"), (k % 2 == 0).alias("include_ai"), k.alias("k"))
    m = x.where("k % 3 = 0").select("text", (F.col("k") * 3 % 5000).alias("volume"), (F.col("k") % 700).alias("docs"), F.when(F.col("k") % 2 == 0, (F.col("k") % 9 - 4) / 4).alias("trend7d"), F.lit("complete").alias("blog"), F.lit("failed").alias("search_ad"), F.lit("complete").alias("datalab"))
    out = creator.creator_keywords(x.drop("k"), m)
    return out.select("id", "text", F.col("pos").cast("long").alias("pos"), F.col("score").cast("long").alias("score"), F.col("ai_score").cast("long").alias("ai_score"), "gap", "verdict", "trend", "angle")


FORMS = ["{0}", " www.{0} ", "HTTP://{0}/", "https://www.{0}/a//", "//{0}/x", "{0}/p?q=1", "ftp://{0}", "https://{0}:8080/a/#b"]


def url_forms(spark, d):
    """Customers as businesses who wrote their address in some form."""
    c = F.col("c_custkey")
    written = F.replace(pick(FORMS, c), F.lit("{0}"), F.concat(F.lit("Shop"), c % 50, F.lit(".Example")))
    other = F.concat(F.lit("https://www.shop"), (c + F.floor(c / 50)) % 50, F.lit(".example/z"))
    x = table(spark, d, "customer").select("c_custkey", written.alias("w"), other.alias("o"))
    n = urls.normalize(F.col("w"))
    return x.select("c_custkey", n.alias("normalized"), urls.domain_of(F.col("w")).alias("domain"), urls.same_site(n, F.col("o")).alias("same_site"))


def site_lights(spark, d):
    """Orders as sites with what was measured of their channels."""
    o = F.col("o_orderkey")
    asked = F.when(o % 7 != 0, o % 5)
    x = table(spark, d, "orders")
    score = lambda c, m: F.when(c % 6 != 0, (c % m).cast("double"))
    return x.select("o_orderkey", channels.naver_light(asked, o % 4, o % 2 == 0).alias("naver"), channels.google_light(score(o, 101), score(F.floor(o / 3), 97)).alias("google"), channels.ai_light(F.when(o % 5 != 0, o % 3 == 0), o % 2 == 0).alias("ai"), citations.probe_score((o % 11) / 10, (o % 6) / 5, (o % 2).cast("double")).cast("int").alias("probe"))


def item_labels(spark, d):
    """Parts as items: the channel, label and tier of each, what its text cost, and
    its text without tags."""
    k = F.col("p_partkey")
    kind, action = pick(["geo", "seo", "aeo", "perf", "other"], k), pick([*scoring.ACTIONS, "none"], F.floor(k / 5))
    html = F.concat(F.lit(" <b class='x'>"), "p_name", F.lit("</b><br/>"), F.when(k % 3 == 0, "a < b").otherwise("&amp;"), F.lit(" "))
    x = table(spark, d, "part")
    cost = T.token_cost((k % 3000).cast("double"), F.when(k % 4 != 0, (k % 700).cast("double")), F.lit(0.25), F.lit(2.0))
    return x.select("p_partkey", platform.channel(kind).alias("channel"), platform.category_label(kind).alias("label"), platform.action_tier(action).alias("tier"), F.floor(cost * 1e6 + 0.5).cast("long").alias("usd_millionths"), T.strip_tags(html).alias("text"))


def gap_by_action(spark, d):
    """The gap matrix by action, largest gap first."""
    g = gap.grouped_matrix(gap.gap_matrix(*analysis_queries._gap_rows(spark, d)), "action_type", scoring.ACTIONS)
    return g.select("site_id", "action_type", F.array_join(F.transform("items", lambda i: i["rule_id"]), ",").alias("rules"))


def changed_businesses(spark, d):
    """Customers as businesses, some deleted; orders as changes of a field or two,
    some of businesses that are not there yet."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    at = lambda n: F.lit("1998-01-01").cast("timestamp_ntz") + F.make_dt_interval((n % 900).cast("int"))
    b = table(spark, d, "customer").select(c.alias("id"), (c % 40).alias("account_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"), F.lit(None).cast("string").alias("region"), F.when(c % 3 == 0, F.concat(F.lit("p"), c)).alias("place_id"), F.lit("u").alias("homepage_url"), at(c).alias("created_at"), at(c).alias("updated_at"), F.when(c % 11 == 0, at(c)).alias("deleted_at"))
    sets = [["name"], ["category", "region"], ["homepage_url"], ["name", "place_id"], []]
    given = F.coalesce(*(F.when(o % 5 == i, F.array(*map(F.lit, x)).cast("array<string>")) for i, x in enumerate(sets)))
    text = lambda p: F.when(o % 7 != 0, F.concat(F.lit(p), o))
    ch = table(spark, d, "orders").select((F.col("o_custkey") + F.when(o % 13 == 0, 1_000_000).otherwise(0)).alias("id"), (F.lit("2000-01-01").cast("timestamp_ntz") + F.make_dt_interval(o.cast("int"))).alias("at"), (o % 40).alias("account_id"), text("n").alias("name"), text("c").alias("category"), text("r").alias("region"), text("p").alias("place_id"), text("u").alias("homepage_url"), given.alias("set"))
    return admin.changed_businesses(b, ch)


def found_businesses(spark, d):
    """Parts as requests for businesses (customers) by id, by place or by account."""
    c, k = F.col("c_custkey"), F.col("p_partkey")
    b = table(spark, d, "customer").select(c.alias("id"), F.when(c % 2 == 0, F.concat(F.lit("p"), F.floor(c / 4))).alias("place_id"), F.when(c % 5 != 0, c % 60).alias("account_id"), (c % 17).alias("created_at"), F.when(c % 7 == 0, 1).alias("deleted_at"))
    w = table(spark, d, "part").select(k.alias("request"), F.when(k % 3 == 0, k).alias("id"), F.when(k % 3 == 1, F.concat(F.lit("p"), k)).alias("place_id"), F.when(k % 3 == 2, k % 70).alias("account_id"))
    return admin.found_businesses(b, w)


QUERIES = {f.__name__: f for f in (gap_by_action, changed_businesses, found_businesses, items_by_action, items_with_rules, module_results, site_reports, calibration_text, top_nouns, facet_questions, creator_keywords, url_forms, site_lights, item_labels)}

_say = lambda x: "'" + x.replace("'", "''") + "'"
_PLACED = _ITEMS + ", k AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY rank, hard, impact_score DESC, item_id)::INT AS position, ['high', 'medium', 'low'][rank + 1] AS priority, ['easy', 'medium', 'hard'][hard + 1] AS difficulty FROM j) "
_pos = lambda values, key: "[" + ", ".join(_say(v) for v in values) + f"][({key}) % {len(values)} + 1]"


def _endings(words: list[str], least: int) -> str:
    """What is left of w without the first ending that leaves enough; null if none does."""
    return f"list_first(list_filter(list_transform([{', '.join(map(_say, words))}], lambda e: CASE WHEN ends_with(w, e) AND length(w) - length(e) >= {least} THEN w[:length(w) - length(e)] END), lambda x: x IS NOT NULL))"


_stop = ", ".join(map(_say, korean.STOPWORDS))
_fields = {"name": "name", "region": "region", "industry": "industry"}


def _question(n: int, facet: str, text: str) -> str:
    known = " AND ".join([f"{f} <> ''" for f in _fields if "{" + f + "}" in text] + (["region = ''"] if "{keyword}" in text and "{region}" not in text else [])) or "true"
    filled = _say(text)
    for f in _fields:
        if "{" + f + "}" in text:
            filled = f"replace({filled}, '{{{f}}}', {f})"
    if "{keyword}" in text:
        return f"SELECT site_id, {n} AS t, i AS j, replace({filled}, '{{keyword}}', keys[i]) AS query, '{facet}' AS facet FROM p, range(1, 4) AS r(i) WHERE len(keys) >= i AND {known}"
    return f"SELECT site_id, {n}, 0, {filled}, '{facet}' FROM p WHERE {known}"


_tidy = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
_first = lambda x, steps, last: "CASE " + " ".join(f"WHEN {x} >= {a} THEN {_say(b)}" for a, b in steps) + f" ELSE {_say(last)} END"

ORACLE_SQL = {
    "items_by_action": _PLACED + f", a AS (SELECT unnest([{', '.join(map(_say, scoring.ACTIONS))}]) AS action_type) SELECT s_suppkey AS site_id, action_type, count(position)::INT AS n, coalesce(string_agg(rule_id, ',' ORDER BY position), '') AS rules FROM supplier CROSS JOIN a LEFT JOIN k ON k.site_id = s_suppkey AND k.action = action_type GROUP BY 1, 2",
    "items_with_rules": _PLACED + "SELECT k.site_id, position, rule_id, passed, severity, weight::INT AS rule_weight, CASE WHEN r.pos % 13 = 0 THEN 'informational' END AS score_impact FROM k JOIN r ON r.site_id = k.site_id AND r.pos = k.pos",
    "module_results": _RESULTS + f""", m AS (SELECT unnest([{', '.join(map(_say, scoring.MODULES))}]) AS category) SELECT s_suppkey AS site_id, m.category, coalesce(string_agg(r.category || '-' || pos || CASE WHEN passed THEN '+' ELSE '-' END, ',' ORDER BY pos), '') AS results
      FROM supplier CROSS JOIN m LEFT JOIN r ON r.site_id = s_suppkey AND r.category = m.category AND CASE s_suppkey % 5 WHEN 0 THEN m.category = 'SEO' WHEN 1 THEN m.category <> 'SEO' WHEN 3 THEN false WHEN 4 THEN m.category <> 'AEO' ELSE true END GROUP BY 1, 2""",
    "calibration_text": "WITH r AS (" + analysis_queries.ORACLE_SQL["calibration_report"] + f"""), l AS (SELECT CASE rule_id {" ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(THRESHOLDS, 1))} ELSE {len(THRESHOLDS) + 1} END AS o, rule_id, advice, concat_ws(chr(10), '### ' || CASE advice {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in calibration.MARKS.items())} END || ' ' || rule_id,
      '- **현재 임계값**: ' || CASE rule_id {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in THRESHOLDS.items())} ELSE '' END, '- **Pass Rate**: ' || format('{{:.1f}}', pass_millionths / 10000) || '%', '- **Median**: ' || format('{{:.2f}}', floor((median + 5) / 10) / 100), '- **P90**: ' || format('{{:.2f}}', floor((p90 + 5) / 10) / 100), '- **P95**: ' || format('{{:.2f}}', floor((p95 + 5) / 10) / 100),
      '- **권고**: ' || upper(advice), '- **사유**: Pass rate: ' || format('{{:.1f}}', pass_millionths / 10000) || '% (' || CASE advice {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in calibration.REASONS.items())} END || ')', '') AS t FROM r)
      SELECT '# PERF 규칙 보정 보고서' || chr(10) || chr(10) || '생성 시각: 2026-01-01T00:00:00.000Z' || chr(10) || '총 규칙 수: ' || count(*) || chr(10) || chr(10) || '## 요약' || chr(10) || chr(10) || '- Keep: ' || count(*) FILTER (advice = 'keep') || ' 규칙' || chr(10) || '- Raise (임계값 강화): ' || count(*) FILTER (advice = 'raise') || ' 규칙' || chr(10)
        || '- Lower (임계값 완화): ' || count(*) FILTER (advice = 'lower') || ' 규칙' || chr(10) || chr(10) || '## 규칙별 상세' || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY o, rule_id) AS text FROM l""",
    "top_nouns": f"""WITH t AS (SELECT doc_id AS page, source, list_filter(regexp_split_to_array(concat_ws(' ', text, {pick_sql(TALK, "doc_id")}, {pick_sql(TALK, "doc_id * 5 + 2")}), {_say(f"[{WORD_END}]+")}), lambda x: x <> '') AS ws FROM documents),
      x AS (SELECT page, source, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM t), y AS (SELECT *, length(w) >= 2 AND regexp_matches(w, '[가-힣]$') AS ko FROM x),
      z AS (SELECT page, source, pos, coalesce({_endings(korean.POSTPOSITIONS, 2)}, w) AS stem FROM y WHERE NOT (ko AND ({_endings(korean.ADJECTIVE_ENDINGS, 1)} IS NOT NULL OR {_endings(korean.VERB_ENDINGS, 1)} IS NOT NULL))),
      g AS (SELECT page, source, stem, count(*) AS n, min(pos) AS first FROM z WHERE length(stem) BETWEEN 2 AND 12 AND stem NOT IN ({_stop}) AND NOT regexp_matches(stem, '^[0-9.]+$') GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY source, page ORDER BY n DESC, first) AS place FROM g)
      SELECT page, place::INT AS place, stem AS word, n FROM r WHERE place <= 5""",
    "facet_questions": f"""WITH s AS (SELECT p_partkey AS site_id, {_tidy("CASE WHEN p_partkey % 4 <> 0 THEN ' ' || p_brand || '  ' || (p_partkey % 9) END")} AS name, {_tidy(pick_sql(["서울", " ", None, "Paris  10"], "p_partkey // 4"))} AS region, {_tidy("CASE WHEN p_partkey % 3 <> 0 THEN p_type END")} AS industry,
        CASE WHEN p_partkey % 5 <> 0 THEN [' ', 'a  b', '{{name}}', NULL, '커피', 'x'][1:p_partkey % 7] ELSE [] END AS raw FROM part), p AS (SELECT *, list_filter(list_transform(raw, lambda k: {_tidy("k")}), lambda k: k <> '')[1:3] AS keys FROM s),
      q AS ({" UNION ALL ".join(_question(n, f, t) for n, (f, t) in sorted(enumerate(competitors.FACETS), key=lambda x: "{keyword}" not in x[1][1]))}), r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY t, j)::INT AS place FROM q) SELECT site_id, place, query, facet FROM r WHERE place <= 6""",
    "creator_keywords": f"""WITH x AS (SELECT p_partkey AS k, p_name || ' ' || {pick_sql(["추천", "맛집", "😀", "é"], "p_partkey")} || ' ' || p_partkey AS text FROM part), w AS (SELECT *, list_sum(list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c)))::BIGINT AS w FROM x),
      s AS (SELECT *, w + k % 12 * 37 AS b FROM w), m AS (SELECT *, CASE WHEN k % 3 = 0 THEN k * 3 % 5000 ELSE 180 + b % 6200 END AS v, CASE WHEN k % 3 = 0 THEN k % 700 ELSE 20 + b % 3400 END AS docs, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN (k % 9 - 4) / 4 END ELSE -8 + b % 34 END AS t FROM s),
      a AS (SELECT *, CASE WHEN v > 0 THEN floor(docs / v * 100 + 0.5) / 100 END AS sat FROM m), c AS (SELECT *, CASE k % 3 WHEN 0 THEN 100 WHEN 1 THEN 82 ELSE 65 END AS c1, CASE WHEN v <= 0 THEN 15 ELSE greatest(0, least(100, floor(log10(v + 1) / 4 * 100 + 0.5))) END AS c2,
        CASE WHEN sat IS NULL THEN 40 WHEN sat <= 0.25 THEN 95 WHEN sat <= 0.8 THEN 75 WHEN sat <= 1.5 THEN 55 ELSE 30 END AS c3, CASE WHEN t IS NULL THEN 45 ELSE greatest(0, least(100, floor(50 + t * 150 + 0.5))) END AS c4, CASE WHEN k % 3 = 0 THEN 67 ELSE 100 END AS c5 FROM a),
      d AS (SELECT *, greatest(0, least(100, floor(c1 * 0.15::DOUBLE + c2 * 0.35::DOUBLE + c3 * 0.3::DOUBLE + c4 * 0.1::DOUBLE + c5 * 0.1::DOUBLE + 0.5)))::BIGINT AS score, CASE WHEN k % 2 = 0 THEN CASE w % 4 WHEN 0 THEN 'empty' WHEN 3 THEN 'crowded' ELSE 'thin' END END AS gap FROM c),
      e AS (SELECT *, CASE WHEN gap IS NOT NULL THEN greatest(1, least(100, floor(score * 0.62::DOUBLE + CASE gap WHEN 'empty' THEN 24 WHEN 'thin' THEN 14 ELSE 4 END + 0.5)))::BIGINT END AS ai FROM d), f AS (SELECT *, CASE WHEN gap IS NULL THEN score ELSE floor(score * 0.52::DOUBLE + ai * 0.48::DOUBLE + 0.5) END AS both_ FROM e)
      SELECT 'ck_' || lower(to_base(w, 36)) AS id, text, k % 12 AS pos, score, ai AS ai_score, gap, {_first("both_", creator.VERDICTS, creator.LAST_VERDICT)} AS verdict, CASE WHEN t IS NULL THEN '{creator.NO_TREND}' ELSE {_first("t", creator.TRENDS, creator.LAST_TREND)} END AS trend,
        CASE WHEN gap = 'empty' THEN '{creator.ANGLE_GAP}' WHEN contains(text, '{creator.CHOICE}') THEN '{creator.ANGLE_CHOICE}' ELSE '{creator.ANGLE}' END AS angle FROM f""",
    "url_forms": f"""WITH x AS (SELECT c_custkey, trim(replace({pick_sql(FORMS, "c_custkey")}, '{{0}}', 'Shop' || c_custkey % 50 || '.Example')) AS w, (c_custkey + c_custkey // 50) % 50 = c_custkey % 50 AS same FROM customer), y AS (SELECT *, CASE WHEN regexp_matches(w, '^[A-Za-z]+://') THEN w ELSE 'https://' || w END AS full_ FROM x),
      z AS (SELECT *, regexp_replace(full_, '/+$', '') AS bare FROM y) SELECT c_custkey, CASE WHEN regexp_matches(bare, '^[A-Za-z]+://[^/]+$') THEN bare || '/' ELSE bare END AS normalized,
        CASE WHEN c_custkey % 8 IN (1, 4) THEN '' ELSE 'shop' || c_custkey % 50 || '.example' END AS domain, same AND c_custkey % 8 <> 4 AS same_site FROM z""",
    "site_lights": """WITH x AS (SELECT o_orderkey AS o, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 5 END AS q, o_orderkey % 4 AS v, coalesce(CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 101 END, 0) AS a, coalesce(CASE WHEN o_orderkey // 3 % 6 <> 0 THEN o_orderkey // 3 % 97 END, 0) AS b FROM orders)
      SELECT o AS o_orderkey, CASE WHEN q IS NULL THEN 'red' WHEN q > 0 AND v / q >= 0.75 AND o % 2 = 0 THEN 'green' WHEN q > 0 AND v / q >= 1 THEN 'green' WHEN v > 0 THEN 'yellow' ELSE 'red' END AS naver, CASE WHEN greatest(a, b) >= 80 THEN 'green' WHEN greatest(a, b) >= 40 THEN 'yellow' ELSE 'red' END AS google,
        CASE WHEN o % 5 = 0 THEN 'red' WHEN o % 3 = 0 THEN CASE WHEN o % 2 = 0 THEN 'green' ELSE 'red' END ELSE 'yellow' END AS ai, floor(70 * ((o % 11) / 10) + 20 * ((o % 6) / 5) + 10 * (o % 2) + 0.5)::INT AS probe FROM x""",
    "item_labels": f"""WITH x AS (SELECT *, {pick_sql(["geo", "seo", "aeo", "perf", "other"], "p_partkey")} AS kind, {pick_sql([*scoring.ACTIONS, "none"], "p_partkey // 5")} AS action FROM part)
      SELECT p_partkey, CASE kind WHEN 'geo' THEN 'naver' WHEN 'aeo' THEN 'ai_citation' ELSE 'google' END AS channel, CASE kind WHEN 'geo' THEN '노출' WHEN 'seo' THEN '소개' WHEN 'aeo' THEN '소개' WHEN 'perf' THEN '속도' END AS label, CASE action WHEN 'self_fix' THEN 'self_fix' WHEN 'snippet_action' THEN 'snippet' WHEN 'vendor_action' THEN 'vendor' WHEN 'si_action' THEN 'ongoing' END AS tier,
        coalesce(floor(CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 3000 / 1000 * 0.25 + p_partkey % 700 / 1000 * 2.0 ELSE 0 END * 1000000 + 0.5), 0)::BIGINT AS usd_millionths, trim(p_name || CASE WHEN p_partkey % 3 = 0 THEN 'a < b' ELSE '&amp;' END) AS text FROM x""",
}

#: A report is JSON: objects in the order of fields, without blanks.
ORACLE_SQL["site_reports"] = (
    _SCORES.rstrip()
    + _PLACED.removeprefix(_RESULTS).rstrip()
    + f""", p AS (SELECT site_id, coalesce(max(score) FILTER (category = 'SEO'), 0) AS seo, coalesce(max(score) FILTER (category = 'AEO'), 0) AS aeo, coalesce(max(score) FILTER (category = 'GEO'), 0) AS geo, max(score) FILTER (category = 'PERF' AND rules > 0) AS perf FROM s GROUP BY 1),
  o AS (SELECT *, CAST(floor(CASE WHEN perf IS NULL THEN (seo * 35 + aeo * 25 + geo * 25) / 85 ELSE (seo * 35 + aeo * 25 + geo * 25 + perf * 15) / 100 END + 0.5) AS INT) AS overall FROM p), c AS (SELECT *, split_part(rule_id, '-', 1) AS category FROM k),
  z AS (SELECT site_id, list(struct_pack(item_id := item_id, rule_id := rule_id, category := category, priority := priority) ORDER BY rank, pos)[1:{reports.TOP}] AS top, list(struct_pack(position := position, item_id := item_id, rule_id := rule_id, category := category, priority := priority, impact_score := impact_score, action_type := action, difficulty := difficulty) ORDER BY position) AS items,
    {", ".join(f"count(*) FILTER (action = '{a}') AS {a}" for a in scoring.ACTIONS)} FROM c GROUP BY 1)
  SELECT site_id, to_json(struct_pack(version := '{reports.VERSION}', site_id := site_id::VARCHAR, scores := struct_pack(overall := overall, seo := seo, aeo := aeo, geo := geo, perf := perf, grade := CASE WHEN overall >= 80 THEN 'excellent' WHEN overall >= 60 THEN 'good' WHEN overall >= 40 THEN 'fair' ELSE 'poor' END, disclaimer := {_say(reports.DISCLAIMER)}),
    summary := struct_pack(headline := {_first("overall", reports.HEADLINES[:-1], reports.HEADLINES[-1][1])}, top_issues := coalesce(top, []), action_counts := struct_pack({", ".join(f"{a} := coalesce({a}, 0)" for a in scoring.ACTIONS)})), items := coalesce(items, [])))::VARCHAR AS report FROM o LEFT JOIN z USING (site_id)"""
)
_say_field = lambda f, p, hit: f"CASE WHEN {hit} AND deleted_at IS NULL THEN CASE WHEN z{f} % 7 <> 0 THEN '{p}' || z{f} END ELSE {f} END"
ORACLE_SQL["gap_by_action"] = analysis_queries._GAP_SQL + f", a AS (SELECT unnest([{', '.join(map(_say, scoring.ACTIONS))}]) AS action_type), s AS (SELECT DISTINCT site_id FROM m) SELECT s.site_id, a.action_type, coalesce(string_agg(rule_id, ',' ORDER BY place), '') AS rules FROM s CROSS JOIN a LEFT JOIN m ON m.site_id = s.site_id AND m.action_type = a.action_type GROUP BY 1, 2"
ORACLE_SQL["changed_businesses"] = f"""WITH b AS (SELECT c_custkey AS id, c_custkey % 40 AS account_id, c_name AS name, c_mktsegment AS category, NULL::VARCHAR AS region, CASE WHEN c_custkey % 3 = 0 THEN 'p' || c_custkey END AS place_id, 'u' AS homepage_url, TIMESTAMP '1998-01-01' + to_days((c_custkey % 900)::INT) AS created_at, CASE WHEN c_custkey % 11 = 0 THEN TIMESTAMP '1998-01-01' + to_days((c_custkey % 900)::INT) END AS deleted_at FROM customer),
  h AS (SELECT o_custkey + CASE WHEN o_orderkey % 13 = 0 THEN 1000000 ELSE 0 END AS id, o_orderkey AS o FROM orders),
  l AS (SELECT id, min(o) AS a, max(o) AS z, max(o) FILTER (o % 5 IN (0, 3)) AS zname, max(o) FILTER (o % 5 = 1) AS zcategory, max(o) FILTER (o % 5 = 1) AS zregion, max(o) FILTER (o % 5 = 3) AS zplace_id, max(o) FILTER (o % 5 = 2) AS zhomepage_url FROM h GROUP BY 1)
  SELECT coalesce(b.id, l.id) AS id, CASE WHEN b.id IS NULL THEN a % 40 ELSE account_id END AS account_id, CASE WHEN z IS NOT NULL AND deleted_at IS NULL THEN coalesce({_say_field("name", "n", "zname IS NOT NULL")}, '') ELSE name END AS name, {", ".join(f"{_say_field(f, f[0] if f != 'homepage_url' else 'u', f'z{f} IS NOT NULL')} AS {f}" for f in ("category", "region", "place_id", "homepage_url"))},
    CASE WHEN b.id IS NULL THEN TIMESTAMP '2000-01-01' + to_days(a::INT) ELSE created_at END AS created_at, CASE WHEN z IS NOT NULL AND deleted_at IS NULL THEN TIMESTAMP '2000-01-01' + to_days(z::INT) ELSE created_at END AS updated_at, deleted_at FROM b FULL JOIN l ON b.id = l.id"""
ORACLE_SQL["found_businesses"] = """WITH b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'p' || c_custkey // 4 END AS place_id, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 60 END AS account_id, c_custkey % 17 AS t FROM customer WHERE c_custkey % 7 <> 0),
  p AS (SELECT place_id, max(id) AS id FROM b GROUP BY 1), a AS (SELECT account_id, arg_max(id, t * 100000000 + id) AS id FROM b GROUP BY 1)
  SELECT p_partkey AS request, CASE p_partkey % 3 WHEN 0 THEN b.id WHEN 1 THEN p.id ELSE a.id END AS found FROM part LEFT JOIN b ON b.id = p_partkey LEFT JOIN p ON p.place_id = 'p' || p_partkey LEFT JOIN a ON a.account_id = p_partkey % 70"""
