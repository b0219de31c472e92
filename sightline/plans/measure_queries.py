"""What pages tell about language and authority, and the rules that judge it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.language import AUTHOR, EXPERTISE, FRESH, SENTENCE_END, STOPWORDS, TOKEN_END, TRUST, WORD_END, BLANK, with_language
from ..operators.rules import RULES, evaluate, site_context, with_measures
from .common import made_pages, pick, pick_sql, spread, table

SAID = ["", " 글쓴이 홍길동. 경력 12년, 자격증 보유!", "\n\n후기 120건, 만족도 1위. 업데이트: 2024", " by Kim 2024-03-05 TOP 10 인증", "\n전문가 3명 이상 이용. 수상 2회", " BY 김 박사, 20년 이상 운영. 2023년 4월\n \n\n리뷰"]
HEADS = ["Über uns", " über uns ", "Nos prix", "", "EN", "전문가 소개"]
KEYWORDS = ["the", "An", "de la", "인증", "x.y", "src1", "Die "]


def _pages(spark, d):
    """Documents as main pages: the first eight words as title, a text of the
    list after each body, headings, keywords and a profile by number."""
    i, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    words = F.split(t, " ")
    return spread(table(spark, d, "documents")).select(
        i.cast("string").alias("site_id"), F.lit(0).alias("pos"), F.concat(F.when(i % 3 == 0, "http").otherwise("https"), F.lit("://s"), i, F.lit(".example/")).alias("url"), F.lit(200).alias("status_code"), "doc_id",
        F.when(i % 5 != 0, F.array_join(F.slice(words, 1, 8), " ")).alias("title"), F.when(i % 4 != 0, pick(HEADS, i)).alias("h1"), F.array(pick(HEADS, i + 1), pick(HEADS, i + 2), pick(HEADS, i + 3), pick(HEADS, i + 4)).alias("h2"),
        F.concat(t, pick(SAID, i)).alias("body_text"), F.size(words).alias("word_count"),
        pick(["en", "EN", None, "Nos"], i).alias("industry"), pick(["src1", "", "Seoul"], i).alias("region"), F.slice(F.array(pick(KEYWORDS, i), pick(KEYWORDS, i + 1), F.lit(""), F.lit(None), pick(KEYWORDS, i + 3)), F.lit(1), (i % 6).cast("int")).alias("target_keywords"),
    )


_say = lambda x: "'" + x.replace("'", "''") + "'"
_cls = lambda chars: _say(f"[{chars}]+")
_stop = ", ".join(map(_say, STOPWORDS))
_strip = lambda x: f"regexp_replace({x}, {_say(f'^[{BLANK}]+|[{BLANK}]+$')}, '', 'g')"
_toks = lambda x: f"list_filter(regexp_split_to_array({x}, {_cls(TOKEN_END)}), lambda w: length(w) >= 2 AND w NOT IN ({_stop}))"
_half = lambda x, n: f"floor(({x}) * {n} + 0.5) / {n}"

_PAGES_SQL = f"""p AS (SELECT doc_id AS i, coalesce(text, '') || {pick_sql(SAID, "doc_id")} AS b, CASE WHEN doc_id % 5 <> 0 THEN array_to_string(string_split(coalesce(text, ''), ' ')[1:8], ' ') END AS title, len(string_split(coalesce(text, ''), ' ')) AS wc,
    [CASE WHEN doc_id % 4 <> 0 THEN {pick_sql(HEADS, "doc_id")} ELSE '' END, {pick_sql(HEADS, "doc_id + 1")}, {pick_sql(HEADS, "doc_id + 2")}, {pick_sql(HEADS, "doc_id + 3")}] AS heads, {pick_sql(["en", "EN", None, "Nos"], "doc_id")} AS industry, {pick_sql(["src1", "", "Seoul"], "doc_id")} AS region,
    [{pick_sql(KEYWORDS, "doc_id")}, {pick_sql(KEYWORDS, "doc_id + 1")}, '', NULL, {pick_sql(KEYWORDS, "doc_id + 3")}][1:doc_id % 6] AS keys FROM documents),
  q AS (SELECT *, lower(b) AS l, list_filter(list_transform(regexp_split_to_array(lower(b), {_cls(SENTENCE_END)}), lambda s: {_strip("s")}), lambda s: s <> '') AS s, len(list_filter(regexp_split_to_array(b, {_cls(SENTENCE_END + BLANK)}), lambda w: w <> '')) AS spoken,
    len(list_filter(regexp_split_to_array(b, {_say(f"\\n[{BLANK}]*\\n+")}), lambda x: {_strip("x")} <> '')) AS pars, list_filter(regexp_split_to_array(b, {_cls(WORD_END)}), lambda w: w <> '') AS w, len({_toks("b")}) AS toks, {_toks("lower(coalesce(title, ''))")} AS tt,
    list_filter(list_transform(list_concat(list_concat(heads, list_transform(keys[1:3], lambda k: coalesce(k, ''))), [coalesce(industry, ''), region]), lambda x: {_strip("x")}), lambda x: x <> '') AS every FROM p),
  k AS (SELECT *, list_transform(keys, lambda k: CASE WHEN coalesce(k, '') = '' THEN 0 ELSE (length(l) - length(replace(l, lower(k), ''))) // greatest(length(k), 1) END) AS n, list_transform(every, lambda x: lower(x)) AS low,
    CASE WHEN len(s) > 0 THEN spoken / len(s) ELSE 0 END AS ms, CASE WHEN len(s) > 0 THEN len(s) / greatest(pars, 1) ELSE 0 END AS mp, regexp_matches(b, {_say("(?i)" + AUTHOR)}) AS author, len(regexp_extract_all(b, {_say(EXPERTISE)})) AS expertise, len(regexp_extract_all(b, {_say(TRUST)})) AS trust, regexp_matches(b, {_say(FRESH)}) AS fresh FROM q),
  e AS (SELECT *, list_transform(keys, lambda k, j: CASE WHEN n[j] > 0 THEN least(1.0, {_half("len(list_filter(w, lambda x: contains(x, k))) / greatest(len(w), 1)", 10000)}) ELSE 0 END) AS exact, list_filter(list_transform(keys, lambda k, j: CASE WHEN n[j] > 0 THEN least(1.0, len(list_filter(s, lambda t: contains(t, lower(k)))) / n[j]) END), lambda v: v IS NOT NULL) AS shares,
    list_filter(every, lambda x, j: list_position(low, lower(x)) = j)[1:5] AS topics FROM k),
  f AS (SELECT *, list_transform(keys, lambda k, j: CASE WHEN exact[j] > 0 THEN exact[j] ELSE {_half("least(1.0, n[j] / greatest(toks, 1))", 10000)} END) AS dens, CASE WHEN len(s) = 0 THEN 0 ELSE {_half("greatest(0, least(100, 100 - greatest(0, ms - 25) - 5 * greatest(0, mp - 5)))", 1)} END AS readability,
    CASE WHEN len(tt) = 0 THEN 0 ELSE {_half("len(list_filter(tt, lambda x: contains(l, x))) / len(tt)", 10000)} END AS align, CASE WHEN len(shares) = 0 THEN 0 ELSE {_half("list_reduce(list_prepend(0.0, shares), lambda x, y: x + y) / len(shares)", 10000)} END AS integration FROM e)"""


def language_facts(spark, d):
    x = with_language(_pages(spark, d)).select("doc_id", "nlp.*")
    whole = lambda c, n: F.floor(F.col(c) * n + 0.5).cast("long").alias(c)
    return x.select(
        "doc_id", F.array_join(F.transform("densities", lambda v: F.floor(v * 10000 + 0.5).cast("string")), ",").alias("densities"), F.array_join("topics", "|").alias("topics"), whole("readability", 1), whole("avg_sentence", 100), whole("avg_paragraph", 100),
        "has_author", "expertise", "trust", "fresh", "eeat", whole("alignment", 10000), whole("integration", 10000), F.array_join(F.transform("keywords", lambda k: k["count"].cast("string")), ",").alias("counts"),
    )


PERF = {"lcp": (1500, 97, 31), "fid": (20, 5, 29), "cls": (0, 0.01, 37), "ttfb": (300, 50, 23), "fcp": (900, 75, 19), "performance": (30, 3, 22)}
MEASURED = [r for r in RULES if r.category in ("PERF", "NLP") or r.rule_id in {f"BACKLINK-{x}-001" for x in ("DA", "HTTPS", "CANONICAL-CONSISTENCY", "STRUCTURED-DATA-DIVERSITY", "SOCIAL-META", "INTERNAL-LINK-DEPTH")}]


def measured_rule_results(spark, d):
    """The rules on language, authority and speed: documents as main pages with
    tags, structured data, a canonical url, a sitemap and clicks by number; two in
    three have a measurement of speed."""
    x, i = _pages(spark, d), F.col("doc_id")
    meta = F.map_from_arrays(F.transform(F.sequence(F.lit(0), i % 8), lambda k: F.concat(F.when(k % 3 == 0, "og:").when(k % 3 == 1, "twitter:").otherwise("x:"), k)), F.transform(F.sequence(F.lit(0), i % 8), lambda k: F.lit("v")))
    facts = F.struct((i % 6).cast("int").alias("items"))
    pages = x.withColumns({"meta": meta, "facts_items": facts["items"], "canonical_url": F.when(i % 4 == 1, F.col("url")).when(i % 4 == 2, F.concat(F.lit("https://www.s"), i, F.lit(".example/")))})
    made = made_pages(pages.drop("doc_id"))
    kind = made.schema["facts"].dataType
    made = made.join(pages.select("site_id", "facts_items"), "site_id").withColumn("facts", F.struct(*(F.col("facts_items").alias(f.name) if f.name == "items" else F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields))).drop("facts_items")
    profiles = x.select("site_id", F.lit(None).cast("string").alias("business_name"), "industry", "region", F.array().cast("array<string>").alias("main_services"), "target_keywords")
    sites = x.select("site_id", F.col("url").alias("start_url"), (i % 2 == 0).alias("sitemap_used"), F.lit(None).cast("string").alias("http_protocol"), F.lit(None).cast("int").alias("redirect_chain_length"))
    value = lambda k: (F.lit(PERF[k][0]) + F.lit(PERF[k][1]) * (i % PERF[k][2])).cast("double").alias(k)
    perf = x.where(i % 3 != 1).select("site_id", F.when(i % 2 == 0, "mobile").otherwise("desktop").alias("strategy"), value("performance"), value("lcp"), value("fid"), value("cls"), F.when(i % 5 != 0, (i % 40 * 10).cast("double")).alias("inp"), value("ttfb"), value("fcp"))
    context = with_measures(site_context(made, profiles, sites, perf=perf))
    depth = x.select("site_id", (i % 6).cast("long").alias("link_depth"), F.when(i % 7 == 0, i % 2).otherwise(0).cast("long").alias("unreachable"))
    r = evaluate(context.join(depth, "site_id"), MEASURED)
    return r.select(F.col("site_id").cast("long").alias("doc_id"), "rule_id", "passed", "score_impact")


QUERIES = {f.__name__: f for f in (language_facts, measured_rule_results)}

_value = lambda k: f"({PERF[k][0]} + {PERF[k][1]} * (i % {PERF[k][2]}))"
_TAGS = "len(list_filter(range(0, i % 8 + 1), lambda k: k % 3 < 2))"
_RULES_SQL = {
    "PERF-LCP-001": f"{_value('lcp')} <= 2500", "PERF-LCP-002": f"{_value('lcp')} <= 4000", "PERF-FID-001": f"{_value('fid')} < 100", "PERF-CLS-001": f"{_value('cls')}::DOUBLE <= 0.1", "PERF-CLS-002": f"{_value('cls')}::DOUBLE <= 0.25", "PERF-INP-001": "i % 5 = 0 OR i % 40 * 10 < 200",
    "PERF-TTFB-001": f"{_value('ttfb')} < 800", "PERF-FCP-001": f"{_value('fcp')} <= 1800", "PERF-PERF-SCORE-001": f"{_value('performance')} >= 70", "PERF-MOBILE-001": f"i % 2 = 1 OR {_value('performance')} >= 50",
    "NLP-KEYWORD-DENSITY-001": "len(dens) = 0 OR len(list_filter(dens, lambda v: v BETWEEN 0.01 AND 0.03)) >= ceil(len(dens) * 0.5)", "NLP-TOPIC-RELEVANCE-001": "contains(lower(array_to_string(topics, ' ')), lower(industry)) OR (region <> '' AND contains(lower(array_to_string(topics, ' ')), lower(region)))",
    "NLP-READABILITY-001": "readability >= 60", "NLP-SENTENCE-LENGTH-001": f"{_half('ms', 100)} > 0 AND {_half('ms', 100)} <= 25", "NLP-EEAT-AUTHOR-001": "author", "NLP-EEAT-EXPERTISE-001": "expertise >= 2", "NLP-EEAT-TRUST-001": "trust >= 2 OR fresh", "NLP-SEMANTIC-ALIGN-001": "align >= 0.5",
    "BACKLINK-DA-001": f"floor(0.9 * (CASE WHEN i % 3 <> 0 THEN 10 ELSE 0 END + CASE WHEN i % 2 = 0 THEN 10 ELSE 0 END + least(25, i % 6 * 5) + least(15, {_TAGS} * 2) + CASE WHEN i % 4 <> 2 THEN 10 ELSE 0 END + least(wc, 500) / 5 * 0.2) + 0.5) >= 30",
    "BACKLINK-HTTPS-001": "false", "BACKLINK-CANONICAL-CONSISTENCY-001": "i % 4 <> 2", "BACKLINK-STRUCTURED-DATA-DIVERSITY-001": "i % 6 >= 3", "BACKLINK-SOCIAL-META-001": f"{_TAGS} >= 5", "BACKLINK-INTERNAL-LINK-DEPTH-001": "i % 6 <= 3 AND NOT (i % 7 = 0 AND i % 2 = 1)",
}

ORACLE_SQL = {
    "language_facts": f"""WITH {_PAGES_SQL} SELECT i AS doc_id, array_to_string(list_transform(dens, lambda v: floor(v * 10000 + 0.5)::BIGINT), ',') AS densities, array_to_string(topics, '|') AS topics, readability::BIGINT AS readability, floor(ms * 100 + 0.5)::BIGINT AS avg_sentence, floor(mp * 100 + 0.5)::BIGINT AS avg_paragraph, author AS has_author,
      expertise::INT AS expertise, trust::INT AS trust, fresh, (CASE WHEN author THEN 30 ELSE 0 END + least(30, 10 * expertise) + least(20, 10 * trust) + CASE WHEN fresh THEN 20 ELSE 0 END)::INT AS eeat, floor(align * 10000 + 0.5)::BIGINT AS alignment, floor(integration * 10000 + 0.5)::BIGINT AS integration, array_to_string(n, ',') AS counts FROM f""",
    "measured_rule_results": f"WITH {_PAGES_SQL} " + " UNION ALL ".join(
        f"SELECT i AS doc_id, '{k}' AS rule_id, {'i % 3 = 1 OR ' if k.startswith('PERF') else ''}coalesce({v}, false) AS passed, {'CASE WHEN i % 3 = 1 THEN ' + _say('unavailable') + ' END' if k.startswith('PERF') else 'NULL::VARCHAR'} AS score_impact FROM f" for k, v in _RULES_SQL.items()
    ),
}
