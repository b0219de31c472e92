import pytest
from pyspark.sql import functions as F

from sightline.functions import mentions
from sightline.operators import scoring
from sightline.operators.rules import RULES, evaluate, site_context
from sightline.operators.rules.context import link_depth
from sightline.sources.pages import SCHEMA, nodes_of, parse_page, parse_pages, schema_facts

HEAD = '<meta charset="utf-8"><meta name="viewport" content="width=device-width">'
GOOD = f"""<html lang="ko"><head>{HEAD}<title>행복 카페 - 강남 커피와 케이크</title>
<meta name="description" content="{'강남역 행복 카페는 직접 볶은 원두로 커피를 내립니다. ' * 2}"><link rel="canonical" href="/"><meta property="og:title" content="행복 카페"><meta property="og:image" content="a.png"><meta property="og:url" content="https://a.kr/">
<script type="application/ld+json">{{"@graph": [{{"@type": "LocalBusiness", "name": "행복 카페", "telephone": "02-123-4567", "address": {{"streetAddress": "테헤란로 1"}}, "aggregateRating": {{"ratingValue": 4.8}}}}, {{"@type": "FAQPage", "mainEntity": [{{"@type": "Question", "name": "q", "acceptedAnswer": {{"text": "a"}}}}]}}]}}</script></head>
<body><main><h1>행복 카페</h1><h2>가격이 얼마인가요?</h2><p>아메리카노는 5,000원 입니다. 저희 행복 카페는 강남구 테헤란로 123 에 있습니다.</p><p>행복 카페의 커피는 매일 볶습니다.</p>
<a href="/menu">메뉴</a><a href="/about/">소개</a><a href="/faq">질문</a><a href="tel:02-123-4567">전화</a><a href="https://map.naver.com/x">지도</a><img src="a.webp" alt="커피" width="1" height="1" loading="lazy"></main></body></html>"""
BAD = '<html><head></head><body><div><img src="x.png"><h2>a</h2><h4>b</h4><input type=text><a href="/p?id=3"></a></div></body></html>'
PROFILE = ("행복 카페", "cafe", "강남", ["커피", "케이크"], ["강남 커피"])
KINDS = "site_id string, business_name string, industry string, region string, main_services array<string>, target_keywords array<string>"


@pytest.fixture(scope="module")
def outcome(spark):
    rows = [("good", 0, "https://a.kr/", GOOD, 200), ("bad", 0, "http://b.kr/a/b/c/d?id=3", BAD, 200), ("bad", 1, "http://b.kr/a/b/c/d?id=3", None, 404)]
    pages = spark.createDataFrame(rows, "site_id string, pos long, url string, html string, status_code int")
    profiles = spark.createDataFrame([(s, *PROFILE) for s in ("good", "bad")], KINDS)
    perf = spark.createDataFrame([("bad", "mobile", 40.0, 3000.0, 120.0, 0.3, None, 900.0, 2000.0)], "site_id string, strategy string, performance double, lcp double, fid double, cls double, inp double, ttfb double, fcp double")
    return evaluate(site_context(parse_pages(pages), profiles, perf=perf)).persist()


PASSES = {
    "good": "SEO-TITLE-001 SEO-TITLE-002 SEO-META-001 SEO-META-002 SEO-H1-001 SEO-IMG-ALT-001 SEO-IMG-FORMAT-001 SEO-CANONICAL-001 SEO-CANONICAL-SELF-001 SEO-MOBILE-001 SEO-KEYWORD-001 SEO-INTERNAL-LINK-001 SEO-CTA-001 SEO-REGION-001 SEO-HTTPS-001 SEO-OG-001 SEO-STRUCTURED-DATA-001 SEO-HEADING-HIERARCHY-001 AEO-FAQ-001 AEO-FAQ-SCHEMA-001 AEO-QUESTION-FORMAT-001 AEO-SERVICE-DESC-001 AEO-PRICE-INFO-001 AEO-LOCAL-SERVICE-001 AEO-QA-PAIR-MARKUP-001 AEO-HEADING-QUESTION-RATIO-001 GEO-BUSINESS-NAME-001 GEO-INDUSTRY-001 GEO-REGION-001 GEO-TRUST-001 GEO-LOCAL-BUSINESS-SCHEMA-001 GEO-PHONE-001 GEO-ADDRESS-001 GEO-BRAND-MENTION-001 GEO-NAP-CONSISTENCY-001 GEO-BRAND-IN-TITLE-001 GEO-MAP-EMBED-001 GEO-REVIEW-AGGREGATE-001 A11Y-IMAGE-ALT-001 A11Y-LANDMARK-001",
    "bad": "SEO-LINK-NEWTAB-001 SEO-ROBOTS-001 PERF-LCP-002 PERF-INP-001",
}
FAILS = {
    "good": "SEO-TWITTER-001 SEO-NAVER-META-001 SEO-SITEMAP-001 AEO-FAQ-COUNT-001 GEO-LLMS-TXT-001 GEO-SERVICE-001",
    "bad": "SEO-TITLE-001 SEO-META-001 SEO-H1-001 SEO-IMG-ALT-001 SEO-HTTPS-001 SEO-URL-001 SEO-PAGE-DEPTH-001 SEO-DUPLICATE-CONTENT-001 SEO-BROKEN-LINK-001 SEO-HEADING-HIERARCHY-001 SEO-CANONICAL-SELF-001 GEO-BUSINESS-NAME-001 GEO-PHONE-001 A11Y-IMAGE-ALT-001 A11Y-FORM-LABEL-001 A11Y-LINK-NAME-001 A11Y-DOC-LANG-001 A11Y-DOC-TITLE-001 A11Y-HEADING-ORDER-001 A11Y-LANDMARK-001 PERF-LCP-001 PERF-FID-001 PERF-CLS-001 PERF-CLS-002 PERF-TTFB-001 PERF-FCP-001 PERF-PERF-SCORE-001 PERF-MOBILE-001",
}


def test_rules_on_a_good_and_a_bad_site(outcome):
    got = {(r["site_id"], r["rule_id"]): r["passed"] for r in outcome.collect()}
    assert len(got) == 2 * 146
    for site in ("good", "bad"):
        assert [x for x in PASSES[site].split() if not got[site, x]] == []
        assert [x for x in FAILS[site].split() if got[site, x]] == []


def test_catalogue_is_complete():
    assert len(RULES) == len({r.rule_id for r in RULES}) == 146


def test_scores_and_items(outcome):
    s = {r["site_id"]: r for r in scoring.overall_scores(scoring.category_scores(outcome)).collect()}
    assert s["good"]["perf"] is None and s["bad"]["perf"] is not None
    assert s["good"]["overall"] > 60 > 40 > s["bad"]["overall"]
    items = scoring.execution_order(scoring.diagnosis_items(outcome)).where("site_id = 'bad'").orderBy("position").collect()
    rank = {"high": 0, "medium": 1, "low": 2}
    assert [rank[i["priority"]] for i in items] == sorted(rank[i["priority"]] for i in items)
    c = scoring.action_counts(scoring.diagnosis_items(outcome)).collect()
    assert all(sum(r[a] for a in scoring.ACTIONS) == r["items"] for r in c)


def test_graded_score_by_hand(spark):
    rows = [("s", 0, "SEO-A", "SEO", True, "high", 10, None), ("s", 1, "SEO-B", "SEO", False, "low", 3, None), ("s", 2, "SEO-C", "SEO", False, "high", 10, "unavailable"), ("s", 3, "NLP-X", "SEO", False, "high", 10, None), ("t", 0, "AEO-A", "AEO", False, "high", 10, "informational")]
    df = spark.createDataFrame(rows, "site_id string, rule_pos int, rule_id string, category string, passed boolean, severity string, rule_weight int, score_impact string")
    got = {r["site_id"]: (r["score"], r["rules"], r["passed_rules"]) for r in scoring.category_scores(df).collect()}
    assert got == {"s": (94, 2, 1), "t": (0, 0, 0)}
    assert {r["site_id"]: r["score"] for r in scoring.category_scores(df, "legacy").collect()} == {"s": 99, "t": 100}


def test_derived_levels(spark):
    df = spark.createDataFrame([("high", "medium", 10), ("low", "high", 3), ("low", "low", 6), ("medium", "medium", 6)], "s string, i string, w int")
    got = [tuple(r) for r in df.select(scoring.priority(F.col("s"), F.col("i")), scoring.impact_score(F.col("w"), F.col("s"))).collect()]
    assert got == [("high", 100), ("medium", 9), ("low", 18), ("medium", 36)]
    g = spark.createDataFrame([(80.0,), (79.0,), (40.0,), (39.0,), (None,), (float("nan"),), (-1.0,)], "x double")
    assert [r[0] for r in g.select(scoring.grade(F.col("x"))).collect()] == ["excellent", "good", "fair", "poor", "poor", "poor", "poor"]


def mentioned(spark, texts, what):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body_text string")
    return [r["v"] for r in rows.select("i", what("body_text").alias("v")).orderBy("i").collect()]


def test_signals_look_around(spark):
    cases = [
        ("price", "커트 25,000원", "예시: 25,000원"), ("cta", "지금 예약하기", "예약하기 취소 불가 안내"), ("recent_year", "최종 수정 2024년", "© 2024년 업데이트"), ("testimonial", "고객 후기: 정말 만족했어요", "후기 작성 안내 이벤트 만족"),
        ("number_period", "운영 10년 되었고", "2024년 행사"), ("registration", "사업자 123-45-67890", "예) 123-45-67890"), ("author_text", "글쓴이 김철수", "by ChatGPT 자동 생성"), ("proof", "별점 4.8 후기 12건", "3점심 메뉴"), ("rating", "평점 4.5", "평점 4.5 없습니다"),
        ("duration", "시공은 약 3시간 소요", "3시간표"), ("updated_on", "최신 2024-05", "가입 양식 2024-05"), ("immediate", "당일 완료", "당일 저녁"), ("channel_aeo", "카톡 문의", "예시 카톡 문의"), ("number_money", "비용 3만원", "전화 02-123-4567 3만원 번호: 1"),
    ]
    for name, yes, no in cases:
        got = mentioned(spark, [yes, no, ""], mentions.signals)
        assert name in got[0] and name not in got[1] and got[2] == [], name
    # of several matches one that stands freely is enough
    assert "price" in mentioned(spark, ["예시 1원 " + "가" * 60 + " 5,000원 입니다"], mentions.signals)[0]


def test_numbers_and_places(spark):
    assert mentioned(spark, ["10:00 - 21:00", "21:00-10:00", "99-100", "9시 30 ~ 18시"], mentions.valid_hours) == [True, False, False, True]
    phones = mentioned(spark, ["전화 02-123-4567, 02.123.4567", "예: 예시 02-123-4567", "1588-1234 또는 010 1234 5678", "예시 02-123-4567 " + "가" * 50 + " 02-123-4567", ""], mentions.phones)
    assert [[tuple(p) for p in x] for x in phones] == [[("021234567", "02")], [], [("15881234", "1588"), ("01012345678", "010")], [("021234567", "02")], []]
    assert mentioned(spark, ["서울시 강남구 테헤란로 123", "서울시 강남구 테헤란로 12-3, 서울시 강남구, 부산시 중구 남포동", "예시 서울시 강남구 테헤란로 1"], mentions.addresses) == [["서울시 강남구 테헤란로 123"], ["서울시 강남구 테헤란로 12-3", "부산시 중구 남포동"], []]
    assert mentioned(spark, ["a@b.co, c.d@e.org", "a@b.co, test@x.com", "예시 a@b.co", "@"], mentions.mail_addresses) == [2, 0, 0, 0]


def test_sentences_keep_names_whole(spark):
    cases = [
        ("See a.com now. It is 3.5 km! End", ["See a.com now", "It is 3.5 km", "End"]), ("Dr. Kim came. Mr.Lee e.g. this! See https://a.b/c.d. More www.x.y. Z", ["Dr. Kim came", "Mr.Lee e.g", "this", "See https://a.b/c.d. More www.x.y. Z"]),
        ("mail a.b@c.de. no end", ["mail a.b@c.de. no end"]), ("가.나 다. 라?! 마。바", ["가.나 다", "라", "마。바"]), ("", []), (" . ! ", []), ("x" * 50_000 + ". y@", ["x" * 50_000, "y@"]), ("a\x01b. c\x02", ["a b", "c"]), ("Wait... what?", ["Wait", "what"]),
    ]
    got = mentioned(spark, [t for t, _ in cases], mentions.sentences)
    assert got == [w for _, w in cases]
    text = "가. 나다 Here ok. 끝" + " z" * 60 + " here"
    assert mentioned(spark, [text], lambda c: mentions.sentences_around(c, "(?i)here", 6)) == [["가", "나다 Here ok", "끝", "z z z here"]]
    assert mentioned(spark, ["a. bb. c"], lambda c: mentions.sentences_around(c, "bb", 0)) == [["bb"]] and mentioned(spark, ["x"], lambda c: mentions.sentences_around(c, "")) == [[]]


def test_parser_cases():
    x = parse_page('<title> a&amp;b </title><meta NAME=Robots content=noindex><body><h1>x<b>y</b></h1><p>one<p>two<ul><li>a<li>b</ul><script>var x="<p>no</p>"</script><a href="HTTPS://www.Q.kr/p/#f">l</a><a href="javascript:x">j</a><a href="mailto:a@b.c?x=1">m</a>', "https://q.kr/")
    assert x["title"] == "a&b" and x["robots_meta"] == "noindex" and x["h1"] == "xy"
    assert [b["text"] for b in x["text_blocks"]] == ["xy", "one", "two", "a", "b"] and "no" not in x["body_text"].split()
    assert len(x["internal_links"]) == 1 and x["external_links"] == [] and x["contact_links"] == [{"kind": "mailto", "value": "a@b.c"}]
    for broken in ("", "<", "<p", "<!--", "<a href='x", "&#xZZ;", "<svg><p>" * 500, "\x00<p>é"):
        assert isinstance(parse_page(broken, "nope")["body_text"], str)
    assert len(nodes_of([{"@graph": [{"a": 1}, [{"b": 2}]]}, "x", None])) == 3
    assert schema_facts([{"@type": ["Thing", "LocalBusiness"], "name": " ", "telephone": "1"}])["local_business"] is False


def test_parse_empty_table(spark):
    pages = spark.createDataFrame([], "site_id string, pos long, url string, html string, status_code int")
    assert parse_pages(pages).collect() == [] and "facts" in SCHEMA
    assert evaluate(site_context(parse_pages(pages))).collect() == []


def test_link_depth(spark):
    u = "https://a.kr/"
    rows = [("s", u, [u + "b"]), ("s", u + "b", [u + "c", u]), ("s", u + "c", []), ("s", u + "z", [u]), ("t", "https://t.kr/", [])]
    pages = spark.createDataFrame(rows, "site_id string, url string, internal_links array<string>")
    start = spark.createDataFrame([("s", u), ("t", "https://t.kr/")], "site_id string, start_url string")
    assert {r["site_id"]: (r["depth"], r["unreachable"]) for r in link_depth(pages, start).collect()} == {"s": (2, 1), "t": (0, 0)}


def test_link_depth_of_a_long_chain(spark):
    u = [f"https://a.kr/{i}" for i in range(20)]
    rows = [("s", u[i], u[max(i - 1, 0) : i + 2]) for i in range(20)] + [("s", "https://a.kr/x", []), ("t", "https://t.kr/", ["https://t.kr/#"])]
    pages = spark.createDataFrame(rows, "site_id string, url string, internal_links array<string>")
    start = spark.createDataFrame([("s", u[0]), ("t", "https://t.kr/")], "site_id string, start_url string")
    assert {r["site_id"]: (r["depth"], r["unreachable"]) for r in link_depth(pages, start).collect()} == {"s": (19, 1), "t": (0, 0)}
