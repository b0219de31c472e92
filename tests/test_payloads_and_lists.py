"""Recorded payloads, grouped lists, nouns, questions and authors' keywords by hand."""

import json

from pyspark.sql import functions as F

from sightline.functions import korean
from sightline.operators import calibration, competitors, creator, platform, scoring, site_text
from sightline.sources import payloads


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_page_speed(spark):
    body = {"lighthouseResult": {"categories": {"performance": {"score": 0.875}}, "audits": {"largest-contentful-paint": {"numericValue": 2500.5}, "cumulative-layout-shift": {"numericValue": 0.1}, "interactive": {"numericValue": 90}, "interaction-to-next-paint": {"numericValue": None}, "server-response-time": {"numericValue": "12"}}}}
    df = spark.createDataFrame([("a", "mobile", None, json.dumps(body)), ("b", "x", 500, json.dumps(body)), ("c", "x", 200, "{"), ("d", "x", 200, "[]"), ("e", "x", 200, None), ("f", None, 200, '{"lighthouseResult":{"categories":{},"audits":{}}}')], "site_id string, strategy string, status int, body string")
    got = {r["site_id"]: tuple(r)[1:] for r in payloads.page_speed(df).collect()}
    assert got["a"] == ("mobile", 88, 2501, 0, 0.1, 90, 0, 0, None) and got["f"] == (None, 0, 0, 0, 0, 0, 0, 0, None)
    assert {k: v[-1] for k, v in got.items()} == {"a": None, "b": "http_500", "c": "not_json", "d": "incomplete", "e": "no_payload", "f": None}
    assert all(v is None for v in got["b"][1:-1]) and payloads.page_speed(df.limit(0)).collect() == []


def test_local_search(spark):
    items = [{"title": "<b>A</b> 카페", "link": " https://a.kr ", "description": "x <b>y</b>"}, {"title": "서울 병원"}, {"title": "In", "link": "https://Instagram.com/x"}, {"title": "Me", "link": "https://me.kr/z"}, {"title": "C (1)!", "address": "서울 1"}, 3]
    df = spark.createDataFrame([(1, "me.kr", 200, json.dumps({"items": items})), (2, None, 200, "{}"), (3, "", 404, "{}")], "query_id int, self_domain string, status int, body string")
    a, b, c = payloads.local_search(df).orderBy("query_id").collect()
    assert a["self_rank"] == 2 and [(r["rank"], r["name"], r["snippet"]) for r in a["rivals"]] == [(1, "A 카페", "x y"), (3, "C (1)!", None), (4, "", None)]
    assert a["rivals"][1]["url"] == "https://map.naver.com/p/search/C%20(1)!%20%EC%84%9C%EC%9A%B8%201"
    assert (b["rivals"], b["problem"], c["rivals"], c["problem"]) == ([], None, [], "http_404")
    assert [r["name"] for r in payloads.local_search(df, medical=True).orderBy("query_id").first()["rivals"]][1] == "서울 병원"


def test_link_counts_and_channels(spark):
    said = ['{"results":[{"page":{"x":1,"links":"12"},"domain_authority":41.5,"da":1}],"linking_root_domains":true,"z":{"linkingRootDomains":" 7 "}}', "5", '{"da":""}', '{"da":250,"links":-3}', "[[[{\"da\":\"NaN\"},{\"da\":8}]]]"]
    df = spark.createDataFrame([(str(i), 200, b) for i, b in enumerate(said)], "site_id string, status int, body string")
    assert rows(payloads.link_counts(df, "moz"), "site_id") == [("0", 42, 12, 7, None), ("1", 0, 0, 0, None), ("2", 0, 0, 0, None), ("3", 100, 0, 0, None), ("4", 8, 0, 0, None)]
    ads = '{"keywordList":[{"relKeyword":"x","monthlyPcQcCnt":1},{"relKeyword":"A B","monthlyPcQcCnt":"< 10","monthlyMobileQcCnt":120}]}'
    text = lambda *r: spark.createDataFrame(r, "text string, status int, body string")
    assert rows(payloads.search_volume(text(("a b", 200, ads), ("q", 200, ads), ("z", 200, "{}"))), "text") == [("a b", 130, "complete", None), ("q", 1, "complete", None), ("z", None, "complete", None)]
    assert rows(payloads.search_trend(text(("a", 200, '{"results":[{"data":[{"ratio":1.5},{"ratio":4}]}]}'), ("b", 200, "{}"), ("c", 500, "{}"))), "text") == [("a", 2.5, "complete", None), ("b", None, "complete", None), ("c", None, "failed", "http_500")]
    assert rows(payloads.blog_documents(text(("a", 200, '{"total":12}'), ("b", 200, '{"total":"12"}'))), "text") == [("a", 12, "complete", None), ("b", None, "complete", None)]


def test_grouped_items(spark):
    items = spark.createDataFrame([("s", 2, "R2", "self_fix"), ("s", 1, "R1", "self_fix"), ("s", 3, "R3", "other"), ("t", 1, "R9", "si_action")], "site_id string, position int, rule_id string, action_type string")
    sites = spark.createDataFrame([("s",), ("t",), ("u",), ("u",)], "site_id string")
    got = {(r["site_id"], r["action_type"]): [i["rule_id"] for i in r["items"]] for r in scoring.grouped_items(items, "action_type", scoring.ACTIONS, sites).collect()}
    assert len(got) == 12 and {k: v for k, v in got.items() if v} == {("s", "self_fix"): ["R1", "R2"], ("t", "si_action"): ["R9"]}
    assert scoring.grouped_items(items, "action_type", ["other"]).count() == 2 and scoring.grouped_items(items.limit(0), "action_type", scoring.ACTIONS).collect() == []


def test_top_nouns_go_by_first_place(spark):
    pages = spark.createDataFrame([("s", 1, "커피는 좋다. 카페에서 커피를 마셨습니다! 메뉴 카페 빵 Latte Latte"), ("s", 2, None), ("s", 3, " .")], "site_id string, page int, t string")
    assert rows(korean.top_nouns(pages, F.col("t"), 3), "place") == [("s", 1, 1, "커피", 2), ("s", 1, 2, "카페", 2), ("s", 1, 3, "Latte", 2)]


def test_facet_questions(spark):
    df = spark.createDataFrame([("a", " 카페  온 ", "서울", "카페", ["커피", " ", None, "빵", "차", "x"]), ("b", None, " ", "카페", ["커피"]), ("c", None, None, None, None)], "site_id string, business_name string, region string, industry string, target_keywords array<string>")
    got = competitors.facet_questions(df).orderBy("site_id", "place").collect()
    assert [(r["place"], r["facet"]) for r in got if r["site_id"] == "a"] == list(enumerate(["brand-mention"] * 2 + ["industry-region"] * 2 + ["service-recommendation"] * 3 + ["comparative"], 1))
    assert got[0]["query"] == "카페 온에 대해 알려줘" and got[6]["query"] == "서울에서 차 잘하는 곳 추천해줘" and [r["query"] for r in got if r["site_id"] == "b"] == ["커피 잘하는 곳 추천해줘"]
    assert [r["query"] for r in competitors.facet_questions(df, facet="comparative").collect()] == ["서울 카페 인기 매장 5개 비교해줘"] and competitors.facet_questions(df, facet="none").collect() == []


def test_weight_of_code_points(spark):
    texts = ["", "a", "가나", "😀é", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(creator.text_weight(F.col("t"))).collect()] == [sum(map(ord, t or "")) for t in texts]
    keywords = spark.createDataFrame([("강남 추천", 0, 0, True), ("b", 1, 1, False)], "text string, pos int, hop int, include_ai boolean")
    a, b = creator.creator_keywords(keywords).orderBy("pos").collect()
    assert a["id"].startswith("ck_") and b["ai_score"] is None and b["gap"] is None and b["combined"] == b["score"] and a["gap"] == ["empty", "thin", "thin", "crowded"][sum(map(ord, "강남 추천")) % 4]


def test_ranks_of_ties_and_few_values(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    sets = {"a": [3.0], "b": [1.0, 2.0], "c": rng.integers(0, 5, 4001).astype(float).tolist(), "d": rng.normal(size=30_000).tolist(), "e": list(range(9_999)), "f": [7.0] * 50}
    df = spark.createDataFrame([(k, float(v)) for k, vs in sets.items() for v in vs], "rule_id string, m double").repartition(7)
    n = F.col("n")
    got = {r["rule_id"]: tuple(r)[1:] for r in calibration.exact_ranks(df, {"lo": (0.5, F.floor((n + 1) / 2)), "hi": (0.5, F.ceil((n + 1) / 2)), "p90": (0.9, F.ceil(n * 0.9)), "p95": (0.95, F.ceil(n * 0.95))}).collect()}
    at = lambda v, k: sorted(v)[k - 1]
    assert got == {k: tuple(at(v, x) for x in ((len(v) + 1) // 2, -(-(len(v) + 1) // 2), int(np.ceil(len(v) * 0.9)), int(np.ceil(len(v) * 0.95)))) for k, v in sets.items()}


def test_equal_pages_are_pairs_without_rows(spark):
    pages = [("s", i, "alpha beta gamma delta") for i in range(300)] + [("s", 300 + i, "one two three four") for i in range(3)] + [("s", 400, "alpha beta gamma delta more"), ("s", 401, ""), ("s", 402, ""), ("t", 1, "x y")]
    df = spark.createDataFrame(pages, "site_id string, page int, text string")
    got = {r["site_id"]: (r["pages"], r["duplicate_pairs"]) for r in site_text.duplicate_ratio(site_text.page_terms(df, F.col("text")), df).collect()}
    assert got == {"s": (306, 300 * 299 // 2 + 3 + 300), "t": (1, 0)}


def test_normalized_pages_carry_an_entry(spark):
    presence = spark.createDataFrame([("a", "온", None, "서울 1", None, "매일"), ("b", None, "d", None, "02", None)], "site_id string, name string, description string, address string, phone string, opening_hours string")
    pages = spark.createDataFrame([("a", "t", "h", "x", "c"), ("b", "t", "h", "x", "c"), ("z", "t", "h", "x", "c")], "site_id string, title string, h1 string, description string, canonical_url string")
    a, b, z = platform.normalized_pages(pages, presence).orderBy("site_id").collect()
    assert (a["title"], a["h1"], a["description"], a["canonical_url"]) == ("온", "온", None, None) and (b["title"], b["description"]) == ("t", "d") and (z["canonical_url"], z["local_business"]) == ("c", None)
    assert json.loads(a["local_business"]) == {"@context": "https://schema.org", "@type": "LocalBusiness", "name": "온", "description": None, "address": "서울 1", "telephone": None, "openingHours": "매일"}
