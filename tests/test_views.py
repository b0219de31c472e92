from pyspark.sql import functions as F

from sightline.functions import korean
from sightline.operators import citations, competitors, platform


def test_morphology(spark):
    df = spark.createDataFrame([(w,) for w in "카페에서는 커피를 좋았습니다 맛있는 사랑스러운 그리고 123 은 coffee".split()], "w string")
    got = {r["w"]: r["c"] and tuple(r["c"]) for r in df.select("w", korean.classify(F.col("w")).alias("c")).collect()}
    assert got["카페에서는"] == ("카페", "noun") and got["커피를"] == ("커피", "noun") and got["맛있는"] == ("맛", "adjective") and got["사랑스러운"] == ("사랑", "adjective")
    assert got["좋았습니다"] == ("좋", "verb") and got["그리고"] is None and got["123"] is None and got["은"] is None and got["coffee"] == ("coffee", "noun")
    pages = spark.createDataFrame([("s", 1, "커피를 커피는 좋았습니다"), ("s", 2, None)], "site_id string, page int, text string")
    assert {(r["stem"], r["n"]) for r in korean.words(pages, F.col("text")).collect()} == {("커피", 2), ("좋", 1)}
    assert pages.select(korean.korean_ratio(F.lit("가나 ab"))).first()[0] == 0.5


def test_platform_scope(spark):
    rows = [("website", None, "SEO-CANONICAL-001", False, 3), ("naver_place", None, "SEO-CANONICAL-001", False, 3), ("naver_place", None, "GEO-PHONE-001", False, 10), ("naver_place", None, "SEO-H1-001", False, 3), ("x", "review", "GEO-PHONE-001", False, 10), ("x", "review", "GEO-REVIEW-AGGREGATE-001", False, 6)]
    df = spark.createDataFrame(rows, "source_type string, surface_kind string, rule_id string, passed boolean, rule_weight int").withColumns({"severity": F.lit("high"), "expected_impact": F.lit("high")})
    assert [(r["passed"], r["rule_weight"], r["severity"]) for r in platform.apply_scope(df).collect()] == [(False, 3, "high"), (True, 0, "low"), (False, 10, "high"), (False, 2, "high"), (True, 0, "low"), (False, 6, "high")]


def test_surface_kinds(spark):
    rows = [("website", "https://a.kr", "website"), ("other", "https://booking.naver.com/x", "reservation"), ("other", "https://a.kr/reviews", "review"), ("naver_place", "https://map.naver.com/p/entry/place/1", "place"), ("other", "https://maps.google.com/?cid=1", "map"), ("kakao_place", "https://z.kr", "place"), ("other", "https://z.kr", "other")]
    df = spark.createDataFrame(rows, "t string, u string, k string")
    assert all(r[0] == r[1] for r in df.select("k", platform.surface_kind(F.col("t"), F.col("u"))).collect())
    s = spark.createDataFrame([("s", 2, "B", ["x"]), ("s", 1, " ", ["y", "x"]), ("s", 3, "C", None)], "site_id string, pos int, name string, services array<string>")
    assert tuple(platform.merge_presence(s).first()) == ("s", "B", ["y", "x"])


def test_listed_names_and_context(spark):
    text = '좋습니다\n[추천업체]\n\n1. "가나 카페" (강남)\n2) 우리집\n3. 가나 카페\n4: 다라 - 좋음\n5. 없음\n끝\n6. 아님'
    df = spark.createDataFrame([(text,), ("없음",), (None,)], "r string")
    got = [r[0] for r in df.select(citations.listed_names(F.col("r"), F.lit("우리집"))).collect()]
    assert got[0] == ["가나 카페", "다라"] and not got[1] and not got[2]
    c = spark.createDataFrame([("가나 좋아요 " + "x" * 100, "primary"), ("가나 비추", "negative"), ("1. 가나 " + "x" * 100, "in-list"), ("x" * 100 + "가나", "incidental"), ("없어", "none")], "r string, k string")
    assert all(r[0] == r[1] for r in c.select("k", citations.mention_context(F.col("r"), citations.first_mention(F.col("r"), F.lit("가나")), F.lit("가나"))).collect())


def test_authority(spark):
    df = spark.createDataFrame([("s", True, True, True, True, 9, 9, True, 500.0), ("t", None, None, None, None, None, None, None, None)], "site_id string, https boolean, hsts boolean, sitemap boolean, robots_txt boolean, structured_data int, social_meta int, canonical_consistent boolean, content_length double")
    assert {r["site_id"]: tuple(r)[1:] for r in competitors.heuristic_authority(df).collect()} == {"s": (90, 450, 72), "t": (0, 0, 0)}


def test_channel_lights(spark):
    from sightline.operators import channels

    rows = [(None, None, None, "red"), (4, 3, True, "green"), (4, 4, False, "green"), (4, 1, False, "yellow"), (4, 0, True, "red")]
    df = spark.createDataFrame(rows, "q int, v int, h boolean, k string")
    assert all(r[0] == r[1] for r in df.select("k", channels.naver_light(F.col("q"), F.col("v"), F.col("h"))).collect())
    g = spark.createDataFrame([(None, 85.0, "green"), (float("nan"), 40.0, "yellow"), (-1.0, None, "red")], "a double, b double, k string")
    assert all(r[0] == r[1] for r in g.select("k", channels.google_light(F.col("a"), F.col("b"))).collect())
    a = spark.createDataFrame([(None, None, "red"), (True, True, "green"), (True, False, "red"), (False, True, "yellow")], "g boolean, c boolean, k string")
    assert all(r[0] == r[1] for r in a.select("k", channels.ai_light(F.col("g"), F.col("c"))).collect())


def test_mobile_markup(spark):
    from sightline.operators import channels

    html = '<meta name="viewport" content="width=device-width"><table width="900"><button style="width: 20px; height: 60px">x</button><a href="x" style="width:80px;height:80px">y</a><p style="font-size: 10px">t</p><div style="color:red">'
    r = spark.range(1).select(channels.missing_viewport(F.lit(html)), channels.wider_than(F.lit(html), 390), channels.wider_than(F.lit("<div style='width:100%'>"), 50), channels.small_targets(F.lit(html)), channels.small_text(F.lit(html))).first()
    assert (r[0], r[1], r[2], r[3], tuple(r[4])) == (False, True, False, 1, (2, 1))


def test_recommendations(spark):
    from sightline.operators import recommend

    items = spark.createDataFrame([("s", "A", "짧음"), ("s", "B", "짧음")], "site_id string, rule_id string, text string")
    templates = spark.createDataFrame([("A", "{name} 홈페이지에 '커트 25,000원'처럼 숫자와 단위를 포함한 가격을 1개 이상 적으면 고객이 비용을 가늠할 수 있습니다.")], "rule_id string, template string")
    profiles = spark.createDataFrame([("s", {"name": "행복카페"})], "site_id string, values map<string,string>")
    got = {r["rule_id"]: r for r in recommend.improve(items, templates, profiles).collect()}
    assert got["A"]["source"] == "template" and got["A"]["text"].startswith("행복카페") and got["B"]["text"] == "짧음"
    requests = spark.createDataFrame([("d", i) for i in range(5)], "day string, pos int")
    providers = spark.createDataFrame([(1, "paid", 1.0, 2.0), (2, "local", 0.0, 0.0)], "rank int, provider string, usd_in double, usd_out double")
    rows = recommend.choose_provider(requests, providers, 1.8).orderBy("pos").collect()
    assert [r["provider"] for r in rows] == ["paid"] * 3 + ["local"] * 2 and rows[2]["alert"] == "exhausted" and rows[0]["alert"] is None
