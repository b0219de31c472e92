"""What pages tell about language and authority, by hand."""

from pyspark.sql import functions as F

from sightline.functions.language import with_language
from sightline.operators.rules import RULES, evaluate, site_context, with_measures
from sightline.sources.pages import parse_pages

KIND = "title string, h1 string, h2 array<string>, body_text string, industry string, region string, target_keywords array<string>, nlp string"


def facts(spark, *rows):
    return [r["nlp"] for r in with_language(spark.createDataFrame([(*r, "clash") for r in rows], KIND)).collect()]


def test_language_by_hand(spark):
    body = "강남 커피는 좋다. 커피를 볶아요!\n\n커피 후기 3건, 인증. 글쓴이 홍. 10년 경력 2024-01-02 까지"
    a, none, null = facts(spark, ("강남 커피 안내", "커피", [" 커피 ", "메뉴", "", "x"], body, "카페", "강남", ["커피", "차", "", None, "후기 3건"]), (None, None, None, "", None, None, None), (None, None, None, None, None, None, []))
    # three words hold the keyword; the two-word one is counted by the tokens
    assert [(k["keyword"], k["count"]) for k in a["keywords"]] == [("커피", 3), ("차", 0), ("", 0), (None, 0), ("후기 3건", 1)]
    words = body.replace(".", " ").replace(",", " ").replace("!", " ").split()
    assert a["densities"][0] == round(3 / len(words), 4) and a["densities"][1:4] == [0, 0, 0] and a["densities"][4] > 0
    assert a["topics"] == ["커피", "메뉴", "차", "카페", "강남"]
    assert (a["has_author"], a["expertise"], a["trust"], a["fresh"]) == (True, 2, 2, True) and a["eeat"] == 90
    assert a["avg_sentence"] == 3 and a["avg_paragraph"] == 2.5 and a["readability"] == 100
    assert a["alignment"] == round(2 / 3, 4) and a["integration"] == 1
    for x in (none, null):
        assert (x["densities"], x["topics"], x["readability"], x["avg_sentence"], x["has_author"], x["expertise"], x["alignment"], x["eeat"]) == ([], [], 0, 0, False, 0, 0, 0)


def test_long_sentences_cost_readability(spark):
    a, b = facts(spark, ("t", None, [], "w " * 35 + ".", None, None, ["w w"]), ("a b", None, None, ". ".join("abcdefgh"), None, None, []))
    assert a["readability"] == 90 and a["keywords"][0]["count"] == 17 and a["integration"] == round(1 / 17, 4)
    assert b["avg_paragraph"] == 8 and b["readability"] == 85


def test_every_page_with_text_is_measured(spark):
    html = '<title>강남 카페</title><meta property="og:title" content="x"><script type="application/ld+json">[{"@type":"A"},{"@type":"B"}]</script><h1>카페</h1><p>글쓴이 홍길동. 자격증과 경력 3년.</p><a href="/b">b</a>'
    pages = spark.createDataFrame([("s", 0, "https://s.example/", html, 200), ("s", 1, "https://s.example/b", '<link rel="canonical" href="https://t.example/b">', 200)], "site_id string, pos long, url string, html string, status_code int")
    context = with_measures(site_context(parse_pages(pages)))
    r = context.select("backlink.*").first()
    assert (r["https_enforced"], r["hsts"], r["canonical_consistent"], r["structured_data"], r["social_meta"]) == (True, False, False, 2, 1)
    # 10 for https, 10 for two items, 2 for a tag, 0.2 of a fifth of the words
    words = context.first()["word_count"]
    assert r["domain_authority"] == int((10 + 10 + 2 + words / 5 * 0.2) * 0.9 + 0.5)
    got = {x["rule_id"]: x for x in evaluate(context).collect()}
    assert len(got) == len(RULES)
    assert all(x["score_impact"] != "unavailable" for k, x in got.items() if k.startswith("NLP-"))
    assert got["NLP-EEAT-AUTHOR-001"]["passed"] and got["NLP-EEAT-EXPERTISE-001"]["passed"] and not got["NLP-EEAT-TRUST-001"]["passed"] and not got["BACKLINK-CANONICAL-CONSISTENCY-001"]["passed"]
    own = context.select("site_id", "nlp.*").withColumn("readability", F.lit(7.0))
    assert with_measures(site_context(parse_pages(pages), nlp=own)).first()["nlp"]["readability"] == 7
