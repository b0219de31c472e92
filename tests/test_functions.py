import json

from pyspark.sql import functions as F

from sightline.functions import text as T
from sightline.operators.robots import robots_allowed
from sightline.sources import sitemaps, snippets


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_text_scores(spark):
    lit = F.lit
    r = one(
        spark, n=T.occurrences(lit("AbabAB"), lit("ab")), none=T.occurrences(lit("x"), lit("")), s=T.sentence_list(lit("a. b! c\n d")), p=T.paragraph_list(lit("a\n\nb\n \nc")),
        j=T.jaccard(F.array(lit("a"), lit("b")), F.array(lit("b"), lit("c"))), j0=T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), d=T.keyword_density(lit("커피가 좋은 커피 집"), lit("커피")),
        r=T.readability(lit("a b c. d e f.")), e=T.eeat(lit("대표 전문 인증 2024"), "대표", "전문", "인증", "2024"), a=T.alignment(lit("Good Coffee"), lit("coffee here")),
        q=T.recommendation_quality(lit("짧음")), c=T.copy_problem(lit("SEO-TITLE-001"), [("causal", "때문"), ("rule", "[A-Z]+-[A-Z]+-\\d+")]), t=T.render(lit("{a} and {b} {c}"), F.create_map(lit("a"), lit("1"), lit("b"), lit("2"))), h=T.strip_tags(lit(" <b>x</b> ")),
    )
    assert (r["n"], r["none"], r["s"], r["p"]) == (3, 0, ["a", "b", "c", "d"], ["a", "b", "c"])
    assert round(r["j"], 4) == 0.3333 and r["j0"] == 0 and r["d"] == 0.5 and r["r"] == 100 and r["e"] == 70 and r["a"] == 0.5
    assert r["q"] == 100 - 40 - 15 - 10 and r["c"] == "rule" and r["t"] == "1 and 2 {c}" and r["h"] == "x"


def test_topics_are_distinct(spark):
    r = one(spark, t=T.topics(F.lit("A"), F.array(F.lit("B"), F.lit("A"), F.lit(" ")), F.array(F.lit("C"), F.lit("B")), F.lit("D"), F.lit("")))
    assert [(x["topic"], x["weight"]) for x in r["t"]] == [("A", 0.9), ("B", 0.7), ("C", 0.6), ("D", 0.5)]


def test_sitemaps(spark):
    xml = '<x:urlset xmlns:x="u"><x:url><x:loc> https://a.kr/?a=1&amp;b=2 </x:loc><x:priority>0.3</x:priority></x:url><x:url><x:loc>https://a.kr/b</x:loc><x:priority>0.9</x:priority></x:url></x:urlset>'
    index = "<sitemapindex><sitemap><loc>https://a.kr/s1.xml</loc></sitemap><sitemap><loc>https://a.kr/s2.xml</loc></sitemap></sitemapindex>"
    df = spark.createDataFrame([("a", xml), ("b", index), ("c", "oops"), ("d", None)], "site_id string, xml string")
    got = sitemaps.sitemap_order(sitemaps.sitemap_urls(df)).orderBy("site_id", "place").collect()
    assert [(r["site_id"], r["url"], r["kind"]) for r in got] == [("a", "https://a.kr/b", "url"), ("a", "https://a.kr/?a=1&b=2", "url"), ("b", "https://a.kr/s1.xml", "index")]


def test_robots(spark):
    urls = spark.createDataFrame([("a", "https://a.kr/x"), ("a", "https://a.kr/private/y"), ("b", "https://b.kr/"), ("c", "https://c.kr/")], "site_id string, url string")
    robots = spark.createDataFrame([("a", 200, "User-agent: *\nDisallow: /private/"), ("b", 404, "User-agent: *\nDisallow: /")], "site_id string, status int, body string")
    got = {r["url"]: r["allowed"] for r in robots_allowed(urls, robots, "Bot").collect()}
    assert got == {"https://a.kr/x": True, "https://a.kr/private/y": False, "https://b.kr/": True, "https://c.kr/": True}


def test_decode(spark):
    rows = [("a", "u", "한글".encode("euc-kr"), "text/html; charset=euc-kr"), ("b", "u", b'<meta charset="iso-8859-1">\xe9', None), ("c", "u", "é".encode(), "text/html"), ("d", "u", None, "x; charset=none-such")]
    got = {r["site_id"]: r["html"] for r in sitemaps.decode_pages(spark.createDataFrame(rows, "site_id string, url string, content binary, content_type string")).collect()}
    assert got["a"] == "한글" and got["b"].endswith("é") and got["c"] == "é" and got["d"] == ""


def test_snippets(spark):
    lit = F.lit
    pair = F.array(F.struct(lit("Q<1>").alias("question"), lit("A").alias("answer")))
    r = one(spark, b=snippets.local_business(lit("N"), lit("u"), lit(None).cast("string"), lit("s"), lit("r")), f=snippets.faq_schema(pair), h=snippets.faq_html(pair), t=snippets.llms_txt(lit("N"), lit("S"), F.array(F.struct(lit("a").alias("name"), lit("b").alias("url")))), o=snippets.services(lit("N"), F.array(lit("x"))), c=snippets.breadcrumb(F.array(F.struct(lit("a").alias("name"), lit("b").alias("url")))))
    b = json.loads(r["b"])
    assert b["@type"] == "LocalBusiness" and b["address"]["streetAddress"] == "s" and "telephone" not in b
    assert json.loads(r["f"])["mainEntity"][0]["acceptedAnswer"]["text"] == "A" and "&lt;1&gt;" in r["h"]
    assert r["t"].splitlines()[0] == "# N" and json.loads(r["o"])["@graph"][0]["name"] == "x" and json.loads(r["c"])["itemListElement"][0]["position"] == 1
