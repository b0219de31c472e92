import pytest
from pyspark.sql import functions as F

from sightline.functions import urls
from sightline.operators import admin, citations, competitors, gap, keywords, site_text
from sightline.streaming import rate_limit as rl


def test_gap_by_hand(spark):
    own = spark.createDataFrame([("s", 0, "a", "SEO", False, "self_fix", "high"), ("s", 1, "b", "SEO", True, "si_action", "low"), ("s", 2, "c", "SEO", False, "vendor_action", "medium")], "site_id string, pos int, rule_id string, category string, passed boolean, action_type string, priority string")
    rivals = spark.createDataFrame([("s", "x", "a", True), ("s", "y", "a", True), ("s", "x", "c", True), ("s", "x", "zz", True)], "site_id string, rival string, rule_id string, passed boolean")
    m = gap.gap_matrix(own, rivals)
    assert [(r["rule_id"], r["gap"]) for r in m.orderBy("place").collect()] == [("a", 1.0), ("c", 0.5), ("b", -1.0)]
    assert [(r["rank"], r["rule_id"], r["score"]) for r in gap.gap_priorities(m).orderBy("rank").collect()] == [(1, "a", 4.5), (2, "c", 1.0)]
    assert [r["rule_id"] for r in gap.strengths(m).collect()] == ["b"]
    scores = spark.createDataFrame([("s", 10.0, None), ("s", 20.0, 5.0)], "site_id string, seo double, aeo double").selectExpr("*", "0d geo", "0d perf", "0d overall")
    got = {r["site_id"]: (r["seo"], r["aeo"]) for r in gap.market_average(spark.createDataFrame([("s",), ("t",)], "site_id string"), scores).collect()}
    assert got == {"s": (15.0, 2.5), "t": (0.0, 0.0)}


def test_competitor_exclusion(spark):
    rows = spark.createDataFrame([("s", "https://www.a.kr/x", "n"), ("s", "https://b.a.kr/", "n"), ("s", "https://ba.kr/", "n"), ("s", "https://c.kr/clinic", "n"), ("t", "https://a.kr/", "n")], "site_id string, url string, name string")
    out = competitors.drop_excluded(rows, spark.createDataFrame([("s", "https://a.kr/any")], "site_id string, excluded_url string"), words=["clinic"])
    assert sorted(r["url"] for r in out.collect()) == ["https://a.kr/", "https://ba.kr/"]


def test_citations(spark):
    df = spark.createDataFrame([("s", 1, "q", "행복카페는 좋아요 example.com", "행복카페", "https://www.example.com/a"), ("s", 2, "q", None, "행복카페", None), ("s", 3, "q", "불행복카페테리아", "행복카페", "x")], "site_id string, pos int, query string, response string, business_name string, url string")
    got = [(r["mentioned"], r["first_index"], r["direct"], r["url_cited"]) for r in citations.cited(df).orderBy("pos").collect()]
    assert got == [(True, 0, True, True), (False, -1, False, False), (True, 1, False, False)]
    m = citations.citation_metrics(citations.cited(df)).first()
    assert (m["citations"], m["mention_rate"], m["url_rate"]) == (3, 0.667, 0.333)


def test_keyword_example(spark):
    df = spark.createDataFrame([(0, 420, 1800, 0.18, "complete", "complete", "complete"), (1, None, None, None, "skipped", "failed", "skipped")], "hop int, docs long, volume long, trend7d double, blog string, search_ad string, datalab string")
    a, b = keywords.keyword_scores(df).orderBy("hop").collect()
    assert a["saturation"] == 0.23 and a["score"] > 70 and a["state"] == "good"
    assert b["saturation"] is None and b["state"] == "wait" and b["reasons"] == [keywords.REASONS[3]]
    assert keywords.run_status(df).first()[0] == "partial" and keywords.run_status(df.limit(0)).first()[0] == "skipped"


def test_expand_with_suggestions(spark):
    seeds = spark.createDataFrame([(1, " 강남  카페 ")], "seed_id int, seed string")
    hints = spark.createDataFrame([(1, 0, "강남 카페 추천"), (1, 1, "카페 조용한"), (1, 2, "강남 카페")], "seed_id int, pos int, text string")
    got = keywords.expand(seeds, hints, 5).orderBy("place").collect()
    assert [r["text"] for r in got] == ["강남 카페", "강남 카페 추천", "카페 조용한", "강남 카페 강남", "강남 카페 카페"]
    assert [r["cluster"] for r in got][2] == "카페" and {r["status"] for r in got} == {"complete"}


def test_next_scan(spark):
    df = spark.sql("SELECT timestamp '2024-06-02 20:59:00' a, timestamp '2024-06-02 21:01:00' b")  # Sunday; Monday 06:01 in Seoul
    got = df.select(keywords.next_scan(F.col("a")).cast("string"), keywords.next_scan(F.col("b")).cast("string")).first()
    assert tuple(got) == ("2024-06-09 21:00:00", "2024-06-09 21:00:00")


def test_url_functions(spark):
    u = {"http://10.1.2.3/": False, "https://172.20.0.1/": False, "https://172.40.0.1/": True, "http://localhost/": False, "ftp://a.kr/": False, "https://a.kr:8080/x": True, "http://[::1]/": False, "nope": False, "http://169.254.169.254/": False}
    df = spark.createDataFrame([(k,) for k in u], "u string")
    assert {r[0]: r[1] for r in df.select("u", urls.is_public(F.col("u"))).collect()} == u
    n = spark.createDataFrame([("a.kr",), ("https://a.kr/b//",), (" http://a.kr ",)], "u string")
    assert [r[0] for r in n.select(urls.normalize(F.col("u"))).collect()] == ["https://a.kr/", "https://a.kr/b", "http://a.kr/"]


def test_topic_clusters(spark):
    rows = [("s", p, t, 1) for p, words in enumerate(["a b c", "a b d", "a e f", "g h"]) for t in words.split()]
    terms = spark.createDataFrame(rows, "site_id string, page int, term string, n long")
    got = site_text.topic_clusters(terms, site_text.tf_idf(terms), most=3, related=2).orderBy("place").collect()
    used = [t for r in got for t in r["terms"]]
    assert len(used) == len(set(used)) and all(r["terms"][0] == r["topic"] for r in got) and len(got) == 3


def fold(times, window, most):
    out, start, n = [], None, 0
    for t in times:
        if start is None or t - start >= window:
            start, n = t, 0
        ok = n < most
        n += ok
        out.append((t, ok))
    return out


def test_rate_limit_is_a_fold(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice("abc"), i, rng.randrange(10_000)) for i in range(500)]
    got = rl.rate_limit(spark.createDataFrame(rows, "key string, event_id long, at_ms long"), 700, 3).collect()
    for k in "abc":
        mine = sorted((at, i) for key, i, at in rows if key == k)
        assert [(r["at_ms"], r["allowed"]) for r in sorted((r for r in got if r["key"] == k), key=lambda r: (r["at_ms"], r["event_id"]))] == fold([t for t, _ in mine], 700, 3)
    with pytest.raises(ValueError):
        rl.rate_limit(spark.createDataFrame(rows, "key string, event_id long, at_ms long"), 0, 1)


def test_stream_rate_limit(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "key string, event_id long, at_ms long"
    for k, rows in enumerate(([("a", 1, 0), ("a", 2, 10), ("a", 3, 20)], [("a", 4, 30), ("a", 5, 100_000), ("b", 6, 5)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = rl.stream_rate_limit(spark.readStream.schema(schema).parquet(str(src)), 90_000, 2, expire=False).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(str(out)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True, 6: True}


def test_job_transitions_and_upsert(spark):
    e = spark.createDataFrame([(1, 0, "queued"), (1, 1, "running"), (1, 2, "completed"), (2, 0, "running"), (2, 1, "completed")], "job_id int, seq int, status string")
    assert [r["legal"] for r in admin.job_transitions(e).orderBy("job_id", "seq").collect()] == [True, True, True, False, True]
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 0, "e")], "k int, v int, x string")
    assert sorted((r["k"], r["x"]) for r in admin.upsert(old, new, "k", "v").collect()) == [(1, "c"), (2, "b"), (3, "e")]
