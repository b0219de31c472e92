"""What queries cost on larger tables, and that what makes them cheap changes no result."""

import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from sightline.functions import korean, language
from sightline.operators import site_text
from sightline.plans.registry import QUERIES


def _shuffled(spark):
    """Bytes that this application has written for shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    x = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(x.apply(k).totalShuffleWrite() for k in range(x.size()))


def test_duplicate_pages_shuffle_less_than_they_read(spark):
    d, before = "/root/testdata/sf0.01", _shuffled(spark)
    pages = sum(r["pages"] for r in QUERIES["duplicate_pages"](spark, d).collect())
    moved, (n, size) = _shuffled(spark) - before, spark.read.parquet(f"{d}/documents.parquet").agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    assert pages == n and moved < size


def test_duplicate_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for site in ("a", "b"):
        seeds = [rng.sample(range(400), n) for n in (1, 2, 3, 7, 10, 20, 60, 150) for _ in range(4)]
        for page in range(160):
            words = list(rng.choice(seeds))
            for _ in range(rng.choice([0, 0, 1, 2, len(words) // 6, len(words) // 4])):
                words[rng.randrange(len(words))] = rng.choice([rng.randrange(400), 1000 + rng.randrange(10**6)])
            rng.shuffle(words)
            rows.append((site, page, " ".join(f"w{w}" for w in words)))
    rows += [("a", 500, " ".join(f"x{k}" for k in range(10))), ("a", 501, " ".join(f"x{k}" for k in range(3, 10))), ("a", 502, " ".join(f"x{k}" for k in range(2, 10)))]  # 0.7 is not above it, 0.8 and 0.875 are
    rows += [("a", 600, "u1 u2"), ("a", 600, "u3 U4, u5"), ("a", 601, "u1 u2 u3 u4 u5"), ("a", 602, "!"), ("a", 603, None), (None, 1, "u1"), ("c", None, "u1"), ("c", 1, "u1 u2 u3 u4 u5")]
    df = spark.createDataFrame(rows, "site_id string, page int, text string").repartition(5)
    sets, of = {}, {}
    for site, page, text in rows:
        if site is not None and page is not None:
            sets.setdefault((site, page), set()).update(t for t in re.split(r"\W+", (text or "").lower()) if len(t) >= 2)
    for (s, p), (t, q) in combinations(sets, 2):
        x, y = sets[s, p], sets[t, q]
        of[s] = of.get(s, 0) + (s == t and len(x | y) > 0 and len(x & y) / len(x | y) > 0.7)
    n = {s: len({p for t, p in sets if t == s}) for s, _ in sets}
    for got in (site_text.duplicate_sets(site_text.page_sets(df, F.col("text")), df), site_text.duplicate_ratio(site_text.page_terms(df, F.col("text")), df)):
        found = {r["site_id"]: (r["pages"], r["duplicate_pairs"]) for r in got.where("site_id IS NOT NULL").collect()}
        assert found == {s: (n[s], of.get(s, 0)) for s in n} and of["a"] > 100


def test_top_nouns_shuffle_a_text_once(spark):
    d, before = "/root/testdata/sf0.01", _shuffled(spark)
    n = len(QUERIES["top_nouns"](spark, d).collect())
    moved, (pages, size) = _shuffled(spark) - before, spark.read.parquet(f"{d}/documents.parquet").agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    assert pages < n <= 5 * pages and moved < size


def test_a_stem_leaves_the_first_ending_that_fits(spark):
    """One pattern finds what trying the endings in their order finds."""
    kinds = [(korean.POSTPOSITIONS, 2), (korean.VERB_ENDINGS, 1), (korean.ADJECTIVE_ENDINGS, 1)]
    ws = [stem + a + b for stem in ("", "커", "커피", "Cafe") for a in ("", *{e for es, _ in kinds for e in es}) for b in ("", "는", "다", "\u0085")]
    df = spark.createDataFrame([(w,) for w in ws], "w string")
    for endings, least in kinds:
        want = {w: next((w[: -len(e)] for e in endings if w.endswith(e) and len(w) - len(e) >= least), None) for w in ws}
        assert {r["w"]: r["s"] for r in df.select("w", korean._stem(F.col("w"), endings, least).alias("s")).collect()} == want


def test_dates_and_words_are_found_as_by_the_plain_patterns(spark):
    """What finds a date or counts words quickly gives what the patterns say."""
    dates = ["2024-03-05", "2024.3.5", "x2024-03-05", "2024-03-051", "12024-03-05", "2024-03-05x", "_2024/3/5", "2024-3-5_", "2024-03-05\n", "2024년 3월", "최근 업데이트", "업데이트: 2024", "업데이트:", "2024", "한2024-1-1한", ""]
    bodies = [b + d + a for d in dates for b in ("", " ", "a", "7", ".") for a in ("", "\n", ". b", "9", "!?")]
    pages = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, body_text string").selectExpr("*", *(f"cast(null AS {t}) AS {c}" for c, t in (("title", "string"), ("h1", "string"), ("h2", "array<string>"), ("industry", "string"), ("region", "string"), ("target_keywords", "array<string>"))))
    x = language.with_language(pages)
    assert not re.search(r"regexp_count\(_body#\d+, \[\^", x._jdf.queryExecution().analyzed().toString())
    got = x.select(F.col("nlp.fresh").alias("fresh"), F.regexp_like("body_text", F.lit(language.FRESH)).alias("want"), F.col("nlp.avg_sentence").alias("mean"), F.regexp_count("body_text", F.lit(f"[^{language.SENTENCE_END}{language.BLANK}]+")).alias("words"), "body_text").collect()
    assert {True, False} == {r["fresh"] for r in got} and all(r["fresh"] == r["want"] for r in got)
    n = lambda t: sum(s.strip() != "" for s in re.split(r"[.!?。！？\n]+", t))
    assert all(abs(r["mean"] - (r["words"] / n(r["body_text"]) if n(r["body_text"]) else 0)) < 0.006 for r in got)


def test_pages_without_terms_have_no_duplicates(spark):
    df = spark.createDataFrame([("a", 1, "!"), ("a", 2, None), ("b", 1, "")], "site_id string, page int, text string")
    got = site_text.duplicate_sets(site_text.page_sets(df, F.col("text")), df)
    assert {tuple(r) for r in got.collect()} == {("a", 2, 0, 0.0), ("b", 1, 0, 0.0)}
