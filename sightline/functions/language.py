"""What the language of a page tells: keyword densities, topics, readability,
experience and trust, relevance.  Expressions over the columns of one row.

Fixed values: white space as the rules know it, where words and sentences end,
which words say nothing, and what counts as evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import clamp, half_up
from .text import occurrences

BLANK = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: What parts words, for densities (WORD_END) and for titles and counts (TOKEN_END).
WORD_END = BLANK + r".,;:!?。！？()\[\]{}\"'`~|/\\<>@#$%^&*+="
TOKEN_END = BLANK + r",.;:!?()\[\]{}\"'`~|/\\<>@#$%^&*+=\-_"
SENTENCE_END = r".!?。！？\n"
STOPWORDS = "이 그 저 것 수 등 및 또는 그리고 또한 하지만 그러나 그래서 때문 위해 통해 대한 있는 없는 있습니다 없습니다 합니다 됩니다 있다 없다 하다 되다 같은 다른 더 덜 매우 정말 아주 너무 이런 그런 저런 어떤 모든 어떻게 왜 무엇".split()
AUTHOR = r"글쓴이|작성자|저자|글:\s|by\s+[가-힣A-Za-z]+|writer|편집자"
EXPERTISE = r"경력\s*\d+\s*년|\d+\s*년\s*(?:경력|업력|운영|이상)|자격증|박사|석사|교수|전문가|전문의|전문직|인증|공인|면허|특허|연구원|학위|마스터|장인|10년|20년|N년"
TRUST = r"수상|인증|후기|리뷰|평점|별점|만족도|TOP\s*\d+|\d+\s*명\s*(?:이상\s*)?(?:이용|선택|방문)|추천\s*\d+|구독자|회원\s*\d+"
FRESH = r"(?:^|[^0-9A-Za-z_])\d{4}[-./]\d{1,2}[-./]\d{1,2}(?:$|[^0-9A-Za-z_])|\d{4}\s*년\s*\d{1,2}\s*월|최근\s*업데이트|업데이트:\s*\d{4}"
#: FRESH without a character before or after the date, and only from where it can
#: begin: a text has one of both or of none.
FRESH_AT = r"(?=[0-9최업])(?:(?<![0-9A-Za-z_])\d{4}[-./]\d{1,2}[-./]\d{1,2}(?![0-9A-Za-z_])|\d{4}\s*년\s*\d{1,2}\s*월|최근\s*업데이트|업데이트:\s*\d{4})"
#: Weights of the sources of a topic and how many of each, in their order.
TOPIC_SOURCES = [("h1", 0.9, 1), ("h2", 0.7, 3), ("target_keywords", 0.6, 3), ("industry", 0.5, 1), ("region", 0.4, 1)]
MOST_TOPICS = 5

#: What ``with_language`` gives, in this order.
LANGUAGE = (
    "struct<densities:array<double>,topics:array<string>,readability:double,avg_sentence:double,has_author:boolean,expertise:int,trust:int,fresh:boolean,alignment:double,"
    "avg_paragraph:double,integration:double,eeat:int,keywords:array<struct<keyword:string,count:int,density:double>>>"
)


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{BLANK}]+|[{BLANK}]+$", "")


def runs(x: Column, ends: str) -> Column:
    """The runs of x between these characters."""
    return F.filter(F.split(x, f"[{ends}]+"), lambda w: w != "")


def _ratio(a: Column, b: Column) -> Column:
    """a / b to four digits; 0 where b is."""
    return F.when(b > 0, half_up(a / F.greatest(b, F.lit(1)), 4)).otherwise(F.lit(0.0))


def _topics() -> Column:
    """The first names of equal ones, case aside, five at most."""
    none = F.array().cast("array<string>")
    given = [F.slice(F.coalesce(F.col(c), none), 1, n) if n > 1 else F.array(F.coalesce(F.col(c), F.lit(""))) for c, _, n in TOPIC_SOURCES]
    every = F.concat(*(F.transform(a, lambda t, w=w: F.struct(trimmed(F.coalesce(t, F.lit(""))).alias("topic"), F.lit(w).alias("weight"))) for a, (_, w, _) in zip(given, TOPIC_SOURCES, strict=True)))
    every = F.filter(every, lambda t: t["topic"] != "")
    low = F.transform(every, lambda t: F.lower(t["topic"]))
    return F.slice(F.filter(every, lambda t, i: F.array_position(low, F.lower(t["topic"])) == i + 1), 1, MOST_TOPICS)


def with_language(pages: DataFrame) -> DataFrame:
    """pages (title, h1, h2, body_text, industry, region, target_keywords; other
    columns stay) with ``nlp``, a struct of LANGUAGE.

    A keyword's count is that of its occurrences, case aside.  Its density is the
    share of words that hold it as written, else its count by the tokens; an
    empty keyword has none.  Readability is 100 less the mean sentence's words
    above 25 and 5 for each sentence of the mean paragraph above 5.  Alignment
    is the share of the title's tokens that the body has; integration the mean,
    over the keywords that occur, of sentences with it by occurrences, at most 1.
    A null or empty body has no words: zeros and no signals.  Steps are columns of
    their own, so none is computed twice."""
    none, body = F.array().cast("array<string>"), F.coalesce(F.col("body_text"), F.lit(""))
    x = pages.withColumns({"_body": body, "_low": F.lower(body), "_keys": F.coalesce("target_keywords", none)})
    x = x.withColumns({
        "_sentences": F.filter(F.transform(F.split("_low", f"[{SENTENCE_END}]+"), trimmed), lambda s: s != ""),
        "_spoken": F.size(runs(F.col("_body"), SENTENCE_END + BLANK)),
        "_paragraphs": F.size(F.filter(F.split("_body", f"\\n[{BLANK}]*\\n+"), lambda p: trimmed(p) != "")),
        "_words": runs(F.col("_body"), WORD_END),
        "_tokens": F.size(F.filter(runs(F.col("_body"), TOKEN_END), lambda w: (F.char_length(w) >= 2) & ~w.isin(STOPWORDS))),
        "_title": F.filter(runs(F.lower(F.coalesce("title", F.lit(""))), TOKEN_END), lambda w: (F.char_length(w) >= 2) & ~w.isin(STOPWORDS)),
        "_topics": _topics(),
    })
    s = F.size("_sentences")
    holding = lambda k: F.size(F.filter("_words", lambda w: F.contains(w, k)))

    def keyword(k: Column) -> Column:
        n = F.when(F.coalesce(k, F.lit("")) == "", F.lit(0)).otherwise(occurrences(F.col("_body"), k))
        exact = F.when(n > 0, F.least(F.lit(1.0), _ratio(holding(k), F.size("_words")))).otherwise(F.lit(0.0))
        rough = half_up(F.least(n / F.greatest("_tokens", F.lit(1)), F.lit(1.0)), 4)
        said = F.size(F.filter("_sentences", lambda t: F.contains(t, F.lower(k))))
        return F.struct(k.alias("keyword"), n.alias("count"), F.when(exact > 0, exact).otherwise(rough).alias("density"), F.when(n > 0, F.least(said / F.greatest(n, F.lit(1)), F.lit(1.0))).alias("share"))

    hits = lambda p: F.regexp_count("_body", F.lit(p))
    x = x.withColumns({
        "_sentence": F.when(s > 0, F.col("_spoken") / F.greatest(s, F.lit(1))).otherwise(0.0),
        "_paragraph": F.when(s > 0, s / F.greatest("_paragraphs", F.lit(1))).otherwise(0.0),
        "_found": F.transform("_keys", keyword),
        "_author": F.regexp_like("_body", F.lit(f"(?iu){AUTHOR}")), "_expertise": hits(EXPERTISE), "_trust": hits(TRUST), "_fresh": F.regexp_like("_body", F.lit(FRESH_AT)),
    })
    shares = F.filter(F.transform("_found", lambda k: k["share"]), lambda v: v.isNotNull())
    nlp = F.struct(
        F.transform("_found", lambda k: k["density"]),
        F.transform("_topics", lambda t: t["topic"]),
        F.when(s > 0, half_up(clamp(100 - F.greatest(F.lit(0.0), F.col("_sentence") - 25) - 5 * F.greatest(F.lit(0.0), F.col("_paragraph") - 5), 0, 100))).otherwise(F.lit(0)),
        half_up(F.col("_sentence"), 2), "_author", "_expertise", "_trust", "_fresh",
        _ratio(F.size(F.filter("_title", lambda t: F.contains("_low", t))), F.size("_title")),
        half_up(F.col("_paragraph"), 2),
        _ratio(F.aggregate(shares, F.lit(0.0), lambda a, v: a + v), F.size(shares)),
        F.when(F.col("_author"), 30).otherwise(0) + F.least(F.lit(30), 10 * F.col("_expertise")) + F.least(F.lit(20), 10 * F.col("_trust")) + F.when(F.col("_fresh"), 20).otherwise(0),
        F.transform("_found", lambda k: F.struct(k["keyword"], k["count"], k["density"])),
    ).cast(LANGUAGE)
    return x.withColumn("nlp", nlp).select(*(c for c in pages.columns if c != "nlp"), "nlp")
