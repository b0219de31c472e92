"""Text scores as native expressions.

Where a dictionary or a word list decides, it is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clamp, half_up


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences, case aside; 0 for an empty needle."""
    t, n = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(needle, F.lit("")))
    return F.when(F.char_length(n) == 0, F.lit(0)).otherwise(((F.char_length(t) - F.char_length(F.replace(t, n, F.lit("")))) / F.greatest(F.char_length(n), F.lit(1))).cast("int"))


def tokens(text: Column, min_length: int = 1, stop: list[str] = ()) -> Column:
    """Runs between white space and punctuation, long enough and no stop word."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s.,!?;:()\[\]{}\"'“”‘’·…/|<>]+"), lambda w: F.char_length(w) >= max(min_length, 1))
    return F.filter(words, lambda w: ~w.isin(list(stop))) if stop else words


def sentence_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?。！？\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def paragraph_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda s: F.trim(s)), lambda s: s != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays' distinct values; 0 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / F.greatest(either, F.lit(1)))


def keyword_density(text: Column, keyword: Column) -> Column:
    """Share of tokens that are or contain the keyword; without tokens 0."""
    t, k = tokens(F.lower(text)), F.lower(keyword)
    return F.when((F.size(t) == 0) | (k == ""), F.lit(0.0)).otherwise(half_up(F.size(F.filter(t, lambda w: F.contains(w, k))) / F.greatest(F.size(t), F.lit(1)), 4))


def readability(text: Column) -> Column:
    """100 less what the mean sentence has above 25 words, less 5 for each
    sentence that the mean paragraph has above 5."""
    s, p = F.size(sentence_list(text)), F.size(paragraph_list(text))
    words = F.size(tokens(text))
    mean_s, mean_p = F.when(s > 0, words / F.greatest(s, F.lit(1))).otherwise(0.0), F.when(p > 0, s / F.greatest(p, F.lit(1))).otherwise(0.0)
    return clamp(100 - F.greatest(F.lit(0.0), mean_s - 25) - 5 * F.greatest(F.lit(0.0), mean_p - 5), 0, 100)


def eeat(text: Column, author: str, expertise: str, trust: str, fresh: str) -> Column:
    """0..100: 30 for an author, up to 30 for expertise and 20 for trust, 10 a
    hit, and 20 for freshness; each a regular expression."""
    t = F.coalesce(text, F.lit(""))
    hits = lambda p: F.regexp_count(t, F.lit(p))
    return (F.when(hits(author) > 0, 30).otherwise(0) + F.least(F.lit(30), 10 * hits(expertise)) + F.least(F.lit(20), 10 * hits(trust)) + F.when(hits(fresh) > 0, 20).otherwise(0)).cast("int")


def alignment(title: Column, body: Column) -> Column:
    """Share of the title's tokens that the body contains; without tokens 0."""
    t = F.array_distinct(tokens(F.lower(title), 2))
    return F.when(F.size(t) == 0, F.lit(0.0)).otherwise(F.size(F.filter(t, lambda w: F.contains(F.lower(body), w))) / F.greatest(F.size(t), F.lit(1)))


def topics(h1: Column, h2: Column, keywords: Column, industry: Column, region: Column, most: int = 5) -> Column:
    """Topics with weights, first of equal names: h1 .9, three h2 .7, three
    keywords .6, industry .5, region .4."""
    one = lambda c, w: F.filter(F.array(F.struct(F.trim(F.coalesce(c, F.lit(""))).alias("topic"), F.lit(w).alias("weight"))), lambda x: x["topic"] != "")
    many = lambda a, w: F.transform(F.slice(F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x) != ""), 1, 3), lambda x: F.struct(F.trim(x).alias("topic"), F.lit(w).alias("weight")))
    every = F.concat(one(h1, 0.9), many(h2, 0.7), many(keywords, 0.6), one(industry, 0.5), one(region, 0.4))
    first = F.filter(every, lambda x, i: F.array_position(F.transform(every, lambda y: y["topic"]), x["topic"]) == i + 1)
    return F.slice(first, 1, most)


def recommendation_quality(text: Column) -> Column:
    """100 less penalties: length in characters, more than three commands, more
    than 30 % Latin letters, no example or figure, no context."""
    t = F.coalesce(text, F.lit(""))
    n = F.char_length(t)
    length = F.when(n < 20, 40).when(n < 50, 15).when(n > 300, 20).when(n > 200, 10).otherwise(0)
    commands = F.when(F.regexp_count(t, F.lit(r"하세요|하십시오|해주세요|바랍니다")) > 3, 15).otherwise(0)
    latin = F.when(F.char_length(F.regexp_replace(t, "[^A-Za-z]", "")) > 0.3 * n, 15).otherwise(0)
    example = F.when(t.rlike(r"\d|예:|예를|처럼|'[^']+'"), 0).otherwise(15)
    context = F.when(t.rlike("고객|방문|검색|AI|홈페이지|업체"), 0).otherwise(10)
    return clamp(100 - length - commands - latin - example - context, 0, 100).cast("int")


def copy_problem(text: Column, classes: list[tuple[str, str]]) -> Column:
    """Name of the first class (name, pattern) that the text matches, else null."""
    out = None
    for name, pattern in classes:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out if out is not None else F.lit(None).cast("string")


def render(template: Column, values: Column) -> Column:
    """The template with each {key} of a map replaced; unknown keys stay."""
    return F.aggregate(F.map_entries(values), template, lambda acc, kv: F.replace(acc, F.concat(F.lit("{"), kv["key"], F.lit("}")), F.coalesce(kv["value"], F.lit(""))))


def token_cost(tokens_in: Column, tokens_out: Column, usd_in: Column, usd_out: Column) -> Column:
    return F.coalesce(tokens_in / 1000 * usd_in + tokens_out / 1000 * usd_out, F.lit(0.0))


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, "<[^>]*>", ""))
