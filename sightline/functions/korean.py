"""Korean words by suffix: a light morphology in native expressions.

Fixed values: suffixes are tried in this order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .language import WORD_END, runs
from .numbers import half_up

POSTPOSITIONS = "으로부터 에서는 에서도 에서의 에게는 에게도 에게서 이라는 라는 에서 에게 에는 에도 으로 이라 라고 보다 처럼 만큼 마다 까지 부터 조차 마저 이나 이며 은 는 이 가 을 를 의 에 로 와 과 도 만 나 며 야".split()
VERB_ENDINGS = "었습니다 았습니다 겠습니다 습니다 ㅂ니다 합니다 됩니다 입니다 겠다 ㄴ다 는다 한다 됐다 했다 였다 이다 예요 에요 어요 아요 해요 돼요".split()
ADJECTIVE_ENDINGS = "스럽다 스러운 스럽게 로운 롭다 답다 다운 있는 없는 있다 없다".split()
STOPWORDS = (
    "이 그 저 것 수 곳 분 이것 그것 저것 여기 거기 저기 우리 저희 그들 자기 본인 무엇 어떻게 어디 언제 왜 누구 얼마 몇 그리고 그러나 하지만 또는 또한 그래서 따라서 그러면 그래도 그런데 즉 예를 더 덜 매우 정말 아주 너무 조금 약간 거의 이미 아직 지금 오늘 어제 내일 "
    "이런 그런 저런 어떤 모든 각 다른 같은 여러 이러한 그러한 저러한 등 및 위해 통해 대한 때문 경우 때 후 전 동안 위 아래 있다 없다 하다 되다 있는 없는 있습니다 없습니다 합니다 됩니다 있어요 없어요 안 못 잘 좀 꼭 다"
).split()


def _stem(word: Column, endings: list[str], least: int) -> Column:
    """word without the first ending that leaves at least so many characters;
    null if none does.  An ending that ends with another stands before it, so the
    first that fits is the longest, and one look finds it."""
    assert not any(e.endswith(x) for k, x in enumerate(endings) for e in endings[k + 1 :])
    return F.nullif(F.regexp_extract(word, f"(?s)^(.{{{least},}}?)(?:{'|'.join(endings)})\\z", 1), F.lit(""))


def classify(word: Column) -> Column:
    """(stem, kind) of a word: adjective, verb, noun, or null."""
    korean = (F.char_length(word) >= 2) & word.rlike("[가-힣]$")
    adjective, verb = F.when(korean, _stem(word, ADJECTIVE_ENDINGS, 1)), F.when(korean, _stem(word, VERB_ENDINGS, 1))
    # no ending but a Korean one
    noun = F.coalesce(F.when(word.rlike("[가-힣]$"), _stem(word, POSTPOSITIONS, 2)), word)
    stop = lambda s: s.isin(STOPWORDS)
    kind = lambda s, k: F.struct(s.alias("stem"), F.lit(k).alias("kind"))
    none = F.lit(None).cast("struct<stem:string,kind:string>")
    as_noun = F.when(F.char_length(noun).between(2, 12) & ~stop(noun) & ~noun.rlike(r"^[\d.]+$"), kind(noun, "noun")).otherwise(none)
    return F.when(adjective.isNotNull(), F.when(~stop(adjective), kind(adjective, "adjective")).otherwise(none)).when(verb.isNotNull(), F.when(~stop(verb), kind(verb, "verb")).otherwise(none)).otherwise(as_noun)


def words(pages: DataFrame, text: Column) -> DataFrame:
    """site_id, page, stem, kind, n, first: classified words of each page, how
    often each comes and where first (from 0, among all words).  A null text has
    none."""
    # a page's words stay where the page is, so they are counted and ranked there
    at = pages.select("site_id", "page", text.alias("_text")).repartition("site_id", "page")
    x = at.select("site_id", "page", F.posexplode(runs(F.col("_text"), WORD_END)).alias("at", "w")).groupBy("site_id", "page", "w").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # each different word of a page is classified once
    x = x.withColumn("c", F.explode(F.array_compact(F.array(classify(F.col("w"))))))
    return x.groupBy("site_id", "page", F.col("c.stem").alias("stem"), F.col("c.kind").alias("kind")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def top_nouns(pages: DataFrame, text: Column, k: int = 10) -> DataFrame:
    """site_id, page, ``place``, ``word``, ``n``: the k most frequent nouns of each
    page; of equally frequent ones the one that comes first."""
    nouns = words(pages, text).where("kind = 'noun'")
    order = Window.partitionBy("site_id", "page").orderBy(F.desc("n"), "first")
    return nouns.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("site_id", "page", "place", F.col("stem").alias("word"), "n")


def korean_ratio(text: Column) -> Column:
    solid = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")
    return F.when(F.char_length(solid) == 0, F.lit(0.0)).otherwise(half_up(F.char_length(F.regexp_replace(solid, "[^가-힣]", "")) / F.greatest(F.char_length(solid), F.lit(1)), 4))
