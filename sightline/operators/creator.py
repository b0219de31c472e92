"""Keywords as authors are shown them: signals, scores, verdicts and advice.

Where no service has measured a keyword, its signals follow from its code
points, so that the same text always has the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp, half_up
from .keywords import CHANNELS, keyword_scores

#: How signals follow from a keyword's weight and place.
STEP, VOLUME, DOCS, TREND = 37, (180, 6200), (20, 3400), (-8, 34)
#: The share of the search score in the AI score, what a gap among
#: cited sources adds, and the shares of both in the score that is judged.
AI_SHARE, GAP_BONUS, SHARES = 0.62, {"empty": 24, "thin": 14, "crowded": 4}, (0.52, 0.48)
VERDICTS, LAST_VERDICT = [(85, "now"), (70, "good"), (50, "normal")], "watch"
TRENDS, LAST_TREND, NO_TREND = [(12, "급상승"), (0, "완만한 상승")], "관심 하락", "변화 측정 대기"
ANGLE_GAP, ANGLE_CHOICE, ANGLE = "비교표와 단계별 목록으로 비어 있는 인용 영역을 먼저 채우세요.", "상황별 추천 기준표로 나누면 AI 답변에 인용되기 좋습니다.", "첫 문단에 직접 답변, 정의, 최신 업데이트 날짜를 함께 넣으세요."
CHOICE = "추천"


def text_weight(text: Column) -> Column:
    """The sum of the text's code points; 0 for none."""
    t = F.coalesce(text, F.lit(""))
    places = F.when(F.char_length(t) > 0, F.sequence(F.lit(1), F.char_length(t))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0).cast("long"), lambda total, i: total + F.ascii(t.substr(i, F.lit(1))))


def _first(x: Column, steps: list[tuple[int, str]], last: str) -> Column:
    out = None
    for least, name in steps:
        out = F.when(x >= least, name) if out is None else out.when(x >= least, name)
    return out.otherwise(last)


def stand_in_signals(keywords: DataFrame) -> DataFrame:
    """keywords (text, pos and more) with ``volume``, ``docs``, ``trend7d`` and the
    channels' states."""
    base = text_weight(F.col("text")) + F.col("pos") * STEP
    part = lambda start, width: F.lit(start) + base % width
    return keywords.withColumns({"volume": part(*VOLUME), "docs": part(*DOCS), "trend7d": part(*TREND)} | {c: F.lit("complete") for c in CHANNELS})


def cited_sources(text: Column) -> Column:
    return text_weight(text) % 4


def creator_keywords(keywords: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """keywords: text, pos, hop, include_ai.  ``id``, ``score`` (search), ``ai_score``
    and ``gap`` (null where AI is not asked), ``verdict`` of both, ``trend``,
    ``angle``.

    measured: text and the signals of keyword_scores; keywords that are not in it
    have stand-in signals."""
    signals = stand_in_signals(keywords)
    if measured is not None:
        own = measured.select(F.col("text").alias("_text"), F.lit(True).alias("_own"), *(F.col(c).alias(f"_{c}") for c in ("volume", "docs", "trend7d", *CHANNELS)))
        signals = signals.join(own, F.col("text") == F.col("_text"), "left")
        signals = signals.withColumns({c: F.when(F.col("_own"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("volume", "docs", "trend7d", *CHANNELS)}).drop("_text", "_own", *(f"_{c}" for c in ("volume", "docs", "trend7d", *CHANNELS)))
    x = keyword_scores(signals)
    cited = cited_sources(F.col("text"))
    gap = F.when(F.col("include_ai"), F.when(cited == 0, "empty").when(cited <= 2, "thin").otherwise("crowded"))
    bonus = F.coalesce(*(F.when(F.col("gap") == k, v) for k, v in GAP_BONUS.items()))
    x = x.withColumn("gap", gap).withColumn("ai_score", clamp(half_up(F.col("score") * AI_SHARE + bonus), 1, 100).cast("int"))
    both = F.when(F.col("gap").isNull(), F.col("score")).otherwise(half_up(F.col("score") * SHARES[0] + F.col("ai_score") * SHARES[1]).cast("int"))
    return x.select(
        F.concat(F.lit("ck_"), F.lower(F.conv(text_weight(F.col("text")).cast("string"), 10, 36))).alias("id"), "text", "pos", "score", F.when(F.col("gap").isNotNull(), F.col("ai_score")).alias("ai_score"), "gap", both.alias("combined"),
        _first(both, VERDICTS, LAST_VERDICT).alias("verdict"), F.when(F.col("trend7d").isNull(), NO_TREND).otherwise(_first(F.col("trend7d"), TRENDS, LAST_TREND)).alias("trend"),
        F.when(F.col("gap") == "empty", ANGLE_GAP).when(F.contains("text", F.lit(CHOICE)), ANGLE_CHOICE).otherwise(ANGLE).alias("angle"),
    )
