"""Keyword expansion, signals and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up, score100

CHANNELS = ["blog", "search_ad", "datalab"]
LIMIT = 30
#: Modifiers of the fallback expansion, in order.
MODIFIERS = ["추천", "가격", "예약", "근처", "메뉴", "맛집", "위치"]
#: Component weights.
WEIGHTS = {"related": 0.15, "volume": 0.35, "saturation": 0.3, "trend": 0.1, "confidence": 0.1}
REASONS = ["검색량이 충분해요", "문서 수에 비해 찾는 사람이 많아요", "최근 7일 관심이 오르고 있어요", "아직은 지켜보는 편이 좋아요"]
NO_REASON = "근거 신호가 일부만 들어왔어요"


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def expand(seeds: DataFrame, suggestions: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """seeds: seed_id, seed.  suggestions: seed_id, pos, text.  Candidates of each
    seed in order, first of equal texts: the seed (hop 0), its suggestions (hop
    1), then, while there are fewer than limit, the seed with each of its tokens
    (hop 1), with each modifier (hop 1), and its first token with each modifier
    (hop 2).  Columns: seed_id, place, text, cluster, hop, fallback, status."""
    s = seeds.select("seed_id", clean(F.col("seed")).alias("seed")).where("seed <> ''").withColumn("tokens", F.split("seed", " "))
    first = F.element_at("tokens", 1)
    item = lambda text, cluster, hop, fallback: F.struct(text.alias("text"), cluster.alias("cluster"), F.lit(hop).alias("hop"), F.lit(fallback).alias("fallback"))
    words = F.array(*map(F.lit, MODIFIERS))
    join = lambda a, b: F.concat_ws(" ", a, b)
    if suggestions is not None:
        g = suggestions.where("text IS NOT NULL").groupBy("seed_id").agg(F.array_sort(F.collect_list(F.struct("pos", clean(F.col("text")).alias("text")))).alias("found"))
        s = s.join(g, "seed_id", "left")
    else:
        s = s.withColumn("found", F.lit(None).cast("array<struct<pos:int,text:string>>"))
    found = F.filter(F.coalesce("found", F.array().cast(s.schema["found"].dataType)), lambda x: x["text"] != "")
    shared = lambda text: F.coalesce(F.try_element_at(F.array_intersect("tokens", F.split(text, " ")), F.lit(1)), F.element_at(F.split(text, " "), 1))
    own = F.array(item(F.col("seed"), first, 0, False))
    hinted = F.transform(found, lambda x: item(x["text"], shared(x["text"]), 1, False))
    by_token = F.transform(F.filter("tokens", lambda t: t != F.col("seed")), lambda t: item(join(F.col("seed"), t), t, 1, True))
    by_word = F.transform(words, lambda m: item(join(F.col("seed"), m), first, 1, True))
    by_first = F.transform(words, lambda m: item(join(first, m), first, 2, True))
    hints = F.size(found)
    out = s.select("seed_id", hints.alias("hints"), F.posexplode(F.concat(own, hinted, by_token, by_word, by_first)).alias("pos", "c")).select("seed_id", "hints", "pos", "c.*")
    out = out.groupBy("seed_id", "text").agg(F.min("pos").alias("pos"), F.min_by(F.struct("cluster", "hop", "fallback", "hints"), "pos").alias("c")).select("seed_id", "text", "pos", "c.*")
    w = Window.partitionBy("seed_id")
    out = out.withColumn("place", F.row_number().over(w.orderBy("pos"))).where(F.col("place") <= limit)
    status = F.when(F.col("hints") == 0, "fallback").when(F.count(F.lit(1)).over(w) < limit, "partial").otherwise("complete")
    return out.withColumn("status", status).select("seed_id", "place", "text", "cluster", "hop", "fallback", "status")


def collect_signals(keywords: DataFrame, blog: DataFrame, search_ad: DataFrame, datalab: DataFrame) -> DataFrame:
    """keywords (text, ...) with docs, volume and trend7d from three channel
    tables (text, value, status).  A missing row means skipped."""
    out = keywords
    for table, channel, name in ((blog, "blog", "docs"), (search_ad, "search_ad", "volume"), (datalab, "datalab", "trend7d")):
        one = table.groupBy("text").agg(F.max(F.struct("value", "status")).alias("v")).select("text", F.col("v.value").alias(name), F.col("v.status").alias(channel))
        out = out.join(one, "text", "left").withColumn(channel, F.coalesce(channel, F.lit("skipped")))
    return out


def saturation(docs: Column, volume: Column) -> Column:
    return F.when((docs.isNotNull()) & (volume > 0), half_up(docs / volume, 2))


def keyword_scores(signals: DataFrame) -> DataFrame:
    """signals: hop, docs, volume, trend7d and a status column a channel; with
    components, ``score``, ``state`` and ``reasons``.  A missing signal has a
    middling component, not none."""
    v, sat, t = F.col("volume").cast("double"), saturation(F.col("docs"), F.col("volume")), F.col("trend7d").cast("double")
    parts = {
        "related": F.when(F.col("hop") == 0, 100).when(F.col("hop") == 1, 82).otherwise(65),
        "volume": F.when(v.isNull() | (v <= 0), F.lit(15)).otherwise(score100(F.log10(v + 1) / 4 * 100)),
        "saturation": F.when(sat.isNull(), 40).when(sat <= 0.25, 95).when(sat <= 0.8, 75).when(sat <= 1.5, 55).otherwise(30),
        "trend": F.when(t.isNull(), F.lit(45)).otherwise(score100(50 + t * 150)),
        "confidence": score100(sum((F.col(c) == "complete").cast("int") for c in CHANNELS) / len(CHANNELS) * 100),
    }
    out = signals.withColumns({"saturation": sat} | {f"c_{k}": c for k, c in parts.items()})
    score = score100(F.col("c_related") * WEIGHTS["related"] + F.col("c_volume") * WEIGHTS["volume"] + F.col("c_saturation") * WEIGHTS["saturation"] + F.col("c_trend") * WEIGHTS["trend"] + F.col("c_confidence") * WEIGHTS["confidence"])
    out = out.withColumn("score", score).withColumn("state", F.when(F.col("score") >= 70, "good").when(F.col("score") >= 45, "mid").otherwise("wait"))
    said = [F.coalesce(v, F.lit(0)) >= 1000, F.coalesce(F.col("saturation") <= 0.5, F.lit(False)), F.coalesce(t, F.lit(0)) > 0.1, F.col("score") < 45]
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in zip(said, REASONS, strict=True))))
    return out.withColumn("reasons", F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit(NO_REASON))))


def run_status(signals: DataFrame) -> DataFrame:
    """One row: complete, skipped or failed if every channel of every keyword
    is; skipped without keywords; else partial."""
    every = lambda s: F.bool_and(F.forall(F.array(*CHANNELS), lambda c: c == s))
    return signals.agg(F.count(F.lit(1)).alias("n"), every("complete").alias("c"), every("skipped").alias("s"), every("failed").alias("f")).select(
        F.when(F.col("n") == 0, "skipped").when(F.col("c"), "complete").when(F.col("s"), "skipped").when(F.col("f"), "failed").otherwise("partial").alias("status")
    )


#: Positions are counted in slices of so many.
SLICE = 65536


def numbered(rows: DataFrame, key: str, pos: str, name: str) -> DataFrame:
    """rows with their number from 1 in the order of pos (whole numbers) within
    key.  Counted within slices of positions and then over slices, so that no
    key is sorted in one task."""
    r = rows.withColumn("_slice", F.floor(F.col(pos) / SLICE))
    before = r.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    at = F.row_number().over(Window.partitionBy(key, "_slice").orderBy(pos))
    return r.withColumn("_at", at).join(before, [key, "_slice"]).withColumn(name, F.col("_before") + F.col("_at")).drop("_slice", "_at", "_before")


def quota_guard(requests: DataFrame, budgets: DataFrame) -> DataFrame:
    """requests: channel, pos.  budgets: channel, budget, used.  ``allowed``: the
    first budget - used requests of a channel; one without a budget has no
    bound."""
    b = budgets.select("channel", F.greatest(F.lit(0), F.col("budget") - F.col("used")).alias("left"))
    r = numbered(requests, "channel", "pos", "_place").join(b, "channel", "left")
    return r.withColumn("allowed", F.col("left").isNull() | (F.col("_place") <= F.col("left"))).drop("_place", "left")


def radar_verdict(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 65, "good").when(score >= 45, "fair").otherwise("weak")


def creator_verdict(score: Column) -> Column:
    return F.when(score >= 85, "excellent").when(score >= 70, "good").when(score >= 50, "fair").otherwise("weak")


def creator_score(naver: Column, ai: Column) -> Column:
    return half_up(naver * 0.52 + F.coalesce(ai, naver) * 0.48).cast("int")


def next_scan(at: Column, zone: str = "Asia/Seoul") -> Column:
    """The next Monday 06:00 in the zone, as UTC; a Monday goes to the next."""
    local = F.from_utc_timestamp(at, zone)
    return F.to_utc_timestamp(F.next_day(local.cast("date"), "MO").cast("timestamp") + F.expr("INTERVAL 6 HOURS"), zone)


def attach_probe(signals: DataFrame, probes: DataFrame, k: int = 5) -> DataFrame:
    """signals (run_id, text, score) with ``probe``: the score of the run's one
    probe for its k best texts (by score, then text), null for the others."""
    w = Window.partitionBy("run_id").orderBy(F.desc_nulls_last("score"), "text")
    ranked = signals.withColumn("_n", F.row_number().over(w)).join(probes.select("run_id", F.col("score").alias("_probe")), "run_id", "left")
    return ranked.withColumn("probe", F.when(F.col("_n") <= k, F.col("_probe"))).drop("_n", "_probe")
