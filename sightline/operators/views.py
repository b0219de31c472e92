"""What owners are shown of rivals, texts made for them, keywords and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import copy_problem
from .scoring import lookup

#: Types of stored texts with the view's type and its title, and
#: the types that are shown without a plan.
ASSETS = {"FAQ_HTML": ("snippet", "검색 답변글"), "LOCAL_BUSINESS": ("place_intro", "가게 소개글"), "ORGANIZATION": ("review_request", "리뷰 요청 문구"), "SERVICE": ("vendor_prescription", "업체 처방전")}
FREE_ASSETS = ["place_intro", "review_request"]
#: What no text may say.
COPY_CLASSES = [
    ("causal-claim", r"1위|1등|일등|매출\s*↑|매출이?\s*(?:늘|올라|상승|증가)|수익\s*(?:늘|증가|상승)|반드시|확실히|무조건|보장|따라\s*하면|고치면\s*(?:추천|1위|상위|노출)|상위\s*노출\s*보장|효과\s*보장|매출\s*보장"),
    ("technical-jargon", r"(?i)(?<![A-Za-z0-9_])(?:SERP|snippet|AEO|GEO|SEO)(?![A-Za-z0-9_])|grounded|스니펫|메타태그|robots\.txt|schema\.org|JSON-?LD|마이크로데이터|구조화\s*데이터|크롤(?:링|러)"),
    ("brokerage", r"중개|매칭해|정산|수수료|마켓플레이스|견적\s*받기|업체\s*연결해|업체\s*추천해\s*드릴|대행사\s*연결|업체\s*매칭"),
    ("rule-code", r"[A-Z]{2,}-[A-Z0-9-]*-?\d{2,}"),
]
#: Where a rival was found, and its name where names are hidden.
RIVAL_SOURCES = [("naver_serp", "naver", "네이버에서 앞선 옆집"), ("gpt_grounded", "ai", "AI에서 앞선 옆집")]
#: Why a keyword is shown.
GROWING, FEW, NOTICED = "지난주보다 찾는 사람이 늘었어요", "글이 적어 지금 쓰기 좋아요", "이번 주 눈에 띈 검색어예요"
#: Labels of the known fields of a piece of evidence (the first
#: field of a label that is there), words for known values, and the rest.
EVIDENCE_LABELS = [("출처", ["source"]), ("수집일", ["collectedAt"]), ("경쟁사", ["competitorName", "name"]), ("순위", ["serpRank", "rank"]), ("질문", ["sampleQuery"]), ("언급 횟수", ["mentionedInQueries"]), ("확인 결과", ["found", "competitorHas"]), ("측정 상태", ["measurementLabel"])]
EVIDENCE_WORDS = {
    "measured": "직접 확인했어요.", "estimated": "준비도 기준으로 추정했어요.", "unavailable": "아직 확인하지 못했어요.", "not_measured": "아직 확인하지 못했어요.", "gap_not_measured": "아직 확인하지 못했어요.", "competitor_reports_unavailable": "아직 확인하지 못했어요.",
    "engine_results": "진단 결과", "naver_place": "네이버 플레이스", "llm_validation": "AI 직접 확인", "website": "가게 홈페이지", "naver_serp": "네이버 검색", "gpt_grounded": "AI 직접 확인", "manual": "직접 입력",
}
UNKNOWN, SUMMARISED, FOUND, NOT_FOUND = "아직 확인되지 않았어요.", "확인한 근거를 요약해 보관했어요.", "확인됐어요.", "확인되지 않았어요."
STATE, EVIDENCE, NO_EVIDENCE = "확인 상태", "확인 근거", "아직 확인한 근거가 없어요."

_trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")


def asset_view(assets: DataFrame, paid: bool) -> DataFrame:
    """assets: business_id, pos, type, code.  Texts of known types, without a
    plan the free ones only; what is blank or breaks a copy rule is left out."""
    t = F.coalesce("code", F.lit(""))
    kind = lookup({k: v[0] for k, v in ASSETS.items()}, F.col("type"))
    good = kind.isNotNull() & (_trim(t) != "") & copy_problem(t, COPY_CLASSES).isNull()
    good = good if paid else good & kind.isin(FREE_ASSETS)
    return assets.where(good).select("business_id", "pos", kind.alias("kind"), lookup({k: v[1] for k, v in ASSETS.items()}, F.col("type")).alias("title"), F.col("code").alias("content"))


def rival_view(rivals: DataFrame, anonymous: bool = False) -> DataFrame:
    """rivals: site_id, pos, source, name, rank.  Those of the search results by
    rank (none counts as 0), then those of AI answers as they come; no blank
    names.  ``place`` runs over a site, hidden names over a source of a site."""
    number = lookup({s: k for k, (s, _, _) in enumerate(RIVAL_SOURCES)}, F.col("source"))
    x = rivals.select("site_id", "pos", _trim(F.coalesce("name", F.lit(""))).alias("name"), number.alias("s"), F.when(number == 0, F.col("rank")).alias("rank")).where("s IS NOT NULL AND name <> ''")
    order = [F.coalesce("rank", F.lit(0)), F.col("pos")]
    x = x.withColumns({"place": F.row_number().over(Window.partitionBy("site_id").orderBy("s", *order)), "k": F.row_number().over(Window.partitionBy("site_id", "s").orderBy(*order))})
    hidden = F.concat(lookup({k: label for k, (_, _, label) in enumerate(RIVAL_SOURCES)}, F.col("s")), F.when(F.col("k") > 1, F.concat(F.lit(" "), F.col("k"))).otherwise(""))
    channel = lookup({k: c for k, (_, c, _) in enumerate(RIVAL_SOURCES)}, F.col("s"))
    return x.select("site_id", "place", (hidden if anonymous else F.col("name")).alias("name"), channel.alias("channel"), "rank")


def radar_preview(keywords: DataFrame, k: int = 5) -> DataFrame:
    """keywords: site_id, pos, keyword, trend7d, docs, verdict.  The first k of a
    site with a reason and a status."""
    reason = F.when(F.col("trend7d") > 0, GROWING).when(F.col("docs") <= 10, FEW).otherwise(NOTICED)
    status = F.when(F.col("verdict").isin("now", "good"), "good").when(F.col("verdict") == "normal", "mid").otherwise("wait")
    w = Window.partitionBy("site_id").orderBy("pos")
    return keywords.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("site_id", "place", "keyword", reason.alias("reason"), status.alias("status"))


def _said(x: Column) -> Column:
    """What is shown of a JSON value (VARIANT): words for those that are known,
    whole numbers without a point, lists and objects only as kept."""
    kind, text = F.schema_of_variant(x), F.try_variant_get(x, "$", "string")
    number = F.try_variant_get(x, "$", "double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    word = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for pair in EVIDENCE_WORDS.items() for v in pair)), text), text)
    return (
        F.when(x.isNull() | (kind == "VOID") | ((kind == "STRING") & (text == "")), UNKNOWN)
        .when(kind == "STRING", word)
        .when(kind == "BOOLEAN", F.when(text == "true", FOUND).otherwise(NOT_FOUND))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), SUMMARISED)
        .otherwise(F.when(whole, number.cast("long").cast("string")).otherwise(number.cast("string")))
    )


def _object_rows(x: Column, label: Column) -> Column:
    """The known fields of an object with their labels; without any, its reason,
    or that it is kept."""
    row = lambda name, detail: F.struct(name.alias("label"), detail.alias("detail"))
    there = lambda v: v.isNotNull() & (F.schema_of_variant(v) != "VOID")
    field = lambda name: F.try_variant_get(x, f"$.{name}", "variant")
    labels = F.array(*(F.struct(F.lit(name).alias("label"), F.try_element_at(F.filter(F.array(*map(field, fields)), there), F.lit(1)).alias("v")) for name, fields in EVIDENCE_LABELS))
    known = F.filter(labels, lambda k: there(k["v"]) & ~((F.schema_of_variant(k["v"]) == "STRING") & (F.try_variant_get(k["v"], "$", "string") == "")))
    reason = field("reason")
    other = F.when(reason.isNotNull(), row(F.lit(STATE), _said(reason))).otherwise(row(label, F.lit(SUMMARISED)))
    return F.when(F.size(known) > 0, F.transform(known, lambda k: row(k["label"], _said(k["v"])))).otherwise(F.array(other))


def evidence_items(rows: DataFrame) -> DataFrame:
    """rows: id, evidence (JSON of any shape).  A row an item: id, place, label,
    detail.

    A list numbers its items, each by what it is; an empty one, wherever it
    stands, says that there is none.  An object shows its known fields.  Null
    evidence is unknown; what is no JSON counts as text.  Lists are laid flat
    level by level until none is left, so a job runs for each level of lists in
    lists; rows that repeat an id are shown together."""
    doc = F.try_parse_json("evidence")
    x = rows.select(F.col("id").cast("long").alias("id"), F.when(doc.isNull(), F.to_variant_object(F.array(F.col("evidence")))).otherwise(doc).alias("x"), doc.isNull().alias("plain"))
    x = x.select("id", F.when(F.col("plain"), F.try_variant_get("x", "$[0]", "variant")).otherwise(F.col("x")).alias("x"), F.lit(EVIDENCE).alias("label"), F.array().cast("array<int>").alias("at"))
    listed = F.schema_of_variant("x").startswith("ARRAY") & (F.size(F.try_variant_get("x", "$", "array<variant>")) > 0)
    done = None
    while True:
        ends = x.where(~F.coalesce(listed, F.lit(False)))
        done = ends if done is None else done.unionByName(ends)
        x = x.where(listed)
        if not x.take(1):
            break
        each = x.select("id", "label", "at", F.posexplode(F.try_variant_get("x", "$", "array<variant>")).alias("k", "x"))
        x = each.select("id", "x", F.concat("label", F.lit(" "), F.col("k") + 1).alias("label"), F.concat("at", F.array(F.col("k"))).alias("at"))
    kind = F.coalesce(F.schema_of_variant("x"), F.lit("VOID"))
    one = F.struct(F.when(kind.startswith("ARRAY"), STATE).otherwise(F.col("label")).alias("label"), F.when(kind.startswith("ARRAY"), NO_EVIDENCE).otherwise(_said(F.col("x"))).alias("detail"))
    items = F.when(kind.startswith("OBJECT"), _object_rows(F.col("x"), F.col("label"))).otherwise(F.array(one))
    shown = done.select("id", "at", F.posexplode(items).alias("n", "item"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("at", "n"))
    return shown.select("id", place.alias("place"), "item.label", "item.detail")


def claim(jobs: DataFrame, limit: int = 5) -> DataFrame:
    """jobs: id, status, attempts, created_at.  The table after one claim: the
    oldest queued jobs, at most limit, run and count an attempt.  The limit is the
    queue's own bound on work at a time."""
    ids = jobs.where("status = 'queued'").orderBy("created_at", "id").limit(limit).select("id", F.lit(True).alias("_claimed"))
    mine = F.coalesce("_claimed", F.lit(False))
    x = jobs.join(F.broadcast(ids), "id", "left")  # limit rows
    return x.withColumns({"status": F.when(mine, "running").otherwise(F.col("status")), "attempts": F.col("attempts") + mine.cast("int")}).withColumnRenamed("_claimed", "claimed").withColumn("claimed", F.coalesce("claimed", F.lit(False)))


def relevance(terms: Column, references: Column) -> Column:
    """Share of the terms that contain a reference or lie in one, case aside: 0
    without terms, 0.5 without references (blank ones match nothing)."""
    low = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(x))
    refs, t = low(references), low(terms)
    hit = F.filter(t, lambda x: F.exists(refs, lambda r: (r != "") & (F.contains(x, r) | F.contains(r, x))))
    return F.when(F.size(refs) == 0, F.lit(0.5)).when(F.size(t) == 0, F.lit(0.0)).otherwise(F.size(hit) / F.greatest(F.size(t), F.lit(1)))
