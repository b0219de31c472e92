"""Rule results and surfaces of third-party platform pages, and view labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import lookup

#: Rule prefixes by what a platform page can be judged for.
REFERENCE_ONLY = ["SEO-CANONICAL", "SEO-ROBOTS", "SEO-SITEMAP", "SEO-XML-SITEMAP", "PERF-", "MOBILE-", "BACKLINK-CANONICAL"]
EDITABLE = ["GEO-", "AEO-", "SEO-TITLE", "SEO-META", "SEO-OG", "SEO-IMG-ALT"]
NATIVE = {"map": ["GEO-MAP", "GEO-DIRECTIONS", "GEO-REGION", "GEO-CONTACT"], "review": ["GEO-SOCIAL-PROOF", "GEO-REVIEW", "AEO-TESTIMONIAL"], "reservation": ["SEO-CTA", "AEO-PROCESS", "AEO-CONTACT-DIRECT", "GEO-CONTACT"]}
CHANNEL = {"geo": "naver", "aeo": "ai_citation"}
LABEL = {"geo": "노출", "seo": "소개", "aeo": "소개", "perf": "속도"}
TIER = {"self_fix": "self_fix", "snippet_action": "snippet", "vendor_action": "vendor", "si_action": "ongoing"}


def _starts(prefixes: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith("rule_id", p))


def scope() -> Column:
    """scored, reweighted or ignored, from source_type, surface_kind, rule_id."""
    native = F.lit(False)
    for kind, prefixes in NATIVE.items():
        native = F.when(F.col("surface_kind") == kind, _starts(prefixes)).otherwise(native)
    special = F.coalesce(F.col("surface_kind").isin(list(NATIVE)), F.lit(False))
    return F.when(F.col("source_type") == "website", "scored").when(_starts(REFERENCE_ONLY), "ignored").when(special, F.when(native, "scored").otherwise("ignored")).when(_starts(EDITABLE), "scored").otherwise("reweighted")


def apply_scope(results: DataFrame) -> DataFrame:
    """results with source_type and surface_kind: what a platform controls passes
    with weight 0, what it shows in part has half its weight, at least 1."""
    s = scope()
    weight = F.when(s == "ignored", 0).when((s == "reweighted") & (F.col("rule_weight") > 0), F.greatest(F.lit(1), F.ceil(F.col("rule_weight") * 0.5))).otherwise(F.col("rule_weight"))
    low = lambda c: F.when(s == "ignored", F.lit("low")).otherwise(F.col(c))
    return results.withColumns({"passed": F.col("passed") | (s == "ignored"), "rule_weight": weight.cast("int"), "severity": low("severity"), "expected_impact": low("expected_impact"), "scope": s})


def surface_kind(source_type: Column, url: Column) -> Column:
    """Kind of a surface, from its source type and then its address."""
    low = F.lower(url)
    h = F.coalesce(F.nullif(F.regexp_extract(low, r"^[a-z]+://([^/?#:]*)", 1), F.lit("")), low)
    p = F.regexp_replace(low, r"^[a-z]+://[^/?#]*", "")
    some = lambda c, *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    place = ((source_type == "naver_place") & (h.rlike(r"(^|\.)place\.naver\.com$") | ((h == "map.naver.com") & F.contains(p, F.lit("/entry/place"))))) | ((source_type == "kakao_place") & h.isin("place.map.kakao.com", "place.kakao.com"))
    return (
        F.when(source_type == "website", "website").when(source_type == "naver_blog", "blog").when(source_type.isin("instagram", "facebook"), "social").when(source_type == "youtube", "video")
        .when(some(h, "booking.", "catchtable", "tabling", "reservation") | some(p, "booking", "reservation", "%ec%98%88%ec%95%bd"), "reservation")
        .when(some(h, "review") | some(p, "review", "%eb%a6%ac%eb%b7%b0"), "review").when(place, "place")
        .when(some(h, "maps.", "map.") | some(p, "/maps", "cid="), "map").when(source_type.isin("naver_place", "kakao_place"), "place").otherwise("other")
    )


#: How a platform names itself at the end of titles.
SOURCE_LABELS = {"website": "홈페이지", "naver_place": "네이버 플레이스", "naver_blog": "네이버 블로그", "instagram": "인스타그램", "kakao_place": "카카오 플레이스", "youtube": "유튜브", "facebook": "페이스북", "other_platform": "플랫폼 페이지"}
#: What a platform page's text is searched for.
PHONE = r"0\d{1,2}-\d{3,4}-\d{4}|010-\d{4}-\d{4}"
ADDRESS = r"(?:서울|부산|대구|인천|광주|대전|울산|세종|경기|강원|충북|충남|전북|전남|경북|경남|제주)[^\n.。]{5,40}"
HOURS = r"(?:영업시간|운영시간|매일|월|화|수|목|금|토|일)[^\n.。]{0,40}\d{1,2}:\d{2}[^\n.。]{0,20}"
WORD = r"[가-힣A-Za-z0-9]{2,20}"
NO_SERVICE = ["서울", "강남구", "영업시간", "방문자"]
SERVICE_FIRST = ["coffee", "brunch", "dessert", "beans", "menu", "booking", "reservation", "review", "reviews", "photos"]
HINTS = {"booking_hint": "예약|booking", "recent_hint": "최근|오늘|이번|업데이트|게시|영상|블로그", "review_hint": "리뷰|별점|후기|평점", "photo_hint": "사진|이미지|photo|image"}
SERVICES = 12
#: What is said of every platform page (after its label), and the
#: categories that it concerns.
LIMITATIONS = [("PLATFORM_PUBLIC_HTML_ONLY", "의 공개 HTML과 메타데이터에서 확인 가능한 신호만 수집했습니다."), ("PLATFORM_EDIT_SCOPE_LIMITED", "에서 직접 수정할 수 없는 기술 항목은 점수 감점이 아닌 참고 제한으로 처리합니다.")]
LIMITED = ["seo", "aeo", "geo"]


def platform_presence(pages: DataFrame) -> DataFrame:
    """What a platform's page says of a business.  pages: site_id, source_type,
    url and the columns h1, title, description, meta, body_text of a parsed page.

    The name is the first of h1, og:title and title without the platform's own
    name at its end; the description the first of description, og:description and
    the first sentence of 20 characters.  Text that is not there gives null, no
    services and false hints."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    body, meta = F.coalesce("body_text", F.lit("")), lambda k: F.try_element_at("meta", F.lit(k))
    label = F.coalesce(lookup(SOURCE_LABELS, F.col("source_type")), F.lit(SOURCE_LABELS["other_platform"]))
    title = F.nullif(F.coalesce("h1", meta("og:title"), "title"), F.lit(""))
    name = trim(F.regexp_replace(title, F.concat(F.lit(r"(?i)\s*[-|]\s*\Q"), label, F.lit(r"\E\s*$")), F.lit("")))
    first = F.filter(F.transform(F.split(body, r"[.!?\n]"), trim), lambda x: F.char_length(x) >= 20)
    x = pages.select("site_id", "source_type", "url", name.alias("name"), F.coalesce("description", meta("og:description"), F.try_element_at(first, F.lit(1))).alias("description"), body.alias("_body"))
    x = x.withColumn("_text", F.concat_ws(" ", "_body", F.coalesce("description", F.lit(""))))
    find = lambda p: F.nullif(F.regexp_extract("_text", p, 0), F.lit(""))
    words = F.array_except(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), F.array(*map(F.lit, NO_SERVICE)))  # distinct, in order
    x = x.withColumns({"phone": find(PHONE), "address": trim(find(ADDRESS)), "opening_hours": trim(find(HOURS)), "_words": words, **{name: F.col("_text").rlike("(?i)" + p) for name, p in HINTS.items()}})
    first_words = F.array_intersect(F.array(*map(F.lit, SERVICE_FIRST)), "_words")
    confidence = F.when(F.char_length("_body") < 80, "low").when(F.col("source_type").isin("instagram", "facebook"), "medium").otherwise("high")
    return x.select(
        "site_id", "source_type", surface_kind(F.col("source_type"), F.col("url")).alias("surface_kind"), "name", "description", "phone", "address", F.split("address", r"\s+")[0].alias("region"), "opening_hours",
        F.slice(F.array_union(first_words, "_words"), 1, SERVICES).alias("services"), *HINTS, confidence.alias("confidence"), label.alias("source_label"), limitations(label).alias("limitations"),
    )


def limitations(label: Column) -> Column:
    """What a platform's page can't show, in words with the platform's name."""
    return F.array(*(F.struct(F.lit(code).alias("code"), F.concat(label, F.lit(said)).alias("message"), F.array(*map(F.lit, LIMITED)).alias("categories")) for code, said in LIMITATIONS))


def normalized_pages(pages: DataFrame, presence: DataFrame) -> DataFrame:
    """pages (site_id, title, h1, description, canonical_url and more) as rules may
    look at them: a platform page's title and h1 are the business's name where it
    has one, its description is what was found, it has no canonical url, and
    ``local_business`` is a JSON-LD entry of what is known (unknown fields are
    null).  Pages of sites that presence lacks stay as they are, with a null entry."""
    entry = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("LocalBusiness").alias("@type"), "name", F.col("description"), "address", F.col("phone").alias("telephone"), F.col("opening_hours").alias("openingHours")), {"ignoreNullFields": "false"})
    p = presence.select("site_id", F.col("name").alias("_name"), F.col("description").alias("_description"), entry.alias("local_business"))
    x = pages.join(p, "site_id", "left")
    of = F.col("local_business").isNotNull()
    fields = {"title": F.coalesce("_name", "title"), "h1": F.coalesce("_name", "h1"), "description": F.when(of, F.col("_description")).otherwise(F.col("description")), "canonical_url": F.when(~of, F.col("canonical_url"))}
    return x.withColumns(fields).drop("_name", "_description")


def merge_presence(surfaces: DataFrame, services: int = 20) -> DataFrame:
    """surfaces: site_id, pos, name, services.  First name that is not blank and
    the first distinct services of a site."""
    blank = F.length(F.trim(F.coalesce("name", F.lit("")))) == 0
    g = surfaces.groupBy("site_id").agg(F.min_by(F.when(~blank, F.col("name")), F.when(~blank, F.col("pos"))).alias("name"), F.array_sort(F.collect_list(F.struct("pos", F.coalesce("services", F.array().cast("array<string>")).alias("s")))).alias("x"))
    return g.select("site_id", "name", F.slice(F.array_distinct(F.flatten(F.transform("x", lambda y: y["s"]))), 1, services).alias("services"))


def channel(category: Column) -> Column:
    return lookup(CHANNEL, F.lower(category), "google")


def category_label(category: Column) -> Column:
    return lookup(LABEL, F.lower(category))


def action_tier(action: Column) -> Column:
    return lookup(TIER, action)
