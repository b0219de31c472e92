"""146 rules as native expressions over a site's context.

A rule is (id, severity, weight, action, difficulty, impact, passed, impact on
the score).  The last is null for a scored rule and else says why it is not.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import urls
from ...sources import patterns as P

SEVERITY = {"H": "high", "M": "medium", "L": "low"}
ACTION = {"vendor": "vendor_action", "self": "self_fix", "si": "si_action", "snippet": "snippet_action"}
_STRINGS = "array<string>"


@dataclass(frozen=True)
class RuleSpec:
    rule_id: str
    severity: str
    weight: int
    action: str
    difficulty: str
    impact: str
    passed: Callable[[], Column]
    score_impact: Callable[[], Column] | None = None
    severity_when: Callable[[], Column] | None = None

    @property
    def category(self) -> str:
        return self.rule_id.split("-")[0]


# ---- small words for the expressions below
#: The expressions of one building of rules; each has a dictionary of its own.
_built: ContextVar[dict] = ContextVar("built")
#: The catalogue's rules as built for a JVM: they name columns and are bound to no
#: table or session, so later evaluations take them as they are.
_ready: dict[int, dict[str, Column]] = {}


def shared(build: Callable[..., Column]) -> Callable[..., Column]:
    """An expression of names only, built once for all rules of an evaluation."""

    @functools.wraps(build)
    def get(*names):
        built, key = _built.get(), (build, names)
        if key not in built:
            built[key] = build(*names)
        return built[key]

    return get


c = shared(lambda name: F.col(name))
true = lambda: F.lit(True)


@shared
def text(name: str) -> Column:
    return F.coalesce(c(name), F.lit(""))


def filled(x: Column) -> Column:
    return F.length(F.trim(F.coalesce(x, F.lit("")))) > 0


@shared
def meta(key: str) -> Column:
    return F.try_element_at("meta", F.lit(key))


@shared
def listed(name: str) -> Column:
    return F.coalesce(c(name), F.array().cast(_STRINGS))


def signal(*names: str) -> Column:
    return F.arrays_overlap("signals", F.array(*map(F.lit, names)))


@shared
def fact(name: str) -> Column:
    return F.coalesce(c(f"facts.{name}"), F.lit(False))


def share(array: str, keep: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(array, keep)) / F.greatest(F.size(array), F.lit(1))


def unless(applies: Callable[[], Column], why: str) -> Callable[[], Column]:
    return lambda: F.when(~applies(), F.lit(why))


def always(why: str) -> Callable[[], Column]:
    return lambda: F.lit(why)


has_images = shared(lambda: F.size("images") > 0)
paragraphs = shared(lambda: F.transform(F.filter("text_blocks", lambda b: b["tag"] == "p"), lambda b: b["text"]))


@shared
def body_paragraphs(any_block: bool = False) -> Column:
    """Paragraphs; else, where wanted, any text block; else the whole body."""
    p = paragraphs()
    whole = F.filter(F.array(F.trim(text("body_text"))), lambda x: x != "")
    blocks = F.transform("text_blocks", lambda b: b["text"])
    return F.when(F.size(p) > 0, p).when(F.lit(any_block) & (F.size(blocks) > 0), blocks).otherwise(whole)


@shared
def content_paragraphs() -> Column:
    """Paragraphs that are no breadcrumbs, forms or examples."""
    return F.filter(body_paragraphs(True), lambda p: (F.regexp_count(p, F.lit(r"[>»›·∙•|/]")) < 2) & ~p.rlike(f"(?i){P.EXAMPLE}|{P.FORM}"))


def is_question(h: Column) -> Column:
    return h.rlike(P.QUESTION_END) | (h.rlike(P.QUESTION_WORD) & h.rlike(P.QUESTION_TAIL))


def escaped(x: Column) -> Column:
    return F.regexp_replace(x, r"([\\.*+?^${}()|\[\]])", r"\\$1")


def squashed(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def word_in(token: Column, where: Column) -> Column:
    """Latin words at word boundaries, others anywhere."""
    return F.when(token.rlike("^[a-z0-9]+$"), F.regexp_like(where, F.concat(F.lit(r"\b"), token, F.lit(r"\b")))).otherwise(F.contains(where, token))


def keyword_in(keyword: Column, where: Column) -> Column:
    k, w = squashed(keyword), squashed(where)
    return (k != "") & (w != "") & F.forall(F.split(k, " "), lambda t: word_in(t, w))


def bounded(needle: Column, where: Column, places: bool = False) -> Column:
    """needle not inside a longer word; a Korean particle, or a place suffix
    where allowed, may follow."""
    tail = f"(?:{P.PLACE_SUFFIX}|{P.PARTICLE})" if places else f"(?:{P.PARTICLE})"
    n = F.lower(F.trim(needle))
    pattern = F.concat(F.lit(r"(?<![가-힣a-z0-9])"), escaped(n), F.lit(rf"(?:(?![가-힣a-z0-9])|{tail})"))
    return (n != "") & F.regexp_like(F.lower(where), pattern)


def spaced(needle: Column) -> Column:
    """A pattern of needle's characters with any white space between them."""
    return F.array_join(F.transform(F.split(F.regexp_replace(F.lower(needle), r"\s+", ""), ""), escaped), r"\s*")


def name_variants(name: Column) -> Column:
    n = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    return F.array_distinct(F.filter(F.array(n, F.regexp_replace(n, " ", ""), F.lower(n), F.regexp_replace(n, "[^가-힣0-9]", ""), F.regexp_replace(F.lower(n), "[^a-z0-9]", "")), lambda v: v != ""))


@shared
def named_in(name: str) -> Column:
    """Whether the business's name, in some variant, is in a text column or,
    without a name, in the search text."""
    where = text(name) if name else search_text()
    n = text("business_name")
    loose = F.when(F.length(F.regexp_replace(n, r"\s+", "")) >= 2, n.rlike("[가-힣]") & F.regexp_like(F.lower(where), F.concat(F.lit(r"(?<![가-힣a-z0-9])"), spaced(n), F.lit(rf"(?:(?![가-힣a-z0-9])|(?:{P.PARTICLE}))")))).otherwise(F.lit(False))
    return filled(n) & (F.exists(name_variants(n), lambda v: bounded(v, where)) | F.coalesce(loose, F.lit(False)))


@shared
def search_text() -> Column:
    return F.concat_ws(" ", "title", "description", "h1", F.array_join(listed("h2"), " "), F.substring(text("body_text"), 1, 2000))


def region_in(where: Column) -> Column:
    r, t = squashed(text("region")), squashed(where)
    korean = F.regexp_like(t, F.concat(escaped(r), F.lit(rf"(?:(?![가-힣])|(?:{P.REGION_SUFFIX}))")))
    return (r != "") & F.when(r.rlike("^[a-z0-9 ]+$"), keyword_in(r, t)).otherwise(korean)


def area_fits(area: Column) -> Column:
    """Whether a phone's area code agrees with the region; unknown ones do."""
    code = F.when(area.startswith("02"), F.lit("02")).otherwise(F.substring(area, 1, 3))
    table = F.create_map(*(x for k, v in P.AREA_CODES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    places, r = F.try_element_at(table, code), F.trim(text("region"))
    return (r == "") | area.isin(P.MOBILE) | area.rlike(r"^1[5-9]\d{2}$") | F.coalesce(~F.exists(places, lambda x: x.isNotNull()) | F.exists(places, lambda x: F.contains(r, x) | F.contains(x, r)), F.lit(True))


trusted_phone = shared(lambda: F.exists("phones", lambda p: area_fits(p["area"])))
contact = shared(lambda kind: F.exists("contact_links", lambda x: x["kind"] == kind))
any_link = shared(lambda: F.concat(listed("internal_links"), listed("external_links")))
channel_link = shared(lambda: F.exists(listed("external_links"), lambda x: x.rlike(P.CHANNEL_LINK)))
heads = shared(lambda: F.concat(listed("h2"), listed("h3")))
lang_base = lambda x: F.element_at(F.split(F.lower(F.trim(x)), "[-_]"), 1)


@shared
def slice_tail(array: str) -> Column:
    return F.when(F.size(array) > 1, F.slice(array, F.lit(2), F.greatest(F.size(array) - 1, F.lit(1)))).otherwise(F.slice(array, 1, 0))


@shared
def no_jump() -> Column:
    pairs = F.zip_with("headings", slice_tail("headings"), lambda a, b: F.coalesce(b["level"] > a["level"] + 1, F.lit(False)))
    return ~F.exists(pairs, lambda x: x)


def worthy_source(u: Column) -> Column:
    h, hosts = urls.host(u), "|".join(x.replace(".", r"\.") for x in P.SOURCE_HOSTS)
    return ~u.rlike(P.NOT_A_SOURCE) & (h.rlike(rf"(^|\.)({hosts})$") | h.rlike(P.SOURCE_HOST_PART) | urls.path(u).rlike(P.SOURCE_PATH))


@shared
def distinct_matches(pattern: str) -> Column:
    return F.size(F.array_distinct(F.transform(F.regexp_extract_all(text("body_text"), F.lit(pattern), F.lit(0)), lambda x: F.regexp_replace(F.lower(x), r"\s+", ""))))


def positions(needle: Column, where: Column) -> Column:
    """Starts of needle in where, from the lengths of the parts between."""
    parts = F.split(where, F.concat(F.lit(r"\Q"), needle, F.lit(r"\E")), -1)
    step = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    done = F.aggregate(parts, step, lambda acc, p: F.struct((acc["at"] + F.length(p) + F.length(needle)).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(p))).alias("out")), lambda acc: acc["out"])
    return F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))


def service_shown(s: Column) -> Column:
    low = F.lower(s)
    around = F.regexp_extract_all(F.lower(text("body_text")), F.concat(F.lit(r"(?s).{0,30}"), escaped(low), F.lit(r".{0,30}")), F.lit(0))
    schema = F.exists(c("facts.services"), lambda n: F.contains(F.lower(n), low) | F.contains(low, F.lower(n)))
    form = r"입력(?:해|하|란|칸|please)?|검색어?|을 입력|를 입력|제목|작성자|글쓰기|게시판|댓글|답변하기|로그인|회원가입|아이디|비밀번호|이름\s*[:：]|문의\s*제목"
    return F.coalesce(schema, F.lit(False)) | F.exists("headings", lambda h: F.contains(F.lower(h["text"]), low)) | F.exists(around, lambda w: ~w.rlike(form))


def local_service() -> Column:
    where = F.lower(F.concat_ws(" ", text("title"), text("description"), F.substring(text("body_text"), 1, 3000)))
    regions = positions(F.lower(text("region")), where)
    near = F.exists(listed("main_services"), lambda s: F.exists(positions(F.lower(s), where), lambda a: F.exists(regions, lambda b: F.abs(a - b) <= 200)))
    return F.when(~filled(c("region")) | (F.size(listed("main_services")) == 0), F.lit(False)).otherwise(near)


@shared
def structural_answers() -> Column:
    """Question headings that something other than a question follows."""
    pairs = F.zip_with("headings", slice_tail("headings"), lambda a, b: is_question(a["text"]) & F.when(b["text"].isNull(), F.exists("sentences", lambda s: F.length(s) >= 40)).otherwise(~is_question(b["text"]) | (b["level"] > a["level"])))
    return F.size(F.filter(pairs, lambda x: x))


@shared
def brand_mentions() -> Column:
    """Distinct places at which the name stands as a word."""
    body = F.lower(text("body_text"))
    longest = F.filter(name_variants(c("business_name")), lambda v: F.length(v) > 0)
    any_of = F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform(longest, F.lower)), lambda a, b: F.length(b) - F.length(a)), escaped), "|")
    return F.when(F.size(longest) == 0, F.lit(0)).otherwise(F.regexp_count(body, F.concat(F.lit(r"(?<![가-힣a-z0-9])(?:"), any_of, F.lit(rf")(?![a-z0-9])(?![가-힣&&[^{P.MENTION_PARTICLE}]])"))))


@shared
def other_language() -> Column:
    tags = F.filter("link_tags", lambda x: F.contains(F.coalesce(x["rel"], F.lit("")), F.lit("alternate")) & filled(x["hreflang"]) & (F.lower(x["hreflang"]) != "x-default"))
    langs = F.array_distinct(F.transform(tags, lambda x: lang_base(x["hreflang"])))
    own = F.coalesce(lang_base(c("html_lang")), F.lit(""))
    return (F.size(langs) >= 2) | ((F.size(langs) >= 1) & ((own == "") | ~F.array_contains(langs, own)))


@shared
def rel_links(pattern: str) -> Column:
    return F.filter("link_tags", lambda x: F.coalesce(x["rel"], F.lit("")).rlike(pattern))


hreflang = shared(lambda: F.filter("link_tags", lambda x: filled(x["hreflang"])))
paging = shared(lambda: rel_links(r"(^|\s)(prev|next)(\s|$)"))
slash_known = lambda: c("paths") >= 2
number_kinds = ["number_percent", "number_period", "number_money", "number_count", "number_time", "number_career"]
dated = shared(lambda: filled(c("last_modified")))


def a11y(*names: str) -> Callable[[], Column]:
    return lambda: F.coalesce(~F.arrays_overlap("a11y", F.array(*map(F.lit, names))), F.lit(True))


PROVIDED = frozenset(f"BACKLINK-{x}-001" for x in ("DA", "HTTPS", "CANONICAL-CONSISTENCY", "STRUCTURED-DATA-DIVERSITY", "SOCIAL-META"))


def measured(struct: str, check: Callable[[], Column]) -> Callable[[], Column]:
    """A rule on what a provider measured passes where nothing was measured."""
    return lambda: c(struct).isNull() | F.coalesce(check(), F.lit(False))


def R(rule_id, sev, weight, action, difficulty, impact, passed, score=None, sev_when=None) -> RuleSpec:
    struct = {"PERF": "perf", "NLP": "nlp"}.get(rule_id.split("-")[0]) or ("backlink" if rule_id in PROVIDED else None)
    if struct and score is None:
        score = unless(lambda: c(struct).isNotNull(), "unavailable")
    return RuleSpec(rule_id, SEVERITY[sev], weight, ACTION[action], difficulty, impact, passed, score, sev_when)


_alt = shared(lambda: share("images", lambda x: filled(x["alt"])))
_lang_pair = lambda: (filled(c("html_lang")), filled(meta("content-language")))
_lists = shared(lambda: F.coalesce(c("ul"), F.lit(0)) + F.coalesce(c("ol"), F.lit(0)))
_mean_sentences = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + F.size(F.filter(F.split(x, r"[.!?。]+(\s+|$)"), lambda s: F.trim(s) != ""))) / F.size(p)
_long = shared(lambda n: F.filter(body_paragraphs(), lambda p: F.length(p) >= n))
_first = shared(lambda: F.try_element_at(F.filter(content_paragraphs(), lambda p: F.length(p) >= 30), F.lit(1)))
_mid = shared(lambda: F.filter(content_paragraphs(), lambda p: F.length(p).between(50, 200)))
_ordinals = shared(lambda: (distinct_matches(r"\b([1-9]|[1-9][0-9])\s*단계") >= 2) | (distinct_matches(r"(?i)\bstep\s*0?([1-9])") >= 2) | (distinct_matches("[①②③④⑤⑥⑦⑧⑨⑩]") >= 2) | (distinct_matches(r"(?:^|\s)([1-9])[.)]\s") >= 2) | (F.size(F.filter("headings", lambda h: h["text"].rlike(r"(?i)\b[1-9]\s*단계|step\s*[1-9]|[①②③④⑤]"))) >= 2))
_schema_named = shared(lambda kind: F.exists(c(f"facts.{kind}"), lambda n: F.exists(name_variants(n), lambda w: F.exists(name_variants(c("business_name")), lambda v: F.contains(w, v) | F.contains(v, w)))))
_phone_ok = shared(lambda: fact("telephone") | trusted_phone() | contact("tel"))
_address_ok = shared(lambda: fact("address") | (F.size("addresses") > 0))
_industry = shared(lambda: F.array_distinct(F.filter(F.concat(F.array(text("industry"), F.lower(F.trim(text("industry"))), F.regexp_replace(F.lower(F.trim(text("industry"))), r"[\s_-]+", "")), F.coalesce(F.try_element_at(F.create_map(*(x for k, v in P.INDUSTRY_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.regexp_replace(F.lower(F.trim(text("industry"))), r"[\s_-]+", "")), F.array().cast(_STRINGS))), filled)))
_conflict = shared(lambda: ((F.size("phones") > 0) & ~trusted_phone() & ~fact("telephone") & filled(c("region"))) | (filled(c("business_name")) & (F.size("facts.names") > 0) & ~F.coalesce(F.exists("facts.names", lambda n: F.exists(name_variants(c("business_name")), lambda v: bounded(v, n))), F.lit(False))))
_hours = shared(lambda: c("valid_hours") | text("body_text").rlike(P.DAY_DETAIL))

RULES: list[RuleSpec] = [
    R("SEO-TITLE-001", "H", 10, "vendor", "easy", "high", lambda: filled(c("title"))),
    R("SEO-TITLE-002", "M", 6, "vendor", "easy", "medium", lambda: F.length(F.trim(text("title"))).between(10, 60)),
    R("SEO-META-001", "H", 10, "vendor", "easy", "high", lambda: filled(c("description"))),
    R("SEO-META-002", "M", 6, "vendor", "easy", "medium", lambda: F.length(text("description")).between(50, 160)),
    R("SEO-H1-001", "H", 10, "vendor", "easy", "high", lambda: filled(c("h1"))),
    R("SEO-H1-002", "M", 6, "vendor", "easy", "medium", lambda: F.size(F.filter("headings", lambda h: h["level"] == 1)) <= 1),
    R("SEO-H2-001", "L", 3, "vendor", "easy", "low", lambda: F.size(listed("h2")) > 0),
    R("SEO-IMG-ALT-001", "M", 6, "vendor", "easy", "medium", lambda: ~has_images() | (_alt() >= 0.7), unless(has_images, "not_applicable")),
    R("SEO-CANONICAL-001", "L", 3, "vendor", "easy", "low", lambda: filled(c("canonical_url"))),
    R("SEO-ROBOTS-001", "H", 10, "vendor", "medium", "high", lambda: ~F.contains(F.lower(text("robots_meta")), F.lit("noindex"))),
    R("SEO-SITEMAP-001", "L", 3, "vendor", "medium", "low", lambda: F.coalesce("sitemap_used", F.lit(False)) | F.coalesce("sitemap_link", F.lit(False))),
    R("SEO-MOBILE-001", "H", 10, "vendor", "easy", "high", lambda: F.map_contains_key("meta", "viewport")),
    R("SEO-URL-001", "L", 3, "si", "hard", "low", lambda: (urls.path_depth(c("url")) <= 3) & ~c("url").rlike(r"[?&]id=\d+")),
    R("SEO-KEYWORD-001", "H", 10, "self", "easy", "high", lambda: (F.size(listed("target_keywords")) == 0) | F.exists(listed("target_keywords"), lambda k: keyword_in(k, text("title")) | keyword_in(k, text("h1")) | keyword_in(k, text("description"))), unless(lambda: F.size(listed("target_keywords")) > 0, "not_applicable")),
    R("SEO-INTERNAL-LINK-001", "M", 6, "vendor", "easy", "medium", lambda: F.size(listed("internal_links")) >= 3),
    R("SEO-CTA-001", "M", 6, "self", "easy", "medium", lambda: signal("cta") | (F.size("contact_links") > 0) | F.exists(listed("external_links"), lambda x: x.rlike(P.CTA_LINK))),
    R("SEO-REGION-001", "M", 6, "self", "easy", "medium", lambda: region_in(search_text())),
    R("SEO-HTTPS-001", "H", 10, "vendor", "medium", "high", lambda: c("url").startswith("https://")),
    R("SEO-LANG-001", "M", 6, "vendor", "easy", "medium", lambda: filled(c("html_lang")) | filled(meta("language")) | filled(meta("lang"))),
    R("SEO-OG-001", "M", 6, "vendor", "easy", "medium", lambda: sum(x.cast("int") for x in (*(filled(meta(k)) & ~F.lower(F.trim(F.coalesce(meta(k), F.lit("")))).isin(P.OG_PLACEHOLDERS) for k in ("og:title", "og:description")), filled(meta("og:image")), filled(meta("og:url")))) >= 3),
    R("SEO-OG-002", "L", 3, "vendor", "easy", "low", lambda: filled(meta("og:locale"))),
    R("SEO-TWITTER-001", "L", 3, "vendor", "easy", "low", lambda: filled(meta("twitter:card"))),
    R("SEO-FAVICON-001", "L", 3, "vendor", "easy", "low", true, unless(lambda: F.exists(F.map_keys("meta"), lambda k: k.rlike("icon|msapplication-tileimage")), "unavailable")),
    R("SEO-IMG-LAZY-001", "L", 3, "vendor", "easy", "low", lambda: (F.size("images") <= 2) | (share("images", lambda x: x["loading"] == "lazy") >= 0.5), unless(has_images, "not_applicable")),
    R("SEO-IMG-DIMENSIONS-001", "L", 3, "vendor", "easy", "low", lambda: ~has_images() | (share("images", lambda x: filled(x["width"]) & filled(x["height"])) >= 0.5), unless(has_images, "not_applicable")),
    R("SEO-IMG-FORMAT-001", "L", 3, "vendor", "medium", "low", lambda: ~has_images() | F.exists("images", lambda x: x["src"].rlike(r"(?i)\.(webp|avif)([?#]|$)")), unless(has_images, "not_applicable")),
    R("SEO-LINK-NEWTAB-001", "M", 6, "vendor", "easy", "medium", true, always("unavailable")),
    R("SEO-STRUCTURED-DATA-001", "H", 10, "snippet", "medium", "high", lambda: c("facts.nodes") >= 1),
    R("SEO-BREADCRUMB-001", "L", 3, "snippet", "medium", "low", lambda: F.exists("facts.types", lambda t: F.contains(t, F.lit("BreadcrumbList")))),
    R("SEO-WORD-COUNT-001", "M", 6, "self", "medium", "medium", lambda: (F.length(F.regexp_replace(text("body_text"), r"\s", "")) >= 300) | (c("word_count") >= 200)),
    R("SEO-KOREAN-URL-001", "L", 3, "si", "hard", "low", lambda: ~urls.path(c("url")).rlike("[가-힣]")),
    R("SEO-HREFLANG-001", "L", 3, "vendor", "hard", "low", lambda: ~F.exists(hreflang(), lambda x: ~filled(x["href"])), unless(lambda: F.size(hreflang()) > 0, "not_applicable")),
    R("SEO-PAGE-DEPTH-001", "L", 3, "si", "hard", "low", lambda: c("deepest") <= 3),
    R("SEO-NAVER-META-001", "M", 6, "self", "easy", "medium", lambda: filled(meta("naver-site-verification"))),
    R("SEO-DUPLICATE-CONTENT-001", "M", 6, "vendor", "medium", "medium", lambda: c("urls") == c("pages")),
    R("SEO-EXTERNAL-LINK-COUNT-001", "L", 3, "self", "easy", "low", lambda: F.size(listed("external_links")) <= 20),
    R("SEO-HTTP2-001", "L", 3, "vendor", "medium", "low", lambda: F.coalesce(c("http_protocol").isin("2", "3"), F.lit(True)), unless(lambda: c("http_protocol").isNotNull(), "unavailable")),
    R("SEO-PAGE-LANG-CONSISTENCY-001", "M", 6, "vendor", "medium", "medium", lambda: F.when(_lang_pair()[0] & _lang_pair()[1], lang_base(c("html_lang")) == lang_base(meta("content-language"))).when(_lang_pair()[0] | _lang_pair()[1], lang_base(F.when(_lang_pair()[0], c("html_lang")).otherwise(meta("content-language"))) == "ko").otherwise(F.lit(True)), unless(lambda: _lang_pair()[0] | _lang_pair()[1], "unavailable"), lambda: F.when(_lang_pair()[0] != _lang_pair()[1], "low").otherwise("medium")),
    R("SEO-AMP-VALID-001", "L", 3, "vendor", "medium", "low", true, always("unavailable")),
    R("SEO-XML-SITEMAP-VALID-001", "M", 6, "vendor", "medium", "medium", lambda: F.coalesce("sitemap_used", F.lit(False)) | F.coalesce("sitemap_link", F.lit(False))),
    R("SEO-PAGINATION-001", "L", 3, "vendor", "medium", "low", lambda: ~F.exists(paging(), lambda x: ~filled(x["href"])), unless(lambda: F.size(paging()) > 0, "not_applicable")),
    R("SEO-CONTENT-FRESHNESS-001", "M", 6, "vendor", "medium", "medium", lambda: dated() | F.exists(F.map_keys("meta"), lambda k: k.isin("article:published_time", "article:modified_time", "og:updated_time", "last-modified", "date"))),
    R("SEO-DUPLICATE-META-DESC-001", "M", 6, "self", "easy", "medium", lambda: (c("descriptions") < 2) | (c("descriptions") == c("distinct_descriptions")), unless(lambda: c("descriptions") >= 2, "not_applicable")),
    R("SEO-HEADING-HIERARCHY-001", "M", 6, "vendor", "medium", "medium", no_jump, unless(lambda: F.size("headings") > 0, "unavailable")),
    R("SEO-TRAILING-SLASH-001", "L", 3, "vendor", "medium", "low", lambda: ~slash_known() | (c("slashed") == 0) | (c("slashed") == c("paths")), unless(slash_known, "not_applicable")),
    R("SEO-CANONICAL-SELF-001", "M", 6, "vendor", "easy", "medium", lambda: F.coalesce(urls.same_page(c("canonical_url"), c("url")), F.lit(False))),
    R("SEO-BROKEN-LINK-001", "H", 10, "vendor", "medium", "high", lambda: ~F.coalesce("broken", F.lit(False))),
    R("SEO-REDIRECT-CHAIN-001", "M", 6, "vendor", "medium", "medium", lambda: F.coalesce(c("redirect_chain_length") <= 2, F.lit(True)), unless(lambda: c("redirect_chain_length").isNotNull(), "unavailable")),
    R("AEO-FAQ-001", "H", 10, "snippet", "medium", "high", lambda: c("has_faq")),
    R("AEO-FAQ-SCHEMA-001", "M", 6, "snippet", "medium", "medium", lambda: fact("faq")),
    R("AEO-QUESTION-FORMAT-001", "M", 6, "self", "easy", "medium", lambda: F.exists(heads(), is_question)),
    R("AEO-SERVICE-DESC-001", "H", 10, "self", "easy", "high", lambda: F.size(F.filter(listed("main_services"), service_shown)) >= F.ceil(F.size(listed("main_services")) * 0.5)),
    R("AEO-PRICE-INFO-001", "M", 6, "self", "easy", "medium", lambda: fact("price") | signal("price", "free_or_paid")),
    R("AEO-PROCESS-INFO-001", "M", 6, "self", "easy", "medium", lambda: fact("howto") | (c("ol") >= 1) | _ordinals()),
    R("AEO-DURATION-INFO-001", "L", 3, "self", "easy", "low", lambda: signal("duration", "duration_days", "immediate")),
    R("AEO-TARGET-CUSTOMER-001", "M", 6, "self", "easy", "medium", lambda: text("body_text").rlike(rf"[가-힣A-Za-z]{{2,}}(?:을|를)\s*위한|(?:수강|이용|모집|교육|상담|체험|참여)?\s*대상\s*(?:[:：]|은|이|층)|(?:{P.AUDIENCE})(?:도|를|을|은|는|께서|분들|님)?\s*(?:쉽게|환영|가능|추천|위해|맞춤|특화|전용|대상)")),
    R("AEO-DIRECT-ANSWER-001", "M", 6, "self", "medium", "medium", lambda: (F.size(content_paragraphs()) > 0) & (F.size(F.filter(_mid(), lambda p: F.exists(F.split(p, r"[.!?。]+(\s+|$)"), lambda s: F.length(F.trim(s)) >= 20))) / F.greatest(F.size(content_paragraphs()), F.lit(1)) >= 0.3)),
    R("AEO-LOCAL-SERVICE-001", "M", 6, "self", "easy", "medium", local_service),
    R("AEO-ANSWER-LENGTH-001", "M", 6, "self", "easy", "medium", lambda: F.size(F.filter("sentences", lambda s: F.length(s) >= 40)) >= 3),
    R("AEO-DEFINITION-001", "L", 3, "self", "easy", "low", lambda: text("body_text").rlike(P.DEFINITION)),
    R("AEO-PARAGRAPH-STRUCTURE-001", "M", 6, "self", "easy", "medium", lambda: F.size(F.filter(body_paragraphs(True), lambda p: F.length(p) >= 30)) >= 3),
    R("AEO-AUTHOR-SCHEMA-001", "L", 3, "self", "easy", "low", lambda: fact("author") | fact("person") | signal("expert")),
    R("AEO-LIST-FORMAT-001", "L", 3, "self", "easy", "low", lambda: _lists() >= 1),
    R("AEO-DATE-RECENT-001", "L", 3, "self", "easy", "low", lambda: fact("dated") | dated() | signal("recent_year")),
    R("AEO-CONTACT-DIRECT-001", "M", 6, "self", "easy", "medium", lambda: _phone_ok() | contact("mailto") | channel_link() | signal("channel_aeo")),
    R("AEO-TESTIMONIAL-001", "L", 3, "self", "easy", "low", lambda: fact("review") | signal("testimonial")),
    R("AEO-QA-PAIR-MARKUP-001", "M", 6, "self", "easy", "medium", lambda: c("facts.faq_pairs") + structural_answers() >= 1),
    R("AEO-ORG-ANSWER-001", "L", 3, "self", "easy", "low", lambda: F.coalesce(_schema_named("organization_names"), F.lit(False)) | signal("first_person")),
    R("AEO-DIRECT-ANSWER-PARAGRAPH-001", "M", 6, "self", "medium", "medium", lambda: F.coalesce(F.length(_first()).between(40, 200) & _first().rlike(P.DEFINING), F.lit(False))),
    R("AEO-LIST-AND-TABLE-001", "M", 6, "vendor", "easy", "medium", lambda: _lists() + F.coalesce("tables", F.lit(0)) >= 1),
    R("AEO-SCANNABLE-001", "L", 3, "self", "easy", "low", lambda: (F.size(_long(30)) > 0) & F.coalesce(_mean_sentences(_long(30)) <= 4, F.lit(False))),
    R("AEO-NUMERIC-FACTS-001", "M", 6, "self", "easy", "medium", lambda: F.size(F.array_intersect("signals", F.array(*map(F.lit, number_kinds)))) >= 2),
    R("AEO-AUTHOR-ATTRIBUTION-001", "M", 6, "self", "easy", "medium", lambda: fact("author") | fact("person") | signal("author_text")),
    R("AEO-LAST-UPDATED-001", "M", 6, "self", "easy", "medium", lambda: fact("modified") | dated() | signal("updated_on")),
    R("AEO-CITATION-001", "L", 3, "self", "easy", "low", lambda: text("body_text").rlike(P.CITATION_TEXT) | F.exists(listed("external_links"), worthy_source)),
    R("AEO-PUBLISHER-INFO-001", "M", 6, "self", "easy", "medium", lambda: fact("publisher") | fact("organization") | signal("publisher_text")),
    R("AEO-FAQ-COUNT-001", "L", 3, "self", "easy", "low", lambda: F.when(c("facts.faq_entities") > 0, c("facts.faq_entities")).otherwise(F.size(F.filter(heads(), is_question))) >= 5),
    R("AEO-HEADING-QUESTION-RATIO-001", "M", 6, "self", "easy", "medium", lambda: (F.size(heads()) > 0) & (F.size(F.filter(heads(), lambda h: is_question(h) & ~h.rlike(P.RHETORICAL))) / F.greatest(F.size(heads()), F.lit(1)) >= 0.3)),
    R("GEO-BUSINESS-NAME-001", "H", 10, "self", "easy", "high", lambda: named_in("")),
    R("GEO-INDUSTRY-001", "H", 10, "self", "easy", "high", lambda: F.exists(_industry(), lambda v: bounded(v, search_text()))),
    R("GEO-REGION-001", "H", 10, "self", "easy", "high", lambda: filled(c("region")) & bounded(text("region"), search_text(), True)),
    R("GEO-SERVICE-001", "M", 6, "si", "hard", "medium", lambda: c("pages") >= F.size(listed("main_services")) + 1),
    R("GEO-TRUST-001", "H", 10, "self", "easy", "high", lambda: signal("registration").cast("int") + (fact("telephone") | trusted_phone()).cast("int") + _address_ok().cast("int") >= 2),
    R("GEO-LOCAL-BUSINESS-SCHEMA-001", "H", 10, "snippet", "medium", "high", lambda: fact("local_business")),
    R("GEO-ORGANIZATION-SCHEMA-001", "M", 6, "snippet", "medium", "medium", lambda: fact("organization")),
    R("GEO-LLMS-TXT-001", "L", 2, "snippet", "medium", "low", lambda: F.exists(any_link(), lambda x: x.rlike(r"(?i)/llms\.txt([?#]|$)"))),
    R("GEO-AI-SUMMARY-001", "M", 6, "self", "medium", "medium", lambda: (F.size(_long(20)) > 0) & F.coalesce((F.aggregate(_long(20), F.lit(0.0), lambda a, p: a + F.length(p)) / F.size(_long(20))).between(50, 300), F.lit(False))),
    R("GEO-SOCIAL-PROOF-001", "L", 3, "self", "easy", "low", lambda: fact("rating") | signal("proof")),
    R("GEO-CONTACT-001", "H", 10, "self", "easy", "high", lambda: _phone_ok() | (c("emails") > 0) | contact("mailto") | channel_link() | text("body_text").rlike(r"카카오\s*채널|카카오톡|카톡|채널 추가|플러스친구|네이버\s*톡톡|라인\s*추가|인스타\s*DM|텔레그램")),
    R("GEO-OPENING-HOURS-001", "M", 6, "self", "easy", "medium", lambda: fact("hours") | signal("hours_text")),
    R("GEO-PHONE-001", "H", 10, "self", "easy", "high", _phone_ok),
    R("GEO-ADDRESS-001", "H", 10, "self", "easy", "high", _address_ok),
    R("GEO-BRAND-MENTION-001", "L", 3, "self", "easy", "low", lambda: brand_mentions() >= 3),
    R("GEO-OG-IMAGE-001", "M", 6, "vendor", "easy", "medium", lambda: filled(meta("og:image"))),
    R("GEO-NAP-CONSISTENCY-001", "M", 6, "self", "easy", "medium", lambda: (named_in("body_text") | F.coalesce(F.exists("facts.names", lambda n: F.exists(name_variants(c("business_name")), lambda v: bounded(v, n))), F.lit(False))) & _phone_ok() & _address_ok() & ~_conflict()),
    R("GEO-LOCATION-SCHEMA-001", "M", 6, "snippet", "medium", "medium", lambda: fact("place")),
    R("GEO-MULTIPLE-LANG-001", "L", 3, "self", "medium", "low", lambda: ~text("industry").rlike(P.TOURISM) | other_language()),
    R("GEO-BRAND-IN-TITLE-001", "H", 10, "self", "easy", "high", lambda: named_in("title")),
    R("GEO-BRAND-IN-H1-001", "H", 10, "self", "easy", "high", lambda: named_in("h1")),
    R("GEO-BRAND-CONSISTENCY-001", "M", 6, "self", "easy", "medium", lambda: sum(named_in(x).cast("int") for x in ("title", "h1", "description", "body_text")) >= 3),
    R("GEO-MAP-EMBED-001", "L", 3, "vendor", "easy", "low", lambda: fact("map") | F.exists(any_link(), lambda x: F.lower(x).rlike("|".join(m.replace(".", r"\.") for m in P.MAP_LINKS)))),
    R("GEO-DIRECTIONS-INFO-001", "L", 3, "self", "easy", "low", lambda: text("body_text").rlike(r"찾아오시는 길|오시는 길|교통편|교통 안내|지하철|버스|역에서|출구|도보\s*\d+분|차로\s*\d+분") | signal("directions_weak")),
    R("GEO-BUSINESS-HOURS-DETAIL-001", "M", 6, "self", "easy", "medium", lambda: ~_hours() | text("body_text").rlike(P.DAY_DETAIL), unless(_hours, "unavailable")),
    R("GEO-PHONE-FORMAT-001", "L", 3, "vendor", "easy", "low", lambda: contact("tel") | (F.size("phones") == 0), unless(lambda: contact("tel") | (F.size("phones") > 0), "unavailable")),
    R("GEO-REVIEW-AGGREGATE-001", "M", 6, "snippet", "medium", "medium", lambda: fact("rating") | signal("rating")),
    R("NLP-KEYWORD-DENSITY-001", "M", 6, "self", "easy", "medium", measured("nlp", lambda: (F.size("nlp.densities") <= 0) | (F.size(F.filter("nlp.densities", lambda d: d.between(0.01, 0.03))) >= F.ceil(F.size("nlp.densities") * 0.5)))),
    R("NLP-TOPIC-RELEVANCE-001", "M", 6, "self", "easy", "medium", measured("nlp", lambda: sum((filled(c(x)) & F.contains(F.lower(F.array_join("nlp.topics", " ")), F.lower(F.trim(text(x))))).cast("int") for x in ("industry", "region")) > 0)),
    R("NLP-READABILITY-001", "M", 6, "self", "medium", "medium", measured("nlp", lambda: c("nlp.readability") >= 60)),
    R("NLP-SENTENCE-LENGTH-001", "L", 3, "self", "easy", "low", measured("nlp", lambda: (c("nlp.avg_sentence") > 0) & (c("nlp.avg_sentence") <= 25))),
    R("NLP-EEAT-AUTHOR-001", "M", 6, "snippet", "easy", "medium", measured("nlp", lambda: c("nlp.has_author"))),
    R("NLP-EEAT-EXPERTISE-001", "M", 6, "self", "easy", "medium", measured("nlp", lambda: c("nlp.expertise") >= 2)),
    R("NLP-EEAT-TRUST-001", "M", 6, "self", "easy", "medium", measured("nlp", lambda: (c("nlp.trust") >= 2) | c("nlp.fresh"))),
    R("NLP-SEMANTIC-ALIGN-001", "M", 6, "self", "medium", "medium", measured("nlp", lambda: c("nlp.alignment") >= 0.5)),
    R("BACKLINK-DA-001", "H", 10, "self", "medium", "high", measured("backlink", lambda: c("backlink.domain_authority") >= 30)),
    R("BACKLINK-HTTPS-001", "H", 10, "vendor", "medium", "high", measured("backlink", lambda: c("backlink.https_enforced") & c("backlink.hsts"))),
    R("BACKLINK-CANONICAL-CONSISTENCY-001", "M", 6, "vendor", "easy", "medium", measured("backlink", lambda: c("backlink.canonical_consistent"))),
    R("BACKLINK-STRUCTURED-DATA-DIVERSITY-001", "M", 6, "snippet", "medium", "medium", measured("backlink", lambda: c("backlink.structured_data") >= 3)),
    R("BACKLINK-SOCIAL-META-001", "M", 6, "snippet", "easy", "medium", measured("backlink", lambda: c("backlink.social_meta") >= 5)),
    R("BACKLINK-INTERNAL-LINK-DEPTH-001", "M", 6, "vendor", "medium", "medium", lambda: (F.coalesce("link_depth", F.lit(0)) <= 3) & (F.coalesce("unreachable", F.lit(0)) == 0)),
    R("BACKLINK-LINK-EQUITY-001", "L", 3, "snippet", "easy", "low", lambda: F.size(listed("external_links")) <= 50),
    R("BACKLINK-AGE-SIGNAL-001", "L", 3, "self", "easy", "low", lambda: dated() | F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text("body_text"), F.lit(r"(?:©|\(c\)|copyright)\s*(?:\d{4}\s*[-–]\s*)?(\d{4})"), F.lit(1)), lambda y: y.try_cast("int"))) >= c("as_of_year") - 1, F.lit(False))),
    R("A11Y-COLOR-CONTRAST-001", "H", 10, "vendor", "medium", "high", a11y("color-contrast")),
    R("A11Y-IMAGE-ALT-001", "H", 10, "snippet", "easy", "high", a11y("image-alt")),
    R("A11Y-FORM-LABEL-001", "H", 10, "vendor", "easy", "high", a11y("label")),
    R("A11Y-BUTTON-NAME-001", "H", 10, "vendor", "easy", "high", a11y("input-button-name", "button-name")),
    R("A11Y-LINK-NAME-001", "H", 10, "vendor", "easy", "high", a11y("link-name")),
    R("A11Y-DOC-LANG-001", "M", 6, "snippet", "easy", "medium", a11y("html-has-lang", "html-lang-valid")),
    R("A11Y-DOC-TITLE-001", "M", 6, "vendor", "easy", "medium", a11y("document-title")),
    R("A11Y-HEADING-ORDER-001", "M", 6, "vendor", "medium", "medium", a11y("heading-order")),
    R("A11Y-LANDMARK-001", "M", 6, "vendor", "easy", "medium", a11y("landmark-one-main")),
    R("A11Y-FOCUS-VISIBLE-001", "M", 6, "vendor", "medium", "medium", a11y("focus-order-semantics")),
    R("A11Y-ARIA-VALID-001", "M", 6, "vendor", "medium", "medium", a11y("aria-allowed-attr", "aria-valid-attr", "aria-valid-attr-value")),
    R("A11Y-LIST-001", "L", 3, "snippet", "easy", "low", a11y("list")),
    R("A11Y-TABINDEX-001", "L", 3, "vendor", "easy", "low", a11y("tabindex")),
    R("A11Y-AUTOPLAY-001", "L", 3, "vendor", "easy", "low", a11y("autoplay", "audio-caption", "video-caption")),
    R("A11Y-FOCUS-ORDER-001", "L", 3, "vendor", "medium", "low", a11y("focusable-content", "focus-order-semantics")),
    R("PERF-LCP-001", "H", 10, "vendor", "medium", "high", measured("perf", lambda: c("perf.lcp") <= 2500)),
    R("PERF-LCP-002", "M", 6, "vendor", "hard", "medium", measured("perf", lambda: c("perf.lcp") <= 4000)),
    R("PERF-FID-001", "M", 6, "vendor", "hard", "medium", measured("perf", lambda: c("perf.fid") < 100)),
    R("PERF-CLS-001", "H", 10, "vendor", "medium", "high", measured("perf", lambda: c("perf.cls") <= 0.1)),
    R("PERF-CLS-002", "M", 6, "vendor", "hard", "medium", measured("perf", lambda: c("perf.cls") <= 0.25)),
    R("PERF-INP-001", "M", 6, "vendor", "medium", "medium", measured("perf", lambda: c("perf.inp").isNull() | (c("perf.inp") < 200))),
    R("PERF-TTFB-001", "M", 6, "si", "hard", "medium", measured("perf", lambda: c("perf.ttfb") < 800)),
    R("PERF-FCP-001", "M", 6, "vendor", "medium", "medium", measured("perf", lambda: c("perf.fcp") <= 1800)),
    R("PERF-PERF-SCORE-001", "H", 10, "vendor", "medium", "high", measured("perf", lambda: c("perf.performance") >= 70)),
    R("PERF-MOBILE-001", "M", 6, "vendor", "medium", "medium", measured("perf", lambda: (c("perf.strategy") != "mobile") | (c("perf.performance") >= 50))),
]


def evaluate(context: DataFrame, rules: list[RuleSpec] | None = None, as_of_year: int = 2026) -> DataFrame:
    """The long table of results: site_id, rule_pos and a rule's facts.

    Which rules to run is a list, so a caller can leave out whole categories.
    Rules look at one row each, so nothing is shuffled."""
    rules = RULES if rules is None else rules
    x = context.withColumn("as_of_year", F.lit(as_of_year))
    for name in ("link_depth", "unreachable"):
        if name not in x.columns:
            x = x.withColumn(name, F.lit(None).cast("long"))
    _built.set({})
    known = _ready.setdefault(id(context.sparkSession.sparkContext._gateway), {})
    rows = [F.struct(F.lit(pos).alias("rule_pos"), _outcome(r, known).alias("r")) for pos, r in enumerate(rules)]
    return x.select("site_id", F.inline(F.array(*rows))).select("site_id", "rule_pos", "r.*")


def _outcome(r: RuleSpec, known: dict[str, Column]) -> Column:
    """The result of a rule; one of the catalogue is built once."""
    if r not in RULES or r.rule_id not in known:
        built = F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), F.coalesce(r.passed(), F.lit(False)).alias("passed"),
            (r.severity_when() if r.severity_when else F.lit(r.severity)).alias("severity"), F.lit(r.weight).alias("rule_weight"),
            (r.score_impact() if r.score_impact else F.lit(None)).cast("string").alias("score_impact"), F.lit(r.action).alias("action_type"), F.lit(r.difficulty).alias("difficulty"), F.lit(r.impact).alias("expected_impact"),
        )
        if r not in RULES:
            return built
        known[r.rule_id] = built
    return known[r.rule_id]


def rule_table(spark: SparkSession) -> DataFrame:
    """The catalogue itself."""
    return spark.createDataFrame([(i, r.rule_id, r.category, r.severity, r.weight, r.action, r.difficulty, r.impact) for i, r in enumerate(RULES)], "rule_pos int, rule_id string, category string, severity string, rule_weight int, action_type string, difficulty string, expected_impact string")
