"""Recorded answers of measuring services as typed rows.

A payload is a row with the HTTP ``status`` and the ``body`` that came.  Bodies
are read as VARIANT, so a field of another kind is null and never fails a job.
Every function returns a row for each payload; ``problem`` is null for one that
could be read, else says why not: ``http_<status>``, ``no_payload``,
``not_json`` or ``incomplete``.  A null status counts as 200."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places that are no rivals, by words of their url or name, and
#: hosts of social networks.
MEDICAL = ["hospital", "clinic", "pharmacy", "의원", "병원", "약국", "치과", "한의원"]
SOCIAL = ["instagram.com", "facebook.com", "tiktok.com", "youtube.com", "twitter.com", "x.com"]
MAP_SEARCH = "https://map.naver.com/p/search/"
#: The audits of a speed measurement, and the names under which
#: services of link counts report them.
AUDITS = {"lcp": ["largest-contentful-paint"], "fid": ["max-potential-fid"], "cls": ["cumulative-layout-shift"], "inp": ["interaction-to-next-paint", "interactive"], "ttfb": ["server-response-time"], "fcp": ["first-contentful-paint"]}
LINK_COUNTS = {
    "moz": {"authority": ["domain_authority", "domainAuthority", "da"], "backlinks": ["external_links", "totalLinks", "links"], "domains": ["linking_root_domains", "root_domains_to_root_domain", "linkingRootDomains"]},
    "ahrefs": {"authority": ["domain_rating", "domainRating", "dr"], "backlinks": ["backlinks", "total_backlinks", "backlinksTotal"], "domains": ["referring_domains", "refdomains", "referringDomains", "referring_domains_count"]},
}
#: Levels of objects and lists in which a count is looked for.
DEPTH = 4


def _read(payloads: DataFrame) -> DataFrame:
    return payloads.withColumn("_doc", F.try_parse_json("body"))


def _problem(complete: Column | None = None) -> Column:
    out = F.when(F.col("status") >= 400, F.concat(F.lit("http_"), F.col("status"))).when(F.coalesce(F.trim("body"), F.lit("")) == "", "no_payload").when(F.col("_doc").isNull(), "not_json")
    return out if complete is None else out.when(~complete, "incomplete")


def _get(doc: Column | str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(doc) if isinstance(doc, str) else doc, path, kind)


def _is_number(x: Column) -> Column:
    return F.coalesce(F.schema_of_variant(x).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"), F.lit(False))


def _number(doc: Column | str, path: str) -> Column:
    """A JSON number; null for anything else."""
    x = _get(doc, path, "variant")
    return F.when(_is_number(x), F.try_variant_get(x, "$", "double"))


def _rounded(x: Column) -> Column:
    return F.floor(x + 0.5).cast("double")


def page_speed(payloads: DataFrame) -> DataFrame:
    """payloads: site_id, strategy, status, body.  The fields that the rules on
    speed look at: ``performance`` 0..100, times in whole milliseconds, layout
    shift as it is; a missing audit counts as 0.  For interaction the older audit
    stands in where the newer is missing."""
    audit = lambda names: F.coalesce(*(_number("_doc", f"$.lighthouseResult.audits['{n}'].numericValue") for n in names), F.lit(0.0))
    found = {k: audit(v) if k == "cls" else _rounded(audit(v)) for k, v in AUDITS.items()}
    score = _rounded(F.coalesce(_number("_doc", "$.lighthouseResult.categories.performance.score"), F.lit(0.0)) * 100)
    whole = _get("_doc", "$.lighthouseResult.audits", "map<string,variant>").isNotNull() & _get("_doc", "$.lighthouseResult.categories", "map<string,variant>").isNotNull()
    x = _read(payloads).withColumn("problem", _problem(whole))
    ok = F.col("problem").isNull()
    order = ["lcp", "fid", "cls", "inp", "ttfb", "fcp"]
    return x.select("site_id", "strategy", F.when(ok, score).alias("performance"), *(F.when(ok, found[k]).alias(k) for k in order), "problem")


def encoded(x: Column) -> Column:
    """x as a component of a url: unreserved marks stay, a blank is %20."""
    out = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def local_search(payloads: DataFrame, medical: bool = False) -> DataFrame:
    """payloads: query_id, self_domain, status, body of a local search.
    ``self_rank`` and ``rivals``, an array of (rank, name, url, snippet).

    Places are ranked as they stand, without those of MEDICAL (kept where medical
    is set) and SOCIAL; one whose url has self_domain is the site itself, the last
    of several counts.  A place without a link has its search on the map."""
    kind = "array<struct<title:string,link:string,description:string,address:string,roadAddress:string>>"
    bare = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", ""))
    gap = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))

    def place(p: Column) -> Column:
        name = bare(p["title"])
        where = F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(F.coalesce(p["roadAddress"], p["address"]), F.lit("")))
        return F.struct(name.alias("name"), F.coalesce(gap(p["link"]), F.concat(F.lit(MAP_SEARCH), encoded(where))).alias("url"), F.when(p["description"] != "", bare(p["description"])).alias("snippet"))

    def counts(p: Column) -> Column:
        both, url = F.lower(F.concat_ws(" ", p["url"], p["name"])), F.lower(p["url"])
        none = F.lit(False)
        for w in SOCIAL:
            none = none | url.contains(w)
        for w in [] if medical else MEDICAL:
            none = none | both.contains(w)
        return ~none

    x = _read(payloads).withColumn("_items", F.coalesce(_get("_doc", "$.items", kind), F.array().cast(kind)))
    x = x.withColumn("_kept", F.filter(F.transform("_items", place), counts)).withColumn("problem", _problem())
    ranked = F.transform("_kept", lambda p, i: F.struct((i + 1).alias("rank"), p["name"].alias("name"), p["url"].alias("url"), p["snippet"].alias("snippet")))
    own = lambda p: (F.coalesce(F.col("self_domain"), F.lit("")) != "") & F.contains(p["url"], F.coalesce(F.col("self_domain"), F.lit("")))
    x = x.withColumn("_ranked", F.when(F.col("problem").isNull(), ranked).otherwise(F.slice(ranked, 1, 0)))
    return x.select("query_id", F.array_max(F.transform(F.filter("_ranked", own), lambda p: p["rank"])).alias("self_rank"), F.filter("_ranked", lambda p: ~own(p)).alias("rivals"), "problem")


def find_number(doc: Column, names: list[str], depth: int = DEPTH) -> Column:
    """The first number under one of names: an object's own fields in the order
    of names, else the first that its fields (by name) or a list's items hold, so
    many levels down.  A string that is a number counts, a blank one as 0."""

    def own(v: Column, name: str) -> Column:
        x = F.try_variant_get(v, f"$['{name}']", "variant")
        text = F.try_variant_get(x, "$", "string")
        said = F.when(F.trim(text) == "", F.lit(0.0)).otherwise(F.trim(text).try_cast("double"))
        value = F.when(_is_number(x), F.try_variant_get(x, "$", "double")).when(F.schema_of_variant(x) == "STRING", said)
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)

    def find(v: Column, left: int) -> Column:
        here = [own(v, n) for n in names]
        if not left:
            return F.coalesce(*here)
        inner = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.map_values(F.try_variant_get(v, "$", "map<string,variant>")))
        below = F.filter(F.transform(inner, lambda c: find(c, left - 1)), lambda n: n.isNotNull())
        return F.coalesce(*here, F.try_element_at(below, F.lit(1)))

    return find(doc, depth)


def link_counts(payloads: DataFrame, service: str) -> DataFrame:
    """payloads: site_id, status, body of a service of LINK_COUNTS.
    ``authority`` 0..100, ``backlinks`` and ``domains``, whole and never below 0;
    what is not said counts as 0."""
    x = _read(payloads).withColumn("problem", _problem())
    count = lambda k: F.floor(F.coalesce(find_number(F.col("_doc"), LINK_COUNTS[service][k]), F.lit(0.0)) + 0.5).cast("long")
    value = {k: F.greatest(F.lit(0).cast("long"), count(k)) for k in ("authority", "backlinks", "domains")}
    value["authority"] = F.least(F.lit(100).cast("long"), value["authority"])
    return x.select("site_id", *(F.when(F.col("problem").isNull(), v).alias(k) for k, v in value.items()), "problem")


def _channel(payloads: DataFrame, value: Column) -> DataFrame:
    """text, value, status (complete, or failed where the payload can't be read)."""
    x = _read(payloads).withColumn("problem", _problem())
    return x.select("text", F.when(F.col("problem").isNull(), value).alias("value"), F.when(F.col("problem").isNull(), "complete").otherwise("failed").alias("status"), "problem")


def blog_documents(payloads: DataFrame) -> DataFrame:
    """payloads: text, status, body of a blog search.  How many documents it finds."""
    return _channel(payloads, _number("_doc", "$.total"))


def search_volume(payloads: DataFrame) -> DataFrame:
    """payloads: text, status, body of an advertiser's keyword tool.  Searches a
    month on both kinds of device of the entry that is the keyword (white space and
    case aside), else of the first; null without entries.  ``< 10`` is 10."""
    key = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    entries = F.coalesce(_get("_doc", "$.keywordList", "array<variant>"), F.array().cast("array<variant>"))
    same = F.filter(entries, lambda e: key(F.try_variant_get(e, "$.relKeyword", "string")) == key(F.col("text")))
    chosen = F.coalesce(F.try_element_at(same, F.lit(1)), F.try_element_at(entries, F.lit(1)))

    def count(name: str) -> Column:
        x = F.try_variant_get(chosen, f"$.{name}", "variant")
        digits = F.regexp_replace(F.try_variant_get(x, "$", "string"), "[^0-9]", "")
        return F.when(_is_number(x), F.try_variant_get(x, "$", "double")).when(digits != "", digits.try_cast("double")).otherwise(F.lit(0.0))

    return _channel(payloads, F.when(F.size(entries) > 0, count("monthlyPcQcCnt") + count("monthlyMobileQcCnt")))


def search_trend(payloads: DataFrame) -> DataFrame:
    """payloads: text, status, body of a trend service.  The last ratio of the
    first series less its first; null if either is no number."""
    series = _get("_doc", "$.results[0].data", "array<variant>")
    last = F.try_element_at(series, F.greatest(F.size(series), F.lit(1)))
    return _channel(payloads, _number(last, "$.ratio") - _number("_doc", "$.results[0].data[0].ratio"))
