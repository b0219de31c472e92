"""URL parts and predicates as native expressions.

All return null or false on what does not parse; none raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(?i)([a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def host(url: Column) -> Column:
    """Lower-case host, empty if there is none."""
    return F.lower(F.regexp_extract(url, _PARTS, 2))


def site(url: Column) -> Column:
    """Host without a leading ``www.``: the grouping key of a site."""
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    """Path, ``/`` if empty."""
    p = F.regexp_extract(url, _PARTS, 4)
    return F.when(p == "", F.lit("/")).otherwise(p)


def path_depth(url: Column) -> Column:
    """Number of path segments that are not empty."""
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))


def same_site(a: Column, b: Column) -> Column:
    return (site(a) != "") & (site(a) == site(b))


def normalize(url: Column) -> Column:
    """https:// added if there is no scheme; no trailing slashes but the root's."""
    trimmed = F.trim(url)
    full = F.when(trimmed.rlike(r"^(?i)[a-z][a-z0-9+.-]*://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))
    bare = F.regexp_replace(full, r"/+$", "")
    return F.when(bare.rlike(r"^(?i)[a-z][a-z0-9+.-]*://[^/]+$"), F.concat(bare, F.lit("/"))).otherwise(bare)


def domain_of(value: Column) -> Column:
    """Host without www.; text without a scheme counts from its start."""
    loose = F.lower(F.regexp_extract(value, r"^(?i)(?:https?://)?(?:www\.)?([^/\s?#]+)", 1))
    return F.coalesce(F.when(site(value) != "", site(value)).otherwise(loose), F.lit(""))


#: Path kinds in the order in which a crawl visits them (fixed values).
CRAWL_ORDER = ["faq", "about", "services?", "contact", "products?"]


def crawl_priority(url: Column) -> Column:
    """0 for the first kind of page, one more than the last for any other."""
    out = None
    for k, kind in enumerate(CRAWL_ORDER):
        hit = F.lower(path(url)).rlike(rf"/{kind}")
        out = F.when(hit, F.lit(k)) if out is None else out.when(hit, F.lit(k))
    return out.otherwise(F.lit(len(CRAWL_ORDER)))


def is_public(url: Column) -> Column:
    """Whether a fetch may go there: http(s), and no private, loopback,
    link-local, carrier, benchmark, multicast or metadata host."""
    # a host is found once, whatever is asked of it
    return F.coalesce(F.element_at(F.transform(F.array(F.struct(scheme(url).alias("scheme"), host(url).alias("host"))), lambda u: _is_public(u["scheme"], u["host"])), 1), F.lit(False))


def _is_public(kind: Column, h: Column) -> Column:
    octet = lambda k: F.expr("0") if k is None else F.try_element_at(F.split(h, r"\."), F.lit(k)).cast("string")
    number = lambda k: octet(k).try_cast("int")
    v4 = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    a, b = number(1), number(2)
    private = (a == 10) | (a == 127) | (a == 0) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.between(18, 19))
    named = h.isin("localhost", "metadata.google.internal") | h.rlike(r"\.(localhost|local|internal)$")
    v6 = h.rlike(r"^\[(::1?|f[cd].*|fe[89ab].*|::ffff:.*)\]$")
    return F.coalesce(kind.isin("http", "https") & (h != "") & ~named & ~v6 & ~(v4 & private), F.lit(False))


def same_page(a: Column, b: Column) -> Column:
    """Equal origin and path, trailing slashes aside."""
    key = lambda u: F.concat_ws("|", scheme(u), host(u), F.regexp_replace(path(u), r"/+$", ""))
    return key(a) == key(b)


def fetch_error(message: Column) -> Column:
    """Failure reason of a fetch error's message."""
    m = F.lower(message)
    return F.when(m.contains("timeout") | m.contains("timed out") | m.contains("abort"), "TIMEOUT").when(m.contains("enotfound") | m.contains("dns") | m.contains("eai_again"), "DNS_FAILED").otherwise("CONNECTION_REFUSED")


def status_failure(status: Column) -> Column:
    return F.when(status >= 500, "HTTP_5xx").when(status >= 400, "HTTP_4xx")
