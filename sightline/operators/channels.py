"""Traffic lights of a site's channels, and what its markup says of phones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def naver_light(queries: Column, visible: Column, homepage: Column) -> Column:
    """From place queries, how many showed the site, and whether its homepage
    was found; null queries mean nothing was measured."""
    ratio = F.when(queries > 0, visible / queries).otherwise(F.lit(0.0))
    return F.when(queries.isNull(), "red").when((ratio >= 0.75) & homepage, "green").when((ratio >= 1) & (queries > 0), "green").when(visible > 0, "yellow").otherwise("red")


def google_light(seo: Column, geo: Column) -> Column:
    """From the better of two scores; missing and odd ones count as 0."""
    known = lambda x: F.when(x.isNotNull() & ~F.isnan(x.cast("double")) & (x >= 0), x.cast("double")).otherwise(F.lit(0.0))
    best = F.greatest(known(seo), known(geo))
    return F.when(best >= 80, "green").when(best >= 40, "yellow").otherwise("red")


def ai_light(grounded: Column, cited: Column) -> Column:
    """Green only for a citation in a grounded answer; null grounded means that
    nothing was asked."""
    return F.when(grounded.isNull(), "red").when(grounded & cited, "green").when(grounded, "red").otherwise("yellow")


def _number(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"(?i){name}[:\s]*[=]?[\"']?(\d+)", 1).try_cast("int")


def viewport(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?i)<meta\s+name=[\"']viewport[\"']\s+content=[\"']([^\"']*)[\"']", 1), F.lit(""))


def missing_viewport(html: Column) -> Column:
    v = F.coalesce(viewport(html), F.lit(""))
    return ~(F.contains(v, F.lit("width=device-width")) | F.contains(v, F.lit("width=100%")))


def wider_than(html: Column, width: int) -> Column:
    """Whether a table or a styled div declares more pixels than the screen has."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<table[^>]*>|<div[^>]*style=[\"'][^\"']*[\"'])"), F.lit(1))
    return F.exists(tags, lambda t: F.coalesce(F.regexp_extract(t, r"(?i)width[:=\s]*[\"']?(\d+)(?![\d%])", 1).try_cast("int") > width, F.lit(False)))


def small_targets(html: Column, least: int = 48) -> Column:
    """Buttons and links that declare both sizes, one of them too small."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<button[^>]*>|<a\s[^>]*href=[\"'][^>]*>|<input[^>]*type=[\"']button[\"'][^>]*>)"), F.lit(1))
    return F.size(F.filter(tags, lambda t: F.coalesce((_number(t, "width") < least) | (_number(t, "height") < least), F.lit(False)) & _number(t, "width").isNotNull() & _number(t, "height").isNotNull()))


def small_text(html: Column, least: int = 12) -> Column:
    """(styled text elements, those with a font below least pixels)."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<(?:p|span|li|div|article|section)\b[^>]*style=[\"'][^\"']*[\"'])"), F.lit(1))
    small = F.filter(tags, lambda t: F.coalesce(F.regexp_extract(t, r"(?i)font-size[:\s]*(\d+)px", 1).try_cast("int") < least, F.lit(False)))
    return F.struct(F.size(tags).alias("total"), F.size(small).alias("too_small"))
