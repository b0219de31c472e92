"""Snippets as JSON, HTML and text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT = "https://schema.org"


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k.replace("at_", "@")) for k, v in fields.items())))


def local_business(name: Column, url: Column, phone: Column, address: Column, region: Column, kind: str = "LocalBusiness") -> Column:
    postal = F.when(address.isNotNull(), F.struct(F.lit("PostalAddress").alias("@type"), address.alias("streetAddress"), region.alias("addressRegion")))
    return _json(at_context=F.lit(CONTEXT), at_type=F.lit(kind), name=name, url=url, telephone=phone, address=postal)


def organization(name: Column, url: Column, logo: Column, phone: Column) -> Column:
    return _json(at_context=F.lit(CONTEXT), at_type=F.lit("Organization"), name=name, url=url, logo=logo, telephone=phone)


def services(provider: Column, names: Column) -> Column:
    offer = F.transform(names, lambda n: F.struct(F.lit("Service").alias("@type"), n.alias("name"), F.struct(F.lit("LocalBusiness").alias("@type"), provider.alias("name")).alias("provider")))
    return F.to_json(F.struct(F.lit(CONTEXT).alias("@context"), offer.alias("@graph")))


def breadcrumb(trail: Column) -> Column:
    """trail: array of (name, url)."""
    items = F.transform(trail, lambda x, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), x["name"].alias("name"), x["url"].alias("item")))
    return _json(at_context=F.lit(CONTEXT), at_type=F.lit("BreadcrumbList"), itemListElement=items)


def faq_schema(pairs: Column) -> Column:
    """pairs: array of (question, answer)."""
    items = F.transform(pairs, lambda x: F.struct(F.lit("Question").alias("@type"), x["question"].alias("name"), F.struct(F.lit("Answer").alias("@type"), x["answer"].alias("text")).alias("acceptedAnswer")))
    return _json(at_context=F.lit(CONTEXT), at_type=F.lit("FAQPage"), mainEntity=items)


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def faq_html(pairs: Column) -> Column:
    rows = F.transform(pairs, lambda x: F.concat(F.lit("<details><summary>"), escape_html(x["question"]), F.lit("</summary><p>"), escape_html(x["answer"]), F.lit("</p></details>")))
    return F.concat(F.lit('<section class="faq">'), F.array_join(rows, "\n"), F.lit("</section>"))


def llms_txt(name: Column, summary: Column, links: Column) -> Column:
    """links: array of (name, url)."""
    rows = F.transform(links, lambda x: F.concat(F.lit("- ["), x["name"], F.lit("]("), x["url"], F.lit(")")))
    return F.concat_ws("\n", F.concat(F.lit("# "), name), F.lit(""), F.concat(F.lit("> "), summary), F.lit(""), F.array_join(rows, "\n"))
