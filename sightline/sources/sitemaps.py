"""Sitemaps as tables, and pages from bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_URLS = 1000


def sitemap_urls(sitemaps: DataFrame, most: int = MAX_URLS) -> DataFrame:
    """sitemaps: site_id, xml.  Rows site_id, pos, url, priority of a urlset, the
    first ``most`` (a sitemap's own limit); of an index, its first sitemap with
    kind ``index``.  Names match whatever their prefix; text that is not a
    sitemap gives no rows."""
    entry = F.regexp_extract_all("xml", F.lit(r"(?is)<(?:\w+:)?url\b[^>]*>(.*?)</(?:\w+:)?url>"), F.lit(1))
    child = F.regexp_extract("xml", r"(?is)<(?:\w+:)?sitemap\b[^>]*>.*?<(?:\w+:)?loc\b[^>]*>\s*(.*?)\s*</", 1)
    loc = lambda x: F.regexp_extract(x, r"(?is)<(?:\w+:)?loc\b[^>]*>\s*(.*?)\s*</", 1)
    rank = lambda x: F.regexp_extract(x, r"(?is)<(?:\w+:)?priority\b[^>]*>\s*([\d.]+)\s*</", 1).try_cast("double")
    plain = lambda c: F.replace(c, F.lit("&amp;"), F.lit("&"))
    urls = sitemaps.select("site_id", F.posexplode(F.slice(entry, 1, most)).alias("pos", "x")).select("site_id", "pos", plain(loc(F.col("x"))).alias("url"), F.coalesce(rank(F.col("x")), F.lit(0.0)).alias("priority"), F.lit("url").alias("kind")).where("url <> ''")
    first = sitemaps.where(F.size(entry) == 0).select("site_id", F.lit(0).alias("pos"), plain(child).alias("url"), F.lit(0.0).alias("priority"), F.lit("index").alias("kind")).where("url <> ''")
    return urls.unionByName(first)


def sitemap_order(urls: DataFrame) -> DataFrame:
    """Urls of a site by priority, then as they stand."""
    from pyspark.sql import Window

    return urls.withColumn("place", F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("priority"), "pos")))


def decode_pages(files: DataFrame) -> DataFrame:
    """files: site_id, url, content (binary), content_type.  ``html`` decoded by
    the header's charset, else the one named in the first 4096 bytes, else
    UTF-8; bytes that don't fit become replacement characters."""
    import re

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for raw, kind in zip(part["content"], part["content_type"], strict=True):
                raw = bytes(raw or b"")
                m = re.search(r"charset=[\"']?([\w-]+)", kind or "", re.I) or re.search(r"<meta[^>]+charset=[\"']?([\w-]+)", raw[:4096].decode("latin-1"), re.I)
                try:
                    out.append(raw.decode(m[1] if m else "utf-8", "replace"))
                except LookupError:
                    out.append(raw.decode("utf-8", "replace"))
            yield pd.DataFrame({"site_id": part["site_id"], "url": part["url"], "html": out})

    return files.select("site_id", "url", "content", "content_type").mapInPandas(run, "site_id string, url string, html string")
