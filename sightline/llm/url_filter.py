"""URL block and allow lists by hashed host-suffix and path-prefix expressions.

Every distinct URL is expanded into the expressions (host suffix + path prefix)
that a rule could have been written as.  Expressions and rules meet in an
equi-join on the first 32 bits of their SHA-256; the full digest and the rule's
own path then confirm a hit, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table

#: (host, path, verdict) of the query's contract.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DEFAULT_VERDICT = "allow"
PREFIX_HEX = 8
#: A rule table of at most so many rows is broadcast; a larger one is shuffled.
BROADCAST_RULES = 100_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    after = rest.substr(F.length(host) + 1, F.length(rest) + 1)
    path = F.regexp_extract(after, r"^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _anchor(path: Column) -> Column:
    """A path up to and with its last slash; empty if it has none."""
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def url_verdicts(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per distinct URL: url, ``host``, ``path``, ``rule``, ``verdict``.

    rules: columns host, path, verdict.  A rule fits its host and all its
    subdomains if the URL's path starts with the rule's path, at any character.
    The rule with the most characters (host and path together) wins; of equally
    long ones the one with the longer host, then a block before an allow, then
    the smaller text.  A null URL, or one without ``://``, has an empty host and
    path.  Without a fitting rule ``rule`` is null and the verdict the default.
    Rules with a null host, path or verdict fit nothing.

    A rule's anchor is its path up to the last slash, so the expressions of a
    URL are its host suffixes times its path's anchors.  They are made only up
    to the label count and slash count that some rule has."""
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    deep = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.length("path") - F.length(F.replace("path", F.lit("/")))).alias("slashes")).first()
    max_labels, max_slashes = (deep["labels"] or 0), (deep["slashes"] or 0)
    r = rules.select(
        F.col("host").alias("_rhost"), F.col("path").alias("_rpath"), F.col("verdict").alias("_rverdict"), F.concat("host", "path").alias("_rule"),
        F.sha2(F.concat("host", F.lit("\n"), _anchor(F.col("path"))), 256).alias("_rdigest"),
    ).withColumn("_short", F.substring("_rdigest", 1, PREFIX_HEX))
    u = urls.select(F.col(url_col).alias("url")).distinct().select("url", *(c.alias(n) for c, n in zip(split_url(F.col("url")), ("host", "path"), strict=True)))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(max_labels, 1)))), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    parts = F.split("path", "/")
    depth = F.least(F.size(parts) - 1, F.lit(max_slashes))
    anchors = F.transform(F.sequence(F.lit(0), depth), lambda i: F.when(i > 0, F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))).otherwise(F.lit("")))
    x = u.select("url", "path", F.explode(suffixes).alias("_s"), anchors.alias("_a")).select("url", "path", "_s", F.explode("_a").alias("_a"))
    x = x.select("url", "path", F.sha2(F.concat("_s", F.lit("\n"), "_a"), 256).alias("_digest")).withColumn("_short", F.substring("_digest", 1, PREFIX_HEX))
    r = F.broadcast(r) if small(rules, BROADCAST_RULES) else r
    hits = x.join(r, "_short").where((F.col("_digest") == F.col("_rdigest")) & F.startswith("path", F.col("_rpath")))
    order = F.struct(-F.length("_rule"), -F.length("_rhost"), F.when(F.col("_rverdict") == "block", 0).otherwise(1), "_rule", "_rverdict")
    best = hits.groupBy("url").agg(F.min_by(F.struct("_rule", "_rverdict"), order).alias("_hit"))
    return u.join(best, "url", "left").select("url", "host", "path", F.col("_hit._rule").alias("rule"), F.coalesce("_hit._rverdict", F.lit(default)).alias("verdict"))


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per row of pages (repeats included): the id, ``host``, ``path``,
    ``rule``, ``verdict``; see url_verdicts.  Other columns are not looked at."""
    rows = pages.select(F.col(id_col), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    return rows.join(url_verdicts(rows, rules, default=default), "url", "left").select(id_col, "host", "path", "rule", "verdict")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter(table(spark, sf_dir, "pages"), rules)


OP5_SQL = """
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS raw, r FROM rest),
pages2 AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path FROM cut),
ranked AS (SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
           FROM pages2 LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM ranked WHERE k = 1
"""
