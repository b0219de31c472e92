"""How AI answers cite a business.

citations: site_id, pos, query, response, business_name, url, grounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..functions.urls import domain_of

#: Particles that may follow a cited name (fixed values).
PARTICLES = ["에서는", "에서", "에는", "으로", "은", "는", "이", "가", "을", "를", "에", "의", "도", "로", "와", "과"]


def first_mention(response: Column, name: Column) -> Column:
    """0-based place of the name, case aside; -1 if absent or without a name."""
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.when(n == "", F.lit(-1)).otherwise(F.call_function("locate", n, F.lower(F.coalesce(response, F.lit("")))) - 1)


def prominence(index: Column, length: Column) -> Column:
    """1 at the start, falling to 0 at the end; 0 without a mention."""
    return F.when((index < 0) | (length <= 0), F.lit(0.0)).otherwise(half_up(1 - F.least(index, length) / length, 3))


def cited(citations: DataFrame) -> DataFrame:
    """citations with ``mentioned``, ``first_index``, ``prominence``,
    ``url_cited``, ``direct``."""
    response = F.coalesce("response", F.lit(""))
    index = first_mention(F.col("response"), F.col("business_name"))
    domain = domain_of(F.col("url"))
    quoted = F.concat(F.lit(r"(?i)(?:^|[\s.,!?;:'\"\[(—-])\Q"), F.col("business_name"), F.lit(r"\E\s*(?:"), F.lit("|".join(PARTICLES)), F.lit(r")(?=[\s.,!?;:'\"\])—-]|$|[가-힣A-Za-z])"))
    direct = F.when(F.coalesce("business_name", F.lit("")) == "", F.lit(False)).otherwise(F.regexp_like(response, quoted))
    return citations.withColumns({
        "first_index": index, "mentioned": index >= 0, "prominence": prominence(index, F.char_length(response)),
        "url_cited": (domain != "") & F.contains(F.lower(response), domain), "direct": direct,
    })


#: What makes a mention negative, and a list.
NEGATIVE = ["비추", "비추천", "주의", "조심", "피해", "불만", "별로", "추천하지", "권하지 않"]
LIST_MARKS = ["1)", "2)", "1.", "2.", "①", "②", "- ", "* "]
MARKER, MOST_NAMES, LONGEST_NAME = "[추천업체]", 10, 40


def mention_context(response: Column, index: Column, name: Column) -> Column:
    """none, negative (within 60 characters), primary (in the first quarter of an
    answer without a list), in-list or incidental."""
    r = F.coalesce(response, F.lit(""))
    near = F.lower(F.substring(r, F.greatest(index - 60, F.lit(0)) + 1, F.least(index, F.lit(60)) + F.char_length(name) + 60))
    some = lambda where, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(where, w))
    return F.when((index < 0) | (F.coalesce(name, F.lit("")) == "") | (r == ""), "none").when(some(near, NEGATIVE), "negative").when((index < F.char_length(r) * 0.25) & ~some(r, LIST_MARKS), "primary").when(some(r, LIST_MARKS), "in-list").otherwise("incidental")


def listed_names(response: Column, own: Column) -> Column:
    """Names of the numbered list after the marker, until the first other line:
    without what follows a bracket or dash, quotes, the own name and repeats."""
    after = F.when(F.contains(response, F.lit(MARKER)), F.element_at(F.split(response, r"\Q[추천업체]\E", 2), 2)).otherwise(F.lit(""))
    lines = F.filter(F.split(after, r"\r?\n"), lambda x: F.trim(x) != "")
    numbered = r"^\s*\d{1,2}\s*[.)\-:]\s*(.+?)\s*$"
    stop = F.array_position(F.transform(lines, lambda x: ~x.rlike(numbered)), True)
    block = F.when(stop > 0, F.slice(lines, F.lit(1), F.greatest(stop.cast("int") - 1, F.lit(0)))).otherwise(lines)
    names = F.transform(block, lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract(x, numbered, 1), r"\s*[(（\-—:].*$", "")), r"^[\"'*`]+|[\"'*`]+$", "")))
    good = F.filter(names, lambda n: (n != "") & (F.char_length(n) <= LONGEST_NAME) & ~n.rlike(r"(?i)^(없음|없습니다|해당\s*없음|n/?a|none|-)$") & (F.lower(n) != F.lower(F.trim(F.coalesce(own, F.lit(""))))))
    return F.slice(F.array_distinct(good), 1, MOST_NAMES)


def citation_metrics(rows: DataFrame) -> DataFrame:
    """Rates a site, three digits; every citation counts."""
    rate = lambda c: half_up(F.avg(F.col(c).cast("double")), 3)
    return rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("citations"), rate("mentioned").alias("mention_rate"), rate("url_cited").alias("url_rate"), rate("direct").alias("direct_rate"), half_up(F.avg("prominence"), 3).alias("prominence"))


def probe_score(mention: Column, direct: Column, url: Column) -> Column:
    return half_up(70 * mention + 20 * direct + 10 * url).cast("int")


def recommended(rows: DataFrame, k: int | None = None) -> DataFrame:
    """rows: site_id, pos, query, names.  How many queries name a competitor,
    once each, with the first such query; ties by first appearance."""
    each = rows.select("site_id", "pos", "query", F.posexplode("names").alias("at", "name")).withColumn("name", F.trim("name")).where("name <> ''")
    first = F.struct("pos", "at")
    out = each.groupBy("site_id", "name").agg(F.count_distinct("pos").alias("queries"), F.min_by("query", first).alias("sample_query"), F.min(first).alias("_o"))
    out = out.withColumn("place", F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("queries"), "_o"))).drop("_o")
    return out if k is None else out.where(F.col("place") <= k)


def evidence_by_name(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """rows (name and more) with the evidence of the same trimmed name, null if
    there is none.  evidence: name, pos, evidence; the last of equal names counts."""
    last = evidence.groupBy(F.trim("name").alias("_name")).agg(F.max_by("evidence", "pos").alias("evidence"))
    return rows.join(last, F.trim(rows["name"]) == last["_name"], "left").drop("_name")
