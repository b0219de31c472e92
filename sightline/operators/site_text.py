"""Text analytics over the pages of a site.

terms: site_id, page, term, n (how often the term is on the page).
"""

from __future__ import annotations

import hashlib
import math
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..sources.shared import scratch


def page_terms(pages: DataFrame, text: Column, min_length: int = 2, split: str = r"[^\p{L}\p{N}]+") -> DataFrame:
    """Lower-case terms of each page of at least min_length characters.  A page
    without site or number has none.  That is said here, and n is asked for, so
    that the shuffle of terms is one and the same for all who use them."""
    words = pages.where("site_id IS NOT NULL AND page IS NOT NULL").select("site_id", "page", F.explode(F.split(F.lower(text), split)).alias("term")).where(F.char_length("term") >= min_length)
    return words.groupBy("site_id", "page", "term").agg(F.count(F.lit(1)).alias("n")).where("n > 0")


def tf_idf(terms: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """terms with ``tf``, ``df`` and ``tf_idf`` = n / max(total, 1) times
    ln((N + 1) / (df + 1)) + 1 over the pages N of the site.

    Totals and document frequencies are aggregates joined back on their keys.
    pages: site_id, page, for pages without terms; else those of terms count."""
    total = terms.groupBy("site_id", "page").agg(F.sum("n").alias("total"))
    df = terms.groupBy("site_id", "term").agg(F.count(F.lit(1)).alias("df"))
    n = (pages if pages is not None else total).groupBy("site_id").agg(F.count_distinct("page").alias("pages"))
    out = terms.join(total, ["site_id", "page"]).join(df, ["site_id", "term"]).join(n, "site_id")
    tf = F.col("n") / F.greatest("total", F.lit(1))
    return out.withColumn("tf", tf).withColumn("tf_idf", tf * (F.ln((F.col("pages") + 1) / (F.col("df") + 1)) + 1)).drop("total", "pages")


def top_terms(weighted: DataFrame, k: int = 20) -> DataFrame:
    """The k terms of a site with the largest sum of weights."""
    s = weighted.groupBy("site_id", "term").agg(F.sum("tf_idf").alias("weight"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("pages"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("weight"), "term"))).where(F.col("place") <= k)


def topic_clusters(terms: DataFrame, weighted: DataFrame, most: int = 10, related: int = 5) -> DataFrame:
    """Greedy clusters of a site's heaviest terms: a centre and the terms that
    share at least 40 % of its pages, each term in one cluster.

    Only candidates (max(5 * most, 20) a site) enter the greedy step as centres;
    the terms that go with each centre are counted in a join on pages."""
    candidates = top_terms(weighted, max(most * 5, 20)).select("site_id", "term", "place", "weight")
    centre = candidates.join(terms.select("site_id", "page", "term"), ["site_id", "term"]).select("site_id", "page", F.col("term").alias("centre"), "place")
    with_ = centre.join(terms.select("site_id", "page", "term"), ["site_id", "page"]).where("term <> centre").groupBy("site_id", "centre", "place", "term").agg(F.count(F.lit(1)).alias("n"))
    size = centre.groupBy("site_id", "centre").agg(F.count(F.lit(1)).alias("pages"))
    near = with_.join(size, ["site_id", "centre"]).where(F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("pages") * 0.4)))
    # a centre needs no more neighbours than could be taken before it plus its own
    near = near.withColumn("at", F.row_number().over(Window.partitionBy("site_id", "centre").orderBy(F.desc("n"), "term"))).where(F.col("at") <= most * (related + 1) + related)
    lists = near.groupBy("site_id", "centre").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("terms"))
    per_site = candidates.join(size.withColumnRenamed("centre", "term"), ["site_id", "term"]).join(lists.withColumnRenamed("centre", "term"), ["site_id", "term"], "left")
    per_site = per_site.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("place", "term", "pages", "weight", F.coalesce("terms", F.array().cast("array<string>")).alias("terms")))).alias("c"))
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<topic:string,terms:array<string>,pages:bigint,weight:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        free = F.slice(F.array_except(x["terms"], acc["used"]), 1, related)
        take = ~F.array_contains(acc["used"], x["term"]) & (F.size(acc["out"]) < most)
        used = F.concat(acc["used"], F.array(x["term"]), free)
        out = F.concat(acc["out"], F.array(F.struct(x["term"].alias("topic"), F.concat(F.array(x["term"]), free).alias("terms"), x["pages"].alias("pages"), x["weight"].alias("weight"))))
        return F.when(take, F.struct(used.alias("used"), out.alias("out"))).otherwise(acc)

    return per_site.select("site_id", F.posexplode(F.aggregate("c", start, step, lambda acc: acc["out"])).alias("pos", "t")).select("site_id", (F.col("pos") + 1).alias("place"), "t.*")


def page_sets(pages: DataFrame, text: Column, min_length: int = 2, split: str = r"[^\p{L}\p{N}]+") -> DataFrame:
    """site_id, page, ``s``: the different terms of each page as ``page_terms``
    has them, as hashes that differ by site; a page on several rows has several.
    Made row by row, without a shuffle."""
    long_enough = F.filter(F.split(F.lower(text), split), lambda w: F.char_length(w) >= min_length)
    s = F.array_distinct(F.transform(long_enough, lambda w: F.xxhash64("site_id", w)))
    return pages.where("site_id IS NOT NULL AND page IS NOT NULL").select("site_id", "page", s.alias("s"))


def duplicate_ratio(terms: DataFrame, pages: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``duplicate_sets`` of the pages' terms."""
    return duplicate_sets(terms.groupBy("site_id", "page").agg(F.collect_list(F.xxhash64("site_id", "term")).alias("s")), pages, threshold)


#: Two tables of so many counts tell how rare a term is; sets of a block.
_SLOTS, _BLOCK = 1 << 24, 1024
#: Below half of a set's smallest step, so that rounding drops no pair.
_EPS = 1e-9


def _stored(df: DataFrame) -> DataFrame:
    """df through files, so that it is made once and its size is known."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h & (_SLOTS - 1), (h >> 24) & (_SLOTS - 1)


def _seen(sets: DataFrame) -> np.ndarray:
    """How many sets have a term of each slot, in both tables; 65,535 at most."""

    def of_part(batches):
        t = np.zeros((2, _SLOTS), np.uint32)
        for rows in batches:
            for k, at in enumerate(_slots(np.concatenate([np.frombuffer(r, np.int64) for r in rows]))):
                at, n = np.unique(at, return_counts=True)
                t[k, at] += n.astype(np.uint32)
        yield np.minimum(t, 65535).astype(np.uint16)

    def chunks(rows):
        while part := [bytes(r[0]) for r in islice(rows, 2000)]:
            yield part

    add = lambda a, b: np.minimum(a.astype(np.uint32) + b, 65535).astype(np.uint16)
    parts = sets.select("s").coalesce(sets.sparkSession.sparkContext.defaultParallelism).rdd.mapPartitions(lambda rows: of_part(chunks(rows)))
    return parts.treeReduce(add)


def _prefixes(seen, threshold: float):
    """For a set of n terms, rarest first: ``n``, ``g`` (a digest), ``prefix`` (of
    those in which sets above the threshold agree once at least, the ones that
    other sets may have), ``ix``, how many of these a set is looked up by where
    the other is as long or longer, and ``bits``."""

    def run(batches):
        t = seen and seen.value
        for batch in batches:
            n, g, prefix, ix, bits = [], [], [], [], []
            for raw in batch["s"].to_pylist():
                h = np.frombuffer(raw, np.int64)
                x, y = _slots(h)
                c = np.minimum(t[0][x], t[1][y])
                order = np.lexsort((h, c))
                k, p, i = len(h), *_lengths(len(h), threshold)
                shared = c[order] > 1
                n.append(k), g.append(hashlib.blake2b(raw, digest_size=16).digest())
                prefix.append(h[order][:p][shared[:p]]), ix.append(int(shared[:i].sum())), bits.append(_bits(h))
            yield pa.RecordBatch.from_arrays([batch["v"], batch["site_id"], pa.array(n, pa.int32()), pa.array(g, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(ix, pa.int32()), pa.array(bits, pa.binary())], ["v", "site_id", "n", "g", "prefix", "ix", "bits"])

    return run


def _lengths(n, threshold: float):
    """Lengths of the two prefixes of a set of n terms."""
    return n - math.ceil(threshold * n - _EPS) + 1, n - math.ceil(2 * threshold / (1 + threshold) * n - _EPS) + 1


def _bits(h: np.ndarray) -> bytes:
    """Of each slot, by a term's last bits, whether an odd number of terms is in
    it: two slots a term or more, a power of two."""
    slots = 1 << max(6, (2 * len(h) - 1).bit_length())
    return np.packbits(np.bincount(h & (slots - 1), minlength=slots).astype(np.uint8) & 1).tobytes()


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """At least how many terms are in one set alone, by their bits: each slot that
    differs has one at least.  The longer one is folded to the other's length."""
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _of_block(keep, kind):
    """The pairs of a block whose two sets keep holds for."""

    def run(key, pairs: pa.Table, sets: pa.Table) -> pa.Table:
        s = {v: np.frombuffer(raw, kind) for v, raw in zip(sets["v"].to_pylist(), sets["s"].to_pylist(), strict=True)}
        n = dict(zip(sets["v"].to_pylist(), sets["n"].to_pylist(), strict=True))
        p, q = pairs["p"].to_pylist(), pairs["q"].to_pylist()
        return pairs.select(["p", "q"]).filter(pa.array([keep(s[x], s[y], n[x] + n[y]) for x, y in zip(p, q, strict=True)], pa.bool_()))

    return run


def _maybe(threshold: float):
    """Whether two sets of n terms together can be above the threshold by their
    bits."""
    return _of_block(lambda x, y, n: n - _apart(x, y) >= 2 * (threshold / (1 + threshold) * n - _EPS), np.uint8)


def _alike(threshold: float):
    """Whether two sets are above the threshold."""

    def keep(x, y, n):
        both = np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)
        return both / (n - both) > threshold

    return _of_block(keep, np.int64)


def _in_blocks(pairs: DataFrame, sets: DataFrame, size: int, run, schema: str) -> DataFrame:
    """run over the pairs (p, q, ...) whose ends are of the same two blocks of
    about size sets each, and these sets (v, n, s): a set is sent once to a block
    that it has a pair with, not once a pair."""
    need = _stored(pairs.select(F.col("p").alias("v")).unionByName(pairs.select(F.col("q").alias("v"))).distinct())
    n = need.count()
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n // size + 1))
    at = pairs.select("*", block("p").alias("x"), block("q").alias("y"))
    end = lambda c: at.select(F.col(c).alias("v"), F.col("x").alias("i"), F.col("y").alias("j"))
    found = sets.join(F.broadcast(need) if n <= 2_000_000 else need, "v", "left_semi")
    return at.groupBy("x", "y").cogroup(end("p").unionByName(end("q")).distinct().join(found, "v").groupBy("i", "j")).applyInArrow(run, schema)


def _packed(batches):
    for b in batches:
        raw = [np.unique(np.array(x, np.int64)).tobytes() for x in b["s"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b[c] if c != "s" else pa.array(raw, pa.binary()) for c in b.schema.names], b.schema.names)


def duplicate_sets(sets: DataFrame, pages: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Share of page pairs of a site whose term sets have a Jaccard similarity
    above threshold, four digits; an empty page is like no other.  sets: site_id,
    page, s (array of long, terms of different sites differ).

    Pages with equal sets are one node with a count, so n copies of a page are
    n * (n - 1) / 2 by arithmetic, not by rows.  A pair of different sets above
    the threshold shares one of the rarest terms of both (prefix filter), so these
    come from an equi-join on those terms, not from all pairs.  How rare a term is
    is read from two small tables of counts; any order gives all pairs.  The
    shorter set is looked up by fewer terms, and a pair whose prefixes share too
    few for what is left of either is gone before a set is looked at; of what stays,
    two bits a term tell most that are too far apart, and then the sets themselves
    meet, in blocks.  None of these steps drops a pair above the threshold.
    threshold is below 1."""
    spark = sets.sparkSession
    site = sets.schema["site_id"].dataType.simpleString()
    rows = _stored(sets.where(F.size("s") > 0).select(F.monotonically_increasing_id().alias("v"), "site_id", "page", "s").mapInArrow(_packed, f"v long, site_id {site}, page {sets.schema['page'].dataType.simpleString()}, s binary"))
    again = _stored(rows.groupBy("site_id", "page").agg(F.min("v").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select("site_id", "page", "first"))
    if again.take(1):
        # pages on several rows: their sets are put together, the rest stay as they are
        parts = rows.join(again, ["site_id", "page"]).groupBy("first").agg(F.first("site_id").alias("site_id"), F.first("page").alias("page"), F.collect_list("s").alias("s"))
        union = lambda batches: (pa.RecordBatch.from_arrays([b["v"], b["site_id"], b["page"], pa.array([np.unique(np.frombuffer(b"".join(x), np.int64)).tobytes() for x in b["s"].to_pylist()], pa.binary())], ["v", "site_id", "page", "s"]) for b in batches)
        rows = _stored(rows.join(again, ["site_id", "page"], "left_anti").unionByName(parts.withColumnRenamed("first", "v").mapInArrow(union, rows.schema)))
    seen = spark.sparkContext.broadcast(_seen(rows)) if rows.take(1) else None
    nodes = _stored(rows.select("v", "site_id", "s").mapInArrow(_prefixes(seen, threshold), f"v long, site_id {site}, n int, g binary, prefix array<long>, ix int, bits binary"))
    equal = _stored(nodes.groupBy("site_id", "g").agg(F.min("v").alias("node"), F.count(F.lit(1)).alias("m")).where("m > 1"))
    copies = _stored(nodes.select("site_id", "g", "v").join(equal, ["site_id", "g"]).where("v <> node").select("v"))
    keyed = nodes.where(F.size("prefix") > 0).join(copies, "v", "left_anti").select("v", "n", "ix", F.posexplode("prefix").alias("at", "h"))
    a, b = keyed.select("h", "v", "n").alias("a"), keyed.where("at < ix").select("h", "v", "n").alias("b")
    longer = (F.col("a.n") > F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.v") > F.col("b.v")))
    met = a.join(b, (F.col("a.h") == F.col("b.h")) & longer & (F.col("b.n") >= threshold * F.col("a.n") - _EPS))
    na, nb = F.col("a.n"), F.col("b.n")
    # what the prefixes leave of a set, of the longer one or of the shorter one, and how many they must share
    left = F.greatest(F.ceil(na * threshold - _EPS), F.ceil(nb * (2 * threshold / (1 + threshold)) - _EPS)) - 1
    least = F.ceil((na + nb) * (threshold / (1 + threshold)) - _EPS) - left
    met = met.groupBy(F.col("a.v").alias("p"), F.col("b.v").alias("q"), least.cast("int").alias("least")).agg(F.count(F.lit(1)).alias("k"))
    near = _stored(met.where("k >= least").select("p", "q"))
    near = _stored(_in_blocks(near, nodes.select("v", "n", F.col("bits").alias("s")), 16 * _BLOCK, _maybe(threshold), "p long, q long"))
    pairs = _in_blocks(near, rows.select("v", (F.octet_length("s") / 8).cast("int").alias("n"), "s"), _BLOCK, _alike(threshold), "p long, q long")
    # a pair counts once for each two pages that have these sets
    times = lambda c: equal.select(F.col("node").alias(c), F.col("m").alias(f"m{c}"))
    apart = pairs.join(times("p"), "p", "left").join(times("q"), "q", "left").join(nodes.select(F.col("v").alias("p"), "site_id"), "p")
    apart = apart.select("site_id", (F.coalesce("mp", F.lit(1)) * F.coalesce("mq", F.lit(1))).alias("w"))
    alike = equal.select("site_id", (F.col("m") * (F.col("m") - 1) / 2).cast("long").alias("w"))
    high = apart.unionByName(alike).groupBy("site_id").agg(F.sum("w").alias("high"))
    n = pages.groupBy("site_id").agg(F.count_distinct("page").alias("n"))
    all_ = F.col("n") * (F.col("n") - 1) / 2
    ratio = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(half_up(F.coalesce("high", F.lit(0)) / all_, 4))
    return n.join(high, "site_id", "left").select("site_id", F.col("n").alias("pages"), F.coalesce("high", F.lit(0)).cast("long").alias("duplicate_pairs"), ratio.alias("duplicate_ratio"))


def site_totals(pages: DataFrame) -> DataFrame:
    """pages: site_id, word_count.  Pages, words and words a page (two digits) of a
    site; a null count is 0."""
    words = F.sum(F.coalesce("word_count", F.lit(0)).cast("long"))
    s = pages.groupBy("site_id").agg(F.count(F.lit(1)).alias("pages"), words.alias("words"))
    return s.withColumn("average", half_up(F.col("words") / F.col("pages"), 2))


def targets_keyword(keyword: Column, title: Column, h1: Column, h2: Column, body: Column) -> Column:
    """Whether a page targets a keyword: in its title, h1 or an h2, or at least
    three times in its body, case aside."""
    k = F.lower(keyword)
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), k)
    low = F.lower(F.coalesce(body, F.lit("")))
    times = (F.char_length(low) - F.char_length(F.replace(low, k, F.lit("")))) / F.char_length(k)
    heads = F.exists(F.coalesce(h2, F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), k))
    return (k != "") & (has(title) | has(h1) | heads | (times >= 3))


def cannibalisation(pages: DataFrame, keywords: DataFrame) -> DataFrame:
    """Keywords that two or more pages of a site target.  pages: site_id, page,
    title, h1, h2, body.  keywords: site_id, keyword; they are joined by site."""
    k = keywords.where(F.char_length("keyword") >= 2).distinct()
    hit = pages.join(k, "site_id").where(targets_keyword(F.col("keyword"), F.col("title"), F.col("h1"), F.col("h2"), F.col("body")))
    out = hit.groupBy("site_id", "keyword").agg(F.count_distinct("page").alias("pages"))
    return out.where("pages >= 2")


def readability(average_sentence: Column, average_paragraph: Column) -> Column:
    """100 less the words above 25 a sentence and 5 a sentence above 5 a paragraph."""
    lost = F.greatest(F.lit(0.0), average_sentence - 25) + 5 * F.greatest(F.lit(0.0), average_paragraph - 5)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - lost))


def missing_topics(expected: Column, found: Column, body: Column) -> Column:
    """Expected topics that are neither among the found terms nor in the text."""
    low = F.lower(body)
    have = F.transform(found, lambda x: F.lower(x))
    return F.filter(expected, lambda t: ~F.array_contains(have, F.lower(t)) & ~F.contains(low, F.lower(t)))


def topic_coverage(words: DataFrame, topics: DataFrame) -> DataFrame:
    """Share of a site's words that are of its topics, to four places; 0 without
    words.  words: site_id, word, n.  topics: site_id, word."""
    t = topics.select("site_id", "word", F.lit(True).alias("_of")).distinct()
    x = words.join(t, ["site_id", "word"], "left").groupBy("site_id").agg(F.sum(F.when(F.col("_of"), F.col("n"))).alias("hit"), F.sum("n").alias("all"))
    return x.select("site_id", F.when(F.col("all") > 0, F.round(F.coalesce("hit", F.lit(0)) / F.col("all"), 4)).otherwise(0.0).alias("coverage"))
