"""Mixing sources to target weights with a hypergeometric splitting tree.

Every source is dealt into BLOCKS blocks by a seeded hash, so block order is a
random permutation of its documents.  A source's target is a number of whole
passes over its blocks and a part of one more; the block on which that part
ends is divided further (sub-blocks, then documents, then words of one
document), so exact quotas come from counts and never from a sort of a source.

The draws of all sources are then split among output shards by a binary tree:
at each node the left half's share is a multivariate hypergeometric draw from
the node's quotas, so every shard's share is a fair one and the shares add up
exactly.  A shard's draws are consecutive, disjoint ranges of each source's
permuted blocks, and a document's place in its shard is a hash of its own.  The
words taken of a document are the sum of its draws.

A shard is written by as many tasks as its words need, dealt by a hash of the
draw, and each task puts its draws in the order of their places.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, no_rows, numbered_within, production, table, text_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BLOCKS = 1024
SHARDS = 64
#: Words of a task that writes a part of a shard, on average.
PART_WORDS = 16_000_000
SEED = 20240607
#: The splitting tree is planned on the driver from one row a source.
MAX_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Each source's words: share times all sizes by weight, none above most
    times its own size; the excess goes to the others by weight."""
    total = share * sum(sizes)
    out = [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    while open_:
        left = total - sum(out)
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] / weight * left >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] / weight * left
            break
        for i in full:
            out[i] = most * sizes[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def splitting_tree(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Draws of each source (columns) for each shard (rows); columns add up to
    quotas and rows differ by one at most.  Wide quotas are split source by
    source, a univariate hypergeometric draw each, so any number fits."""
    rng = np.random.default_rng(seed)

    def split(have: np.ndarray, n: int) -> list[np.ndarray]:
        if n == 1:
            return [have]
        left = n // 2
        total = int(have.sum())
        want = total * left // n
        share = np.zeros_like(have)
        rest, need = total, want
        for i, h in enumerate(have.tolist()):
            rest -= h
            k = int(rng.hypergeometric(h, rest, need)) if need and h else 0
            share[i] = k
            need -= k
        return split(share, left) + split(have - share, n - left)

    return np.array(split(quotas.astype(np.int64), shards))


def _hash(column: str, seed: int, level: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column), F.lit(seed), F.lit(level)), F.lit(BLOCKS))


_DRAWS = T.ArrayType(T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("words", T.LongType()), T.StructField("place", T.LongType())]))


class Mix:
    """A planned mix: a row or less for each source, and how to apply them.

    Planning reads ids, sources and word counts; applying is an expression on a
    row and these few facts, so texts are never moved to decide on them."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = SHARDS, seed: int = SEED):
        self.id_col, self.text_col, self.source_col, self.seed, self.shards = id_col, text_col, source_col, seed, shards
        spark = docs.sparkSession
        #: The narrow rows: key, word count and, last, the id.
        self.rows = checkpointed(self._keyed(docs, F.col(id_col).alias("_id")))
        rows = self.rows.select("_s", "_n", "_h", _hash("_h", seed, 1).alias("_b"))
        blocks = rows.groupBy("_s", "_b").agg(F.sum("_n").alias("_w"))
        found = blocks.groupBy("_s").agg(F.sum("_w").alias("_w")).orderBy(F.col("_s").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        names = [r["_s"] for r in found]
        sizes = [r["_w"] for r in found]
        target = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
        self.words = int(sum(target))
        # whole passes, and the words of the part of one more
        passes = [min(int(t // s), int(most)) if s else 0 for t, s in zip(target, sizes, strict=True)]
        part = [int(t + 0.5) - p * s for t, s, p in zip(target, sizes, passes, strict=True)]
        plan = spark.createDataFrame(list(zip(names, sizes, target, passes, part, strict=True)), "_s string, _size long, _target double, _passes int, _part long")

        # the block, the sub-block and the document in which each part ends
        left = plan.where("_part > 0").select(F.col("_s").alias("_ls"), F.col("_part").alias("_left"))
        end1 = checkpointed(self._end(blocks, left, "_b"))
        inner = self._within(rows, end1, "_b").withColumn("_c", _hash("_h", seed, 2))
        end2 = checkpointed(self._end(inner.groupBy("_s", "_c").agg(F.sum("_n").alias("_w")), end1, "_c"))
        leaf = self._within(inner, end2, "_c").groupBy("_s", F.col("_h").alias("_d")).agg(F.sum("_n").alias("_w"), F.count(F.lit(1)).alias("_c"))
        end3 = checkpointed(self._end(leaf, end2, "_d", "_c"))
        #: Whether some part ends in rows that repeat an id and a text.
        self.repeated = not no_rows(end3.where("_c > 1"))

        # the tree: a draw is a block of a pass; the block in which a part ends counts as one
        ends = {r["_ls"]: r["_end_b"] for r in end1.collect()}
        quota = np.array([p * BLOCKS + (ends[s] + 1 if s in ends else 0) for p, s in zip(passes, names, strict=True)], np.int64)
        bounds = np.cumsum(splitting_tree(quota, shards, seed), axis=0) if names else np.zeros((shards, 0), np.int64)
        cuts = spark.createDataFrame([(s, bounds[:, i].tolist()) for i, s in enumerate(names)], "_s string, _cuts array<long>")
        self.facts = [plan, cuts, end1.drop("_left"), end2.drop("_left"), end3.withColumnsRenamed({"_left": "_left3", "_c": "_rows"})]

    def _keyed(self, docs: DataFrame, *more: Column) -> DataFrame:
        t = text_of(self.text_col)
        return docs.select(F.col(self.source_col).cast("string").alias("_s"), word_count(t).alias("_n"), F.xxhash64(F.col(self.id_col), t).alias("_h"), *more)

    @staticmethod
    def _end(pieces: DataFrame, left: DataFrame, key: str, *more: str) -> DataFrame:
        """Of each source the piece in which its part ends, and what is left
        there.  At most BLOCKS pieces a source, or the documents of one sub-block."""
        order = Window.partitionBy("_s").orderBy(key)
        x = pieces.join(F.broadcast(left.select("_ls", "_left")), F.col("_s").eqNullSafe(F.col("_ls")))
        x = x.withColumn("_before", F.coalesce(F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        return x.where("_before < _left AND _left <= _before + _w").select("_ls", F.col(key).alias(f"_end{key}"), (F.col("_left") - F.col("_before")).alias("_left"), *more)

    @staticmethod
    def _within(rows: DataFrame, end: DataFrame, key: str) -> DataFrame:
        at = F.broadcast(end.select("_ls", f"_end{key}"))
        return rows.join(at, rows["_s"].eqNullSafe(at["_ls"]) & (rows[key] == at[f"_end{key}"])).drop("_ls", f"_end{key}")

    def of_rows(self, name: str) -> DataFrame:
        """The mix of the planned rows, with their ids by this name."""
        return self._apply(self.rows, ["_id"]).withColumnRenamed("_id", name)

    def of(self, docs: DataFrame, *more: Column) -> DataFrame:
        """The mix of docs, with more columns of theirs."""
        keyed = self._keyed(docs, *more)
        return self._apply(keyed, keyed.columns[3:])

    def _apply(self, keyed: DataFrame, more: list[str]) -> DataFrame:
        """more, ``size``, ``source_size``, ``target``, ``taken``, ``draws``."""
        x = keyed.withColumn("_b", _hash("_h", self.seed, 1))
        for k, f in enumerate(self.facts):  # at most MAX_SOURCES rows each: the broadcasts are bounded
            f = F.broadcast(f.withColumnRenamed(f.columns[0], f"_s{k}"))
            x = x.join(f, F.col("_s").eqNullSafe(F.col(f"_s{k}")), "left").drop(f"_s{k}")
        c, b, h, n = _hash("_h", self.seed, 2), F.col("_b"), F.col("_h"), F.col("_n")
        before = (b < F.col("_end_b")) | ((b == F.col("_end_b")) & ((c < F.col("_end_c")) | ((c == F.col("_end_c")) & (h < F.col("_end_d")))))
        here = (b == F.col("_end_b")) & (c == F.col("_end_c")) & (h == F.col("_end_d"))
        if self.repeated:
            # equal rows in turn take what is left, so each has a number
            ends = F.coalesce(here & (F.col("_rows") > 1), F.lit(False))
            turn = numbered_within(x.where(ends), ["_s", "_h"], "_turn").withColumn("_left3", F.greatest(F.lit(0), F.col("_left3") - F.col("_n") * (F.col("_turn") - 1))).drop("_turn")
            x = x.where(~ends).unionByName(turn)
        some = F.when(before, n).when(here, F.least(n, F.col("_left3")))

        def draw(p: Column, words: Column) -> Column:
            shard = F.size(F.filter("_cuts", lambda cut: cut <= b + p.cast("long") * BLOCKS))
            return F.struct(shard.alias("shard"), words.alias("words"), F.xxhash64(h, p, F.lit(self.seed)).alias("place"))

        none = F.array().cast(_DRAWS)
        whole = F.when(F.col("_passes") > 0, F.transform(F.sequence(F.lit(0), F.col("_passes") - 1), lambda p: draw(p, n))).otherwise(none)
        rest = F.when(some.isNotNull(), F.array(draw(F.col("_passes"), some))).otherwise(none)
        draws = F.concat(whole, rest)
        x = x.select(*more, n.alias("size"), F.col("_size").alias("source_size"), F.col("_target").alias("target"), draws.alias("draws"))
        return x.withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda all_, d: all_ + d["words"]))


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of docs: the id, ``size``, ``source_size``, ``target``,
    ``taken`` and ``draws``, an array of (shard, words, place).

    Sources in code-point order, null last, have the given weights in turn.
    size is the number of words (null text: 0).  A draw takes all words of the
    document, or its first ``words`` where the source's target ends within it.
    taken is the sum of its draws' words and never above twice the size.
    Documents without words are drawn like others, for no words.  A source of
    size 0 has target 0.  Rows are placed by id and text, so rows that repeat
    both are drawn together; where a target ends in them some are taken whole,
    one in part and the others not.
    Ids may be null; other columns are not looked at; an empty table gives no
    rows.  The same rows give the same mix in any order and partitioning."""
    return Mix(docs, id_col, **options).of_rows(id_col)


@production
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``draws`` lists shard:words:place of each draw."""
    text = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["shard"].cast("string"), d["words"].cast("string"), d["place"].cast("string"))), ",")
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", text.alias("draws"))


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its words-th word."""
    t = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
    parts = F.split(t, r"[\x20\x09-\x0D]+", words + 1)
    rest = F.when(F.size(parts) > words, F.length(F.element_at(parts, -1))).otherwise(F.lit(0))
    return F.regexp_replace(t.substr(F.lit(1), F.length(t) - rest), r"[\x20\x09-\x0D]+$", "")


@production
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each draw, with the columns of docs, in its
    shard's order.  A draw of some of a document's words has its text up to
    their end (and n_chars to match); a draw of none is left out.  Nulls, repeats
    and empty tables are treated as in ``mix``."""
    plan = Mix(docs)
    parts = max(1, -(-plan.words // (plan.shards * PART_WORDS)))
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    drawn = plan.of(docs, row).select("row", "size", F.explode("draws").alias("draw")).where("draw.words > 0 OR size = 0")
    part = F.col("draw.shard") * parts + F.pmod(F.xxhash64("draw.place"), F.lit(parts)).cast("int")
    drawn = drawn.repartitionById(plan.shards * parts, part).sortWithinPartitions("draw.place")
    text = F.when(F.col("draw.words") < F.col("size"), first_words(F.col("row.text"), F.col("draw.words").cast("int"))).otherwise(F.col("row.text"))
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return drawn.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
