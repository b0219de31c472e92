"""Importance resampling of documents towards a target distribution.

Features are words and pairs of neighbouring words, hashed into buckets.  One
pass over the documents and one over the target texts count the buckets: each
task sums its texts' counts into one vector, and a tree of tasks sums the
vectors.  A bucket's gain says how much more frequent it is in the target.  The
second pass carries the gains (80 kB) to every task and averages them over each
document's features.  A Gumbel value that hashes the document's id makes the
highest scores a draw without replacement in proportion to the weights.

Ranks come from a range-partitioned sort: a row's place in its partition and
what earlier partitions hold.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, production, table, text_of, tidy

BUCKETS = 10_000
SHARE = 25
LEAST_WORDS = 20
SEED = 7

#: Digits, lower-case letters and all above ASCII, in bytes of UTF-8.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SCORED = "doc_id long, words long, n_features long, weight long, score long"


def features(text: str, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words of a text and the bucket of each feature."""
    words = _WORD.findall(text.encode().lower())
    one = list(map(crc32, words))
    # a pair's checksum goes on from its first word's
    two = map(crc32, [b" " + w for w in words[1:]], one)
    return len(words), np.fromiter((*one, *two), np.int64, max(0, 2 * len(words) - 1)) % buckets


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket.  The driver gets one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(features(text, buckets)[1], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = docs.select(text_of(text_col).alias("t")).mapInArrow(tidy(run), "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.map(lambda r: np.frombuffer(r["counts"], np.int64)).treeReduce(np.add)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of a bucket's smoothed shares), by bucket."""
    n, of, to = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (of + n) / ((s + 1) * (to + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """A Gumbel value in thousandths, from the id; a null one is written null."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``doc_id``, ``words``, ``n_features``, ``weight`` and ``score`` of every row."""
    names = [c.split()[0] for c in _SCORED.split(", ")]
    sent = docs.sparkSession.sparkContext.broadcast(gain.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = sent.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            each = [features(t, len(value)) for t in batch.column(1).to_pylist()]
            n = np.array([len(b) for _, b in each], np.int64)
            flat = np.concatenate([*(b for _, b in each), np.zeros(0, np.int64)])
            # sums of whole numbers below 2**53: exact
            total = np.bincount(np.repeat(np.arange(len(n)), n), weights=value[flat], minlength=len(n)).astype(np.int64)
            weight = total // np.maximum(n, 1)
            luck = np.array([gumbel(i, seed) for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.asarray(x, np.int64)) for x in ([w for w, _ in each], n, weight, weight + luck))], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t")).mapInArrow(tidy(run), _SCORED)


def ranked(rows: DataFrame, *order) -> DataFrame:
    """rows with ``rank`` from 1 in this order.  Equal rows may share a
    partition's border: a number of their own parts them.  rows is read three
    times: give a written table.  The driver gets a row for each partition."""
    rows = rows.withColumn("_own", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*order, "_own").sortWithinPartitions(*order, "_own").drop("_own").withColumn("_at", F.monotonically_increasing_id())
    dealt = checkpointed(dealt)
    part = F.shiftright("_at", 33)
    sizes = sorted(tuple(r) for r in dealt.groupBy(part.alias("p")).count().collect())
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    first = dealt.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "_part long, _before long")
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    return dealt.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn("rank", F.col("_before") + place + 1).drop("_part", "_before", "_at")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document's id, ``n_features``, ``weight``, ``score`` and ``rank``.

    Of the documents with least_words words or more, share per cent are drawn:
    those with the highest scores, ties to the smaller id (a null id is the
    smallest).  Their rank counts from 1, that of all others is null.  A text
    that is null or has no word has weight 0.  Rows that repeat an id are drawn
    each on its own; among rows equal in score and id any may come first.
    Without target texts all shares are smoothed alike.  Other columns are not
    looked at; an empty table gives no rows."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, text_col, buckets))
    rows = checkpointed(scored(docs, gain, id_col, text_col, seed))
    enough = F.col("words") >= least_words
    drawn = rows.where(enough).count() * share // 100
    order = ranked(rows.where(enough), F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    order = order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return order.unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long"))).select(F.col("doc_id").alias(id_col), "n_features", "weight", "score", "rank")


@production
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
