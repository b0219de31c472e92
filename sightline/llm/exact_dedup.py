"""Exact deduplication by progressive refinement, in DataFrame operations only.

A text can only equal texts of its own length, among those only texts with the
same hash of a short prefix, among those only texts with the same SHA-256:

1. one scan gives (length, prefix hash); lengths that occur once are settled;
2. of the rest, (length, prefix hash) classes with one row are settled;
3. a second scan hashes whole texts, and only rows of surviving classes are
   grouped by their full hash.

Only narrow rows (id, length, hashes) are ever shuffled, never a text.  Counts
are summed before each shuffle.  A class that holds a large share of all rows
is narrow too, and the joins back to the rows are plain sort-merge joins whose
large partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, ids_repeat, one_of_each, small, table, text_of, without

PREFIX_CHARS = 128


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of docs: the id, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``.

    Texts are equal when they are identical; null counts as the empty text, so
    nulls and empty texts form one group.  Of equal texts the row with the
    largest id stays.  Rows that repeat both id and text share that id's
    decision and each count in ``group_size``.  A row with a null id never
    stays while its group has another id; if no row has one, ``keep_id`` is
    null and all such rows are marked as kept.  Other columns of docs are not
    looked at, so their names cannot clash.  An empty table gives no rows."""
    src = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    length = F.octet_length("_t").alias("_len")
    prefix = F.xxhash64(F.substring("_t", 1, prefix_chars)).alias("_prefix")

    narrow = src.select(length, prefix)
    lengths = narrow.groupBy("_len").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_len")
    classes = narrow.join(lengths, "_len").groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_len", "_prefix", F.lit(True).alias("_open"))

    full = src.select(F.col("_id"), length, prefix, F.unhex(F.sha2("_t", 256)).alias("_full"))
    rows = full.join(classes, ["_len", "_prefix"], "left")
    groups = rows.where("_open").groupBy("_len", "_full").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    out = full.join(groups, ["_len", "_full"], "left")
    keep = F.when(F.col("_size").isNotNull(), F.col("_keep")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("_full")).alias("text_sha256"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
"""


#: Open classes that are broadcast, at most (some 50 bytes each).
BROADCAST_CLASSES = 500_000


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows of docs whose text another row has: the id, ``sha`` (binary) and
    ``kept`` as in ``exact_dedup``, and how many rows share all three.

    The first scan writes (length, prefix hash) of every row.  The second hashes
    whole texts of open classes alone while these can be broadcast, counted
    first; beyond that it hashes all and joins narrow rows, so that no text is
    shuffled either way."""
    src = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"), F.octet_length(text_of(text_col)).alias("_len"), F.xxhash64(F.substring(text_of(text_col), 1, prefix_chars)).alias("_prefix"))
    narrow = checkpointed(src.select("_len", "_prefix"))
    lengths = narrow.groupBy("_len").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_len")
    classes = checkpointed(narrow.join(lengths, "_len").groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_len", "_prefix"))
    sha = F.unhex(F.sha2("_t", 256)).alias("sha")
    if small(classes, BROADCAST_CLASSES):
        full = src.join(F.broadcast(classes), ["_len", "_prefix"], "left_semi").select("_id", "_len", sha)
    else:
        full = src.select("_id", "_len", "_prefix", sha).join(classes, ["_len", "_prefix"], "left_semi").select("_id", "_len", "sha")
    full = checkpointed(full)
    groups = full.groupBy("_len", "sha").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    rows = full.join(groups, ["_len", "sha"])
    return rows.groupBy(F.col("_id").alias(id_col), "sha", F.col("_id").eqNullSafe(F.col("_keep")).alias("kept")).agg(F.count(F.lit(1)).alias("c"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, with the columns it came with: that of the largest
    id, one with an id rather than one without, any one of several with that id.

    Where ids are unique, rows are dropped by them; else by id and SHA-256, so a
    text that is in the table once stays whatever its id.  A null text counts as
    empty.  An empty table stays empty."""
    rows = checkpointed(copies(docs))
    if not ids_repeat(docs):
        return without(docs, rows.where("not kept").select("doc_id"), [docs["doc_id"]])
    keys = [docs["doc_id"], F.unhex(F.sha2(text_of("text"), 256))]
    left = without(docs, rows.where("not kept").select("doc_id", "sha"), keys)
    return one_of_each(left, rows.where("kept AND c > 1").select("doc_id", "sha"), [left["doc_id"], keys[1]])
