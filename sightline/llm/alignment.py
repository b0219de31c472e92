"""Alignment of two tokenizers' tokens over the same text.

Both tokenizers cut a text's bytes without a gap.  The B tokens' ranges are a
static interval index (their starts and ends, in order), and each A token asks
it by two bisections for the B tokens that its range overlaps.  A gap between
two A tokens that no B token spans is a boundary between groups: there both
tokenizers have cut.  A batch of documents is one row of bytes, so a few passes
serve all of them.

How many documents link a pair of ids is a property of the corpus.  Pairs are
counted once a document, and a document's links look their pair's count up
again; the pairs are kept in a written table between the two, so texts are
encoded once.  What is looked up grows with the vocabularies, not with the
rows: it is broadcast up to a counted bound and joined by a shuffle beyond.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, production, scratch, small, table, text_of, tidy
from .tokens import _SHOWN

#: Id pairs that are broadcast, at most (some 60 bytes each).
BROADCAST_PAIRS = 2_000_000
#: Texts of one numpy pass, and their characters (a longer text is one pass).
PASS_TEXTS, PASS_CHARS = 256, 1 << 20
TASK_SPAN = 1 << 40

_OUT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>, pair_a array<int>, pair_b array<int>, pair_links array<int>"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Tokens of both kinds and their links, for one worker process."""

    def __init__(self, a_path: str, b_path: str):
        from .tokens import Encoder
        from .wordpieces import sentence_encoder

        self.a, self.b = Encoder(a_path), sentence_encoder(b_path)
        byte = {c: b for b, c in _SHOWN.items()} | {chr(b): b for b in range(256) if b not in _SHOWN}
        entry = {i: bytes(byte[c] for c in x) for x, i in self.a.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [entry.get(i, b"") for i in range(max(entry) + 1)]
        self.b_bytes = self.b.bytes
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.top = max(len(self.a_bytes), len(self.b_bytes))
        number = [str(i).encode() for i in range(self.top)]
        #: An id as it stands before another of its list, at an A list's end, at a group's end.
        self.shown = [x + mark for mark in (b",", b"|", b";") for x in number]

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text; none where it is null, empty or not what its tokens spell."""
        none = np.zeros(0, np.uint32)
        a = self.a.encode([" " + t if t else "" for t in texts])
        b = [self.b.encode(t or "") for t in texts]
        for i, t in enumerate(texts):
            raw = (" " + t).encode() if t else b""
            if not t or b"".join(map(self.a_bytes.__getitem__, a[i].tolist())) != raw or b"".join(map(self.b_bytes.__getitem__, b[i].tolist())) != raw:
                a[i] = b[i] = none
        return a, b

    def align(self, texts: list[str | None]) -> dict[str, object]:
        """Columns of the output but for the row and its id, as numpy arrays and
        (offsets, values) pairs."""
        a_of, b_of = self.encode(texts)
        n_a, n_b = (np.array([len(x) for x in y], np.int64) for y in (a_of, b_of))
        a, b = (np.concatenate([*y, np.zeros(0, np.uint32)]).astype(np.int64) for y in (a_of, b_of))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_start, b_start = a_end - self.a_size[a], b_end - self.b_size[b]
        # the B tokens that each A token overlaps: from the first that ends after its start to the last that starts before its end
        low = np.searchsorted(b_end, a_start, side="right")
        high = np.searchsorted(b_start, a_end, side="left")
        # the gap after an A token is not spanned if the next one's B tokens are others
        cut = high == np.append(low[1:], len(b))
        a_ends = np.flatnonzero(cut) + 1
        b_ends = high[cut]
        first_a, first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        doc_a = np.repeat(np.arange(len(texts)), n_a)
        n_groups = np.bincount(doc_a[a_ends - 1], minlength=len(texts))
        # links, and each document's different pairs
        many = high - low
        link_a = np.repeat(np.arange(len(a)), many)
        link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(many) - many - low, many)
        n_links = np.bincount(doc_a[link_a], minlength=len(texts))
        pair, links = np.unique((doc_a[link_a] * self.top + a[link_a]) * self.top + b[link_b], return_counts=True)
        of = pair // (self.top * self.top)
        pairs = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])
        groups = np.concatenate([[0], np.cumsum(n_groups)])
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": self._digests(a, b, a_ends, b_ends, first_a + first_b),
            "a_ids": (first_a, a), "b_ids": (first_b, b), "a_ends": (groups, a_ends - np.repeat(first_a[:-1], n_groups)), "b_ends": (groups, b_ends - np.repeat(first_b[:-1], n_groups)),
            "pair_a": (pairs, pair // self.top % self.top), "pair_b": (pairs, pair % self.top), "pair_links": (pairs, links),
        }

    def _digests(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, first: np.ndarray) -> list[str]:
        """sha256 of each text's groups; a group's A tokens stand before its B tokens."""
        size_a, size_b = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
        shown = np.empty(len(a) + len(b), np.int64)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[a_ends - 1], mark_b[b_ends - 1] = self.top, 2 * self.top
        shown[np.arange(len(a)) + np.repeat(b_ends - size_b, size_a)] = a + mark_a
        shown[np.arange(len(b)) + np.repeat(a_ends, size_b)] = b + mark_b
        text = list(map(self.shown.__getitem__, shown.tolist()))
        return [hashlib.sha256(b"".join(text[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


@cache
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def align(docs: DataFrame, a_tokenizer: str | None = None, b_tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``row`` (a number of its own), the id, ``n_a``,
    ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``; the ids ``a_ids`` and
    ``b_ids``; ``a_ends`` and ``b_ends``, where each group ends in them; and its
    different linked id pairs ``pair_a``, ``pair_b`` with their ``pair_links``.

    A is encoded with a blank before the text, B puts one there itself; strings
    of special tokens are ordinary text.  A text that is null or empty, or that
    its tokens do not spell byte by byte, has no tokens: zeros, empty lists and
    an empty digest.  Rows that repeat an id are documents of their own.  Ids may be
    null; other columns are not looked at; an empty table gives no rows.
    Tokenizers are files that executors have too: one of the tokenizers library
    (byte level), one of sentencepiece."""
    a_path, b_path = default_tokenizers()
    a_path, b_path = a_tokenizer or a_path, b_tokenizer or b_path
    fields = [(c.split()[0], {"long": pa.int64(), "string": pa.string()}.get(c.split()[1], pa.list_(pa.int32()))) for c in _OUT.split(", ")]

    def passes(texts: list[str | None]) -> Iterator[tuple[int, int]]:
        first, chars = 0, 0
        for i, t in enumerate(texts):
            chars += len(t or "")
            if chars >= PASS_CHARS or i - first + 1 == PASS_TEXTS or i + 1 == len(texts):
                yield first, i + 1
                first, chars = i + 1, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = _aligner(a_path, b_path), TaskContext.get().partitionId() * TASK_SPAN
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in passes(texts):
                out = aligner.align(texts[i:j]) | {"row": np.arange(row, row + j - i), "doc_id": batch.column(0).slice(i, j - i)}
                row += j - i
                column = lambda x, kind: pa.ListArray.from_arrays(pa.array(x[0], pa.int32()), pa.array(x[1], pa.int32())) if isinstance(x, tuple) else x if isinstance(x, pa.Array) else pa.array(x, kind)
                yield pa.RecordBatch.from_arrays([column(out[n], kind) for n, kind in fields], schema=pa.schema(fields))

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(tidy(run), _OUT).withColumnRenamed("doc_id", id_col)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a``, ``b``, ``docs`` (how many documents link them) and ``best``, whether
    that is the highest of the A id.  An A id has at most a row for each B id."""
    pairs = aligned.select(F.explode(F.arrays_zip("pair_a", "pair_b")).alias("p"))
    counted = pairs.groupBy(F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b")).agg(F.count(F.lit(1)).alias("docs"))
    return counted.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a")))


def link_counts(aligned: DataFrame) -> DataFrame:
    """aligned with ``n_best``, its links whose pair's count is the A id's
    highest, and ``count_sum``, the sum of counts over its links.

    aligned is read twice: give a written table."""
    counts = checkpointed(pair_counts(aligned)).select("a", "b", "docs", "best")
    counts = F.broadcast(counts) if small(counts, BROADCAST_PAIRS) else counts
    pairs = aligned.select("row", F.explode(F.arrays_zip("pair_a", "pair_b", "pair_links")).alias("p")).select("row", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_links").cast("long").alias("links"))
    sums = pairs.join(counts, ["a", "b"]).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("docs") * F.col("links")).alias("count_sum"))
    return aligned.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])


@production
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/aligned"
    align(table(spark, sf_dir, "documents")).drop("a_ids", "b_ids", "a_ends", "b_ends").write.option("compression", "zstd").parquet(folder)
    return link_counts(spark.read.parquet(folder)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
