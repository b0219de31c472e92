"""Best-fit packing of documents, planned over a histogram of lengths.

A first pass encodes the texts, cuts documents longer than a sequence into
pieces and counts each task's pieces by length.  The histogram has one row a
length, so the plan needs no document: lengths are taken from the longest down
and all pieces of one length go into the groups of sequences where they fit
best, many at a time.  Sequences that hold the same are one group with a count.
A row of the plan says where a range of ranks within one length goes.

Pieces then take the planned places by their rank within their length.  A rank
is a piece's place in its task plus what earlier tasks have of the length, so no
length, however frequent, is brought together or sorted.

The plan is small whatever the corpus: a length adds three groups at most, and a
group that takes as many pieces of a length as it can has less than half of its
room left, so it is used log2(capacity) times; that is at most
3 * capacity * (log2(capacity) + 1) rows, some 3 MB at 2048.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, production, table, text_of, tidy

CAPACITY = 2048
END_ID = 0
#: Places of a task are looked up in blocks of so many ranks.
BLOCK = 1024

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, task int, place long"
_OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best fit over counts of lengths, longest first.

    A row for each range of ranks within a length: length, first rank, pieces,
    first sequence, pieces in each of its sequences, offset in them; in the order
    of length and first rank."""
    rows: list[tuple[int, ...]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # by room left: (first sequence, sequences)
    rooms: list[int] = []
    opened = 0

    def keep(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                insort(rooms, left)
            room.setdefault(left, []).append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
            else:
                left, first, n = capacity, opened, -(-todo // (capacity // length))
                opened += n
            # best fit goes on in a sequence that it has begun: no other fits tighter
            each = left // length
            whole = min(n, todo // each)
            if whole:
                rows.append((length, rank, whole * each, first, each, capacity - left))
                keep(left - each * length, first, whole)
                todo, rank, first, n = todo - whole * each, rank + whole * each, first + whole, n - whole
            if n and todo:
                rows.append((length, rank, todo, first, each, capacity - left))
                keep(left - todo * length, first, 1)
                todo, first, n = 0, first + 1, n - 1
            keep(left, first, n)
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def _pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """The pieces of every document with the task that cut each and its place
    among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .wordpieces import word_encoder

        encoder, task = word_encoder(path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows, tokens = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encoder.encode(text), np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)]))
                    seen[len(part)] += 1
                    tokens.append(part if with_ids else None)
            doc, piece, start, length, crc, of, place = zip(*rows, strict=True) if rows else [()] * 7
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [long(doc), pa.array(piece, pa.int32()), long(start), long(length), long(crc), pa.array([x if x is None else x.astype(np.int32) for x in tokens], pa.list_(pa.int32())), pa.array(of, pa.int32()), long(place)],
                names=[c.split()[0] for c in _PIECES.split(", ")],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t")).mapInArrow(tidy(run), _PIECES)


def best_fit_pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: the id, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``, and with_ids also its ``ids``.

    A document is its text's ids and then end_id, so a null or empty text has one
    token.  Only a document longer than capacity is cut, after every capacity
    tokens; its last piece is packed like a short document.  Sequences are
    numbered from 0 without a gap, and in each the pieces lie without a gap from
    offset 0.  Rows that repeat an id are documents of their own.  Ids may be
    null; other columns are not looked at; an empty table gives no rows.
    tokenizer: a file for the tokenizers library that executors have too."""
    pieces = checkpointed(_pieces(docs, tokenizer or default_tokenizer(), id_col, text_col, capacity, end_id, with_ids))
    counted = checkpointed(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    total = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()  # capacity rows at most
    planned = plan({r["length"]: r["n"] for r in total}, capacity)

    # what earlier tasks have of a length: a length has one row a task here
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    first = counted.select("task", "length", "n", F.coalesce(before, F.lit(0)).alias("before"))
    # a frequent length of a task is many keys here
    blocks = first.select("task", "length", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}"))).alias("block"))
    ranked = pieces.withColumn("block", F.expr(f"place div {BLOCK}")).join(blocks, ["task", "length", "block"])
    names = [c.split()[0] for c in _OUT.split(", ")]
    starts = planned[:, 0] << 42 | planned[:, 1]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = planned[np.searchsorted(starts, length << 42 | rank, side="right") - 1]
            k = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-2]), pa.array(row[:, 3] + k // row[:, 4]), pa.array(row[:, 5] + k % row[:, 4] * length)], names=names)

    out = ranked.select(*names[:-2], (F.col("before") + F.col("place")).alias("rank")).mapInArrow(places, _OUT)
    return (out if with_ids else out.drop("ids")).withColumnRenamed("doc_id", id_col)


@production
def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))
