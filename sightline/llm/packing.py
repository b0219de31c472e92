"""Harmonic packing of documents into fixed-length training sequences.

A piece of l tokens is of class j if C/(j+1) < l <= C/j for sequences of C
tokens, and a sequence of class j holds exactly j pieces.  A full sequence is
class 1.  What is left of a document is cut at most CUTS times at the lower
bound of its class, which fills that place of class j+1 without a gap, so only
a document's last, small piece leaves a gap, of less than C/(j(j+1)).

Each task fills the sequences of its own documents, so nothing is shuffled and
a task that runs again gives the same sequences.  A task holds at most one open
sequence a class; at its end the pieces of open sequences are laid end to end,
which leaves one part-filled sequence a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import production, table, text_of, tidy

CAPACITY = 2048
CUTS = 2
END_ID = 1
#: Sequences of a task have ids from its partition times this.
TASK_SPAN = 1 << 40

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_points(tokens: int, capacity: int = CAPACITY, cuts: int = CUTS) -> list[int]:
    """Where a document's pieces end: full sequences first, then the rest."""
    ends = list(range(capacity, tokens + 1, capacity))
    at = ends[-1] if ends else 0
    rest = tokens - at
    for _ in range(cuts):
        j = capacity // rest if rest else 0
        if not rest or rest == capacity // j:
            break
        size = capacity // (j + 1)
        if size == 0:
            break
        at += size
        ends.append(at)
        rest -= size
    if rest:
        ends.append(at + rest)
    return ends


class Packer:
    """The open sequences of one task; rows come out as sequences fill."""

    def __init__(self, capacity: int, cuts: int, first: int):
        self.capacity, self.cuts, self.sequence = capacity, cuts, first
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        begin = 0
        for end in cut_points(len(ids), self.capacity, self.cuts):
            piece = (doc_id, begin, ids[begin:end].copy(), len(ids))
            j = self.capacity // (end - begin)
            held = self.open.setdefault(j, [])
            held.append(piece)
            if len(held) == j:
                self._emit(self.open.pop(j))
            begin = end

    def _emit(self, held: list[tuple]) -> None:
        at = 0
        for doc_id, begin, ids, total in held:
            self.rows.append((doc_id, begin, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def close(self) -> None:
        held: list[tuple] = []
        room = self.capacity
        for j in sorted(self.open):
            for doc_id, begin, ids, total in self.open[j]:
                while len(ids):
                    held.append((doc_id, begin, ids[:room], total))
                    begin, ids, room = begin + len(ids[:room]), ids[room:], room - len(ids[:room])
                    if not room:
                        self._emit(held)
                        held, room = [], self.capacity
        if held:
            self._emit(held)
        self.open = {}


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, cuts: int = CUTS) -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``.

    A document is its text's ids and then end_id, so a null or empty text has
    one token.  Every id lies in exactly one piece; in a sequence the pieces
    lie without a gap from offset 0.  Rows that repeat an id are documents of
    their own.  A very long text is encoded as a whole and cut.  Ids may be
    null; other columns are not looked at; an empty table gives no rows.
    tokenizer: a file for the tokenizers library that executors have too."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder as shared

        encoder = shared(path)
        packer = Packer(capacity, cuts, TaskContext.get().partitionId() * TASK_SPAN)

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [()] * len(_ARROW)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            step = 256
            for k in range(0, len(ids), step):
                texts = batch.column(1).slice(k, step).to_pylist()
                for doc_id, x in zip(ids[k : k + step], encoder.encode(texts), strict=True):
                    packer.add(doc_id, np.append(x, np.uint32(end_id)))
            yield rows()
        packer.close()
        yield rows()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t"))
    return src.mapInArrow(tidy(run), SCHEMA).withColumnRenamed("doc_id", id_col)


@production
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@production
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
