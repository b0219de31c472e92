"""Quality classifier: random Fourier features, ridge, isotonic calibration.

A text is described by shape statistics of its characters and words.  Random
Fourier features of the scaled statistics approximate a Gaussian kernel; ridge
weights come from normal equations summed by partition; the raw score is made a
probability by isotonic regression on rows that the weights have not seen.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import production, table, text_of, tidy
from .textvec import Words, buffers

#: Bound on the labelled rows that are fitted, lowest hash of the id first.
MAX_TRAIN = 20_000
FEATURES = 256
RIDGE = 1e-2
WIDTH = 3.0
SEED = 20240607
FIT_PARTITIONS = 8

STATISTICS = (
    "log_words", "word_length", "word_length_sd", "letters", "upper", "digits", "marks", "white", "ends", "double_marks",
    "alone_marks", "repeats", "distinct", "common", "longest_run", "high", "lines", "all_upper",
)


def _by_text(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of the values between cuts; empty stretches are 0."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[cut[1:]] - total[cut[:-1]]


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text of a flat buffer."""
    n = len(off) - 1
    w = Words(raw, off)
    size = np.diff(off).astype(float)
    chars = np.maximum(size, 1)
    kind = np.zeros(256, np.uint8)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 1, 2, 3, 4
    kind[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 5
    k = kind[raw]
    share = lambda mask: _by_text(mask, off) / chars
    upper, lower, digit, high, mark = (k == 1, k == 2, k == 3, k == 4, k == 5)
    pair = np.zeros(len(raw), bool)
    if len(raw):
        pair[1:] = mark[1:] & mark[:-1]
    count = w.count().astype(float)
    words = np.maximum(count, 1)
    length = (w.end - w.start).astype(float)
    mean = _by_text(length, w.first) / words
    var = np.maximum(_by_text(length * length, w.first) / words - mean * mean, 0)
    same = np.zeros(len(w.hash), bool)
    if len(same):
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    distinct, common, longest = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if a == b:
            continue
        _, c = np.unique(w.hash[a:b], return_counts=True)
        distinct[i], common[i] = len(c) / (b - a), c.max() / (b - a)
        if b - a > 1 and same[a + 1 : b].any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], same[a:b].view(np.int8), [0]])))
            longest[i] = (edge[1::2] - edge[::2]).max()
    last_mark = mark[w.end - 1] if len(w.end) else np.zeros(0, bool)
    alone = (length == 1) & last_mark
    letters_upper = _by_text(upper, off)
    letters = letters_upper + _by_text(lower, off) + _by_text(high, off) / 2
    lines = _by_text(raw == 10, off)
    return np.column_stack([
        np.log1p(count), np.log1p(mean), np.log1p(np.sqrt(var)), share(upper | lower | high), share(upper), share(digit), share(mark), share((raw <= 32)),
        _by_text(last_mark, w.first) / words, share(pair), _by_text(alone, w.first) / words, _by_text(same, w.first) / words, distinct + 0.1 * np.log1p(count),
        common, np.log1p(longest), share(high), lines / words, letters_upper / np.maximum(letters, 1),
    ]).reshape(n, len(STATISTICS))


class Model:
    """Scale of the statistics, random features, ridge weights, calibration."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.direction = rng.normal(0, 1 / width, (len(mean), features))
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.weight: np.ndarray | None = None
        self.x, self.y = np.array([0.0]), np.array([0.5])

    def transform(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.sd, -6, 6)
        return np.column_stack([np.ones(len(z)), np.cos(z @ self.direction + self.phase) * np.sqrt(2 / len(self.phase))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.transform(stats) @ self.weight

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.x, self.y), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots of the fitted step function's blocks."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + c, blocks[-1][2] + t]
    return np.array([t / c for _, c, t in blocks]), np.array([s / c for s, c, _ in blocks])


def crc_mod(id_col: str, n: int = 3) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def _described(docs: DataFrame, id_col: str, text_col: str, more: list[str | Column]) -> DataFrame:
    """id, more and the array of statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [s for _, raw, off in buffers(batch.column(batch.num_columns - 1)) for s in statistics(raw, off).tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "stats"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), *more, text_of(text_col).alias("t"))
    kinds = ", ".join(f"{c} {t}" for c, t in src.dtypes[:-1])
    return src.mapInArrow(tidy(run), f"{kinds}, stats array<double>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, features: int = FEATURES, ridge: float = RIDGE) -> Model | None:
    """A model of the labelled rows given, or None if there are none.

    Rows with a null id or label are left out; of repeated labels of an id the
    largest counts, and of rows that repeat id and text one.  The training rows
    are those with the lowest hashes of their ids, then of id and text, max_train
    at most."""
    rows = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("double").alias("_y")).dropna().groupBy("_id").agg(F.max("_y").alias("_y"))
    rows = rows.orderBy(F.xxhash64("_id"), "_id").limit(max_train)  # bounded, so broadcast
    docs = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("_text"))
    joined = docs.join(F.broadcast(rows), F.col("_doc") == F.col("_id")).withColumn("_fold", F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(4)))
    data = _described(joined, "_doc", "_text", ["_y", "_fold", F.xxhash64("_doc", text_of("_text")).alias("_h")])
    data = data.dropDuplicates(["_h"]).orderBy("_h").limit(max_train)
    data = data.repartition(FIT_PARTITIONS).persist()  # so few normal equations reach the driver
    try:
        n = len(STATISTICS)
        sums = data.select(F.count(F.lit(1)).alias("c"), *(e for i in range(n) for e in (F.sum(F.col("stats")[i]).alias(f"s{i}"), F.sum(F.col("stats")[i] * F.col("stats")[i]).alias(f"q{i}")))).first()
        if not sums["c"]:
            return None
        mean = np.array([sums[f"s{i}"] for i in range(n)]) / sums["c"]
        sd = np.sqrt(np.maximum(np.array([sums[f"q{i}"] for i in range(n)]) / sums["c"] - mean**2, 0))
        model = Model(mean, sd, features)

        def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The partition's share of the normal equations, as one row."""
            a, b = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
            for batch in batches:
                if not batch.num_rows:
                    continue
                z = model.transform(np.array(batch.column("stats").to_pylist()).reshape(-1, n))
                y = batch.column("_y").to_numpy(zero_copy_only=False)
                a += z.T @ z
                b += z.T @ y
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["a", "b"])

        def solve(part: DataFrame) -> np.ndarray:
            parts = part.select("stats", "_y").mapInArrow(tidy(normal), "a binary, b binary").collect()  # FIT_PARTITIONS rows
            a = sum(np.frombuffer(r["a"]).reshape(features + 1, features + 1) for r in parts)
            b = sum(np.frombuffer(r["b"]) for r in parts)
            return np.linalg.solve(a + ridge * np.eye(features + 1), b)

        model.weight = solve(data.where("_fold <> 0"))
        held = data.where("_fold = 0").select("stats", "_y").collect()  # a quarter of max_train rows at most
        if len(held) >= 8:
            model.x, model.y = isotonic(model.raw(np.array([r["stats"] for r in held])), np.array([r["_y"] for r in held]))
            if len(model.x) == 1:
                model.x, model.y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        else:
            model.x, model.y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
            model.weight = solve(data)
        return model
    finally:
        data.unpersist()


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id and ``score`` from 0 to 1, of the whole
    text; null counts as empty, and empty texts have a score as well.  Without
    a model each score is 0.5.  Other columns are not looked at."""
    packed = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(packed)
        for batch in batches:
            out = [m.score(statistics(raw, off)) if m else np.full(len(off) - 1, 0.5) for _, raw, off in buffers(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], names=["id", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    return src.mapInArrow(tidy(run), "id long, score double").withColumnRenamed("id", id_col)


def learnable(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labelled rows that are not held out."""
    return labels.where(crc_mod(id_col) != 1)


@production
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, learnable(table(spark, sf_dir, "labels")))
    held = F.coalesce(crc_mod("doc_id") == 1, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@production
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject (score below 0.5), with
    all their columns.  Null and empty texts are scored like others, a score of
    0.5 stays, every row is judged on its own, and without labels all stay."""
    model = fit(docs, learnable(table(spark, sf_dir, "labels")))
    packed = pickle.dumps(model)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(packed)
        for batch in batches:
            out = [m.score(statistics(raw, off)) >= 0.5 if m else np.ones(len(off) - 1, bool) for _, raw, off in buffers(batch.column(at).cast(pa.string()))]
            yield batch.filter(pa.array(np.concatenate(out) if out else np.zeros(0, bool)))

    return docs.mapInArrow(tidy(run), docs.schema)
