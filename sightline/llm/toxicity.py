"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other.  Each is a logistic model of the
words and word beginnings of a text, of how often they come, and of the
probabilities of the categories before it; in training those probabilities are
out-of-fold predictions, so a later model never sees how well an earlier one knew
its own training rows.  Word beginnings let a stem count in forms that no
labelled text has, and a stem that clean texts have once by chance may be telling
when it comes again and again.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import production, release_memory, table, text_of, tidy
from .quality import crc_mod
from .textvec import Words, buffers, mix

#: Bound on the labelled rows that are fitted, lowest hash of the id first.
MAX_TRAIN = 12_000
BUCKET_BITS = 21
BUCKETS = 1 << BUCKET_BITS
PREFIXES = (3, 4, 5, 6, 7, 8)
#: A word or beginning is one feature more for each of these numbers of times.
TIMES = (2, 4, 8)
#: Features kept for each category, by chi-square on the training rows.
SELECTED = 2_000
LEAST_TEXTS = 4
FOLDS = 3
STEPS = 400
RIDGE = 1e-5
SEED = 20240607
FIT_PARTITIONS = 8


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, row)`` of every word and word beginning of a flat buffer and of
    its numbers of times, each once a row and in order."""
    w = Words(raw, off, letters_only=True)
    shift = np.uint64(64 - BUCKET_BITS)
    size = w.end - w.start
    out, rows = [w.hash >> shift], [w.doc]
    for k in PREFIXES:
        long = np.flatnonzero(size >= k)
        h = w.span_hash(w.start[long], w.start[long] + k)
        out.append(mix(h + np.uint64(k)) >> shift)
        rows.append(w.doc[long])
    both, n = np.unique(np.concatenate(rows).astype(np.int64) * BUCKETS + np.concatenate(out).astype(np.int64), return_counts=True)
    more = [both]
    for k in TIMES:
        often = both[n >= k]
        with np.errstate(over="ignore"):
            bucket = mix((often % BUCKETS).astype(np.uint64) * np.uint64(64) + np.uint64(k)) >> shift
        more.append(often - often % BUCKETS + bucket.astype(np.int64))
    both = np.unique(np.concatenate(more))
    return both % BUCKETS, both // BUCKETS


def _fit_linear(cols: np.ndarray, rows: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Logistic weights of presence features (cols at rows), of the columns of
    dense and a constant (last, without penalty), by accelerated gradient steps.

    A weight's step is the inverse of a quarter of its feature's sum over the
    rows, each times the sum of the row: no step can overshoot, however many
    features come together (features that always do would otherwise)."""
    n = len(y)
    d = dense.shape[1]
    w = np.zeros(width + d + 1)
    share = min(max(y.mean(), 1e-4), 1 - 1e-4)
    w[-1] = np.log(share / (1 - share))
    whole = np.bincount(rows, minlength=n) + np.abs(dense).sum(axis=1) + 1
    scale = np.concatenate([np.bincount(cols, weights=whole[rows], minlength=width), whole @ np.abs(dense), [whole.sum()]]) / n * 0.25 + ridge
    penalty = np.append(np.full(width + d, ridge), 0)
    ahead, t = w, 1.0
    for _ in range(steps):
        z = np.bincount(rows, weights=ahead[cols], minlength=n) + dense @ ahead[width:-1] + ahead[-1]
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.concatenate([np.bincount(cols, weights=e[rows], minlength=width), dense.T @ e, [e.sum()]]) / n + penalty * ahead
        before, w = w, ahead - g / scale
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = w + (last - 1) / t * (w - before)
    return w


def _fits(spark: SparkSession, cols: np.ndarray, rows: np.ndarray, dense: np.ndarray, y: np.ndarray, fold: np.ndarray, width: int) -> list[np.ndarray]:
    """Weights without each fold and, last, of all rows."""
    packed = spark.sparkContext.broadcast(pickle.dumps((cols.astype(np.int32), rows.astype(np.int32), dense, y, fold)))  # max_train rows of the features of one category

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, rows, dense, y, fold = pickle.loads(packed.value)
        for batch in batches:
            for f in batch.column(0).to_pylist():
                keep = fold != f
                to, mine = np.cumsum(keep) - 1, keep[rows]
                w = _fit_linear(cols[mine], to[rows[mine]], dense[keep], y[keep], width)
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["f", "w"])

    found = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(tidy(run), "f long, w binary").collect()
    packed.unpersist()
    return [np.frombuffer(r["w"]) for r in sorted(found)]


def _probability(w: np.ndarray, cols: np.ndarray, rows: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
    width = len(w) - 1 - dense.shape[1]
    z = np.bincount(rows, weights=w[:width][cols], minlength=n) + dense @ w[width:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p)) / 2


class Chain:
    """Category names, the selected buckets, a model a category.

    own: by category and selected bucket, whether the category's model looks at
    it; all do if it is left out."""

    def __init__(self, names: list[str], selected: np.ndarray, own: np.ndarray | None = None):
        self.names = names
        self.selected = selected
        self.own = np.ones((len(names), len(selected)), bool) if own is None else own
        self.models: list[np.ndarray] = []

    def place(self) -> np.ndarray:
        at = np.full(BUCKETS, -1, np.int32)
        at[self.selected] = np.arange(len(self.selected))
        return at

    def fit(self, spark: SparkSession, cols: np.ndarray, rows: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Chain:
        """Fit category after category; the folds of one, and the model of all
        rows, are a task each."""
        n, dense = len(y), np.zeros((len(y), 0))
        for c in range(len(self.names)):
            mine = self.own[c][cols]
            *of_folds, model = _fits(spark, cols[mine], rows[mine], dense, y[:, c], fold, len(self.selected))
            unseen = np.zeros(n)
            for f, w in enumerate(of_folds):
                unseen[fold == f] = _probability(w, cols, rows, dense, n)[fold == f]
            self.models.append(model)
            dense = np.column_stack([dense, _logit(unseen)])
        return self

    def predict(self, cols: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        dense, out = np.zeros((n, 0)), []
        for w in self.models:
            p = _probability(w, cols, rows, dense, n)
            out.append(p)
            dense = np.column_stack([dense, _logit(p)])
        return np.column_stack(out) if out else np.zeros((n, 0))


def _present(raw: np.ndarray, off: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Selected features present in each row, each once."""
    bucket, row = features(raw, off)
    col = at[bucket]
    hit = col >= 0
    return col[hit].astype(np.int64), row[hit]


def fit(labelled: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Chain | None:
    """A chain of the categories (0/1 columns of labelled, in this order).

    Rows with a null category are left out, and of rows that repeat id and text
    one counts.  Rows with the lowest hashes of id and text are fitted, max_train
    at most.  None if there are no rows."""
    names = [f"y{i}" for i in range(len(categories))]
    src = labelled.select(F.xxhash64(id_col, text_of(text_col)).alias("h"), *(F.col(c).cast("int").alias(n) for c, n in zip(categories, names, strict=True)), text_of(text_col).alias("t")).dropna()
    # fitted rows are few enough to be held on the executors between the passes
    cut = src.select("h").distinct().orderBy("h").limit(max_train).agg(F.max("h")).first()[0]
    if cut is None:
        return None
    src = src.where(F.col("h") <= cut)
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for _, raw, off in buffers(batch.column(batch.num_columns - 1)):
                bucket, row = features(raw, off)
                cut = np.searchsorted(row, np.arange(len(off)))
                lists.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(bucket, pa.int32())))
            found = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], "f"])

    rows = src.mapInArrow(tidy(run), f"h long, {', '.join(f'{n} int' for n in names)}, f array<int>")
    rows = rows.dropDuplicates(["h"]).coalesce(FIT_PARTITIONS).persist()  # max_train rows at most
    try:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Texts with each bucket, of all rows and by category: one row.
            A partition has max_train rows at most, so two bytes hold a number."""
            seen = np.zeros((width + 1, BUCKETS), np.uint16)
            total = np.zeros(width + 1, np.int64)
            for batch in batches:
                f = batch.column("f")
                values, size = f.flatten().to_numpy(), np.diff(f.offsets.to_numpy())
                which = np.ones((width + 1, batch.num_rows), bool)
                for c in range(width):
                    which[c + 1] = batch.column(f"y{c}").to_numpy() > 0
                for c in range(width + 1):
                    chosen = values if c == 0 else values[np.repeat(which[c], size)]
                    seen[c] += np.bincount(chosen, minlength=BUCKETS).astype(np.uint16)
                    total[c] += which[c].sum()
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(seen.tobytes(), 1)], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["seen", "total"])

        seen, total = np.zeros((width + 1, BUCKETS), np.int32), np.zeros(width + 1, np.int64)
        for r in rows.mapInArrow(tidy(count), "seen binary, total binary").toLocalIterator():  # FIT_PARTITIONS rows of a fixed size
            seen += np.frombuffer(zlib.decompress(r["seen"]), np.uint16).reshape(width + 1, BUCKETS)
            total += np.frombuffer(r["total"], np.int64)
        n = int(total[0])
        if not n:
            return None
        chosen = []
        for c in range(1, width + 1):
            can = np.flatnonzero(seen[0] >= LEAST_TEXTS)
            k, a, b = int(total[c]), seen[c][can].astype(float), seen[0][can].astype(float)
            spread = b * (n - b) * max(k, 1) * max(n - k, 1)
            chi = np.where(spread > 0, n * (a * n - b * k) ** 2 / np.maximum(spread, 1), 0)
            best = np.lexsort((can, -chi))[:SELECTED]
            chosen.append(can[best[chi[best] > 8]])
        selected = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
        chain = Chain(list(categories), selected, np.array([np.isin(selected, x) for x in chosen]).reshape(width, -1))
        packed = pickle.dumps(chain.selected)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            selected = pickle.loads(packed)
            at = np.full(BUCKETS, -1, np.int32)
            at[selected] = np.arange(len(selected))
            for batch in batches:
                f = batch.column("f")
                col = at[f.flatten().to_numpy()]
                size = np.diff(f.offsets.to_numpy())
                row = np.repeat(np.arange(batch.num_rows), size)[col >= 0]
                cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(col[col >= 0], pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=batch.schema.names)

        got = rows.mapInArrow(tidy(keep), rows.schema).toArrow()  # max_train rows of selected features
        got = got.take(np.argsort(got["h"].to_numpy(), kind="stable"))
        y = np.column_stack([got[c].to_numpy() for c in names]).astype(float)
        fold = (mix(got["h"].to_numpy().view(np.uint64)) % np.uint64(FOLDS)).astype(int)
        size = np.concatenate([np.diff(p.offsets.to_numpy()) for p in got["f"].chunks])
        at = np.repeat(np.arange(len(size)), size)
        cols = np.concatenate([p.flatten().to_numpy() for p in got["f"].chunks]).astype(np.int64)
        return chain.fit(labelled.sparkSession, cols, at, y, fold)
    finally:
        rows.unpersist()
        release_memory()


def score(docs: DataFrame, chain: Chain | None, categories: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id and ``p_<category>`` from 0 to 1 of the
    whole text; null counts as empty, and an empty text has the probabilities
    of a text without known words.  Without a chain all are 0.  Other columns
    are not looked at."""
    packed = pickle.dumps(chain)
    names = [f"p_{c}" for c in categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(packed)
        at = m.place() if m else None
        for batch in batches:
            out = [m.predict(*_present(raw, off, at), len(off) - 1) if m else np.zeros((len(off) - 1, len(names))) for _, raw, off in buffers(batch.column(1))]
            p = np.concatenate(out) if out else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, c], pa.float64()) for c in range(len(names)))], names=["id", *names])

    src = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    return src.mapInArrow(tidy(run), "id long, " + ", ".join(f"{n} double" for n in names)).withColumnRenamed("id", id_col)


#: The query's chain: the two marks that the labels have.
CATEGORIES = ["low_quality", "toxic"]


def labelled_categories(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Labelled documents with CATEGORIES; the labels are cut to max_train rows
    (lowest hash of the id first) before they are broadcast.  Of repeated labels
    of an id the worst counts; a null quality is not low."""
    low = (F.coalesce("quality", F.lit(1)) < 1).cast("int")
    rows = labels.select(F.col("doc_id").alias("_id"), low.alias("_low"), F.col("toxic").alias("_toxic")).dropna().groupBy("_id").agg(F.max("_low").alias("low_quality"), F.max((F.col("_toxic") > 0).cast("int")).alias("toxic"))
    rows = rows.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    d = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    return d.join(F.broadcast(rows), F.col("_doc") == F.col("_id")).select(F.col("_doc").alias("doc_id"), F.col("_text").alias("text"), *CATEGORIES)


@production
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id") != 1)
    chain = fit(labelled_categories(docs, labels), CATEGORIES)
    p = score(docs, chain, CATEGORIES)
    return p.select("doc_id", F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"), "p_low_quality")
