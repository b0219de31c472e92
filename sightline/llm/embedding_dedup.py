"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its NEAREST reference points (pivots) in order of
distance.  Close vectors share pivots, so candidates are vectors with at least
two of them in common.  An inverted list holds the vectors with a pivot and,
besides it, one of a bucket of higher pivots; a vector is in a list once.  Each
pair of vectors is judged in the list of its two smallest shared pivots only, by
the number of shared pivots and the exact cosine in double precision.

Equal vectors are one node with a count.  A list longer than a tile is dealt
into tiles, and every two tiles meet in a group of their own, so no task holds a
long list.  Groups give counts and a spanning forest of their links, never the
links.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, connected_components, no_rows, production, small, table, tidy

THRESHOLD = 0.95
NEAREST = 6
PIVOTS = 256
MOST_PIVOTS = 4096
#: Pivots come from so many vectors, those with the lowest hashes of their ids.
SAMPLE = 4096
#: Two pivots are never closer than this.
PIVOTS_APART = 0.9
#: Vectors wanted in a list of two pivots and in one of a bucket, on average,
#: when the numbers of pivots and buckets are chosen.
PAIR_LIST, LIST = 512, 1024
#: Bytes of the doubles of a tile: many rows, so that few copies of a vector are
#: needed, and few enough for a task's memory.
TILE_BYTES = 4 << 20
SEED = 20240607
BROADCAST_LISTS = 100_000


def choose_pivots(sample: np.ndarray, count: int, seed: int = SEED) -> np.ndarray:
    """Unit pivots: rows of the sample that are not close to an earlier one,
    then random directions while there are too few."""
    kept = np.zeros((0, sample.shape[1]))
    for row in sample:
        if len(kept) >= count:
            break
        if not len(kept) or (kept @ row).max() < PIVOTS_APART:
            kept = np.vstack([kept, row])
    if len(kept) < count:
        extra = np.random.default_rng(seed).normal(size=(count - len(kept), sample.shape[1]))
        kept = np.vstack([kept, extra / np.linalg.norm(extra, axis=1, keepdims=True)])
    return kept


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Unit vectors of finite rows other than zero, also of extreme lengths."""
    with np.errstate(over="ignore"):
        size = np.linalg.norm(x, axis=1)
    odd = ~np.isfinite(size) | (size < 1e-150)
    if odd.any():
        x = x.copy()
        x[odd] /= np.abs(x[odd]).max(axis=1, keepdims=True)
        size = np.linalg.norm(x, axis=1)
    return x / size[:, None]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, k: int = NEAREST) -> np.ndarray:
    """The k nearest pivots of each unit row, nearest first."""
    k = min(k, len(pivots))
    s = x @ pivots.T
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, axis=1), axis=1, kind="stable"), axis=1)


def group_links(x: np.ndarray, pivots: np.ndarray, weight: np.ndarray, first: int, bucket: int, buckets: int, side: np.ndarray | None, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Weight of the links counted in this group, and each row's root in their
    forest.

    pivots: ascending pivots of each row.  weight: rows that a node stands for.
    first, bucket: the list's pivot and the bucket of the second.  side: for two
    tiles, which tile a row is of; then only pairs across count."""
    n = len(x)
    count, root = np.zeros(n, np.int64), np.arange(n)
    left = np.arange(n) if side is None else np.flatnonzero(~side)
    right = np.arange(n) if side is None else np.flatnonzero(side)
    step = max(1, (1 << 21) // max(len(right), 1))
    for a in range(0, len(left), step):
        rows = left[a : a + step]
        others = right[a:] if side is None else right
        i, j = np.nonzero(x[rows] @ x[others].T >= threshold)
        i, j = rows[i], others[j]
        if side is None:
            i, j = i[i < j], j[i < j]
        for b in range(0, len(i), 1 << 16):
            p, q = i[b : b + (1 << 16)], j[b : b + (1 << 16)]
            rank = np.cumsum((pivots[p][:, :, None] == pivots[q][:, None, :]).any(axis=2), axis=1)
            at = np.arange(len(p))
            one, two = pivots[p][at, np.argmax(rank >= 1, axis=1)], pivots[p][at, np.argmax(rank >= 2, axis=1)]
            mine = (rank[:, -1] >= 2) & (one == first) & (two % buckets == bucket)
            p, q = p[mine], q[mine]
            np.add.at(count, p, weight[q])
            np.add.at(count, q, weight[p])
            _unite(root, p, q)
    return count, root


def _unite(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Put the links into the forest; every row's root is its root's root."""
    a, b = root[p], root[q]
    links = np.unique(np.column_stack([a, b])[a != b], axis=0)
    for u, v in links.tolist():
        while root[u] != u:
            u = root[u]
        while root[v] != v:
            v = root[v]
        root[max(u, v)] = min(u, v)
    if len(links):
        while (root[root] != root).any():
            root[:] = root[root]


def _matrix(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, values)`` of the lists of each length."""
    at = lists.offsets.to_numpy().astype(np.int64)
    values, size = lists.values.to_numpy(zero_copy_only=False), np.diff(at)
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        yield rows, values[at[rows][:, None] + np.arange(d)]


def list_keys(pivots: np.ndarray, buckets: int, length: int) -> pa.ListArray:
    """The lists of each row of ascending pivots, each once."""
    pair = np.array(list(combinations(range(pivots.shape[1]), 2)), np.int64).reshape(-1, 2)
    first, second = pivots[:, pair[:, 0]].astype(np.int64), pivots[:, pair[:, 1]].astype(np.int64)
    keys = np.sort((np.int64(length) << 32) + first * (1 << 16) + second % buckets, axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(new.sum(axis=1))]), pa.int32()), pa.array(keys[new]))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, pivots: int | None = None, nearest: int = NEAREST, tile: int | None = None) -> DataFrame:
    """One row per row of vectors: the id, ``n_links``, ``component_id``,
    ``kept``.

    Rows link when the cosine of their vectors is threshold or more.  A vector
    that is null, empty, zero or holds a null or non-finite component links with
    nothing, and vectors of different lengths don't link.  component_id is the
    smallest id reachable by links, itself included.  Rows that repeat an id are
    one vertex: their links are summed up and they share the result, and a link
    between them counts for both.  Rows with a null id link with nothing and are
    kept.  Other columns are not looked at; an empty table gives no rows.

    The index is fitted on SAMPLE vectors and holds every row.  A link between
    vectors that share fewer than two of their nearest pivots is missed; see the
    README for the measured recall."""
    single = isinstance(vectors.schema[vector_col].dataType, T.ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    number = np.float32 if single else np.float64
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    usable = src.where("id IS NOT NULL AND size(v) > 0 AND NOT exists(v, c -> c IS NULL OR isnan(c) OR abs(c) = double('Infinity')) AND exists(v, c -> c <> 0)")
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()["v"].combine_chunks()
    base = src.select("id")
    alone = base.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not len(sample):
        return alone
    rows = usable.count()
    if pivots is None:
        pairs = nearest * (nearest - 1) / 2
        pivots = int(min(MOST_PIVOTS, max(PIVOTS, np.ceil(np.sqrt(2 * pairs * rows / PAIR_LIST)))))
    buckets = int(min(pivots, max(1, np.ceil((nearest - 1) * rows / pivots / LIST))))
    known = {x.shape[1]: choose_pivots(unit_rows(x.astype(np.float64)), pivots) for _, x in _matrix(sample)}
    tile = tile or max(256, TILE_BYTES // (8 * max(known)))
    packed = vectors.sparkSession.sparkContext.broadcast(pickle.dumps(known))  # MOST_PIVOTS vectors at most for each length in the sample

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pickle.loads(packed.value)
        for batch in batches:
            for which, raw in _matrix(batch.column(1)):
                d = raw.shape[1]
                if d not in of:
                    of[d] = choose_pivots(np.zeros((0, d)), pivots)
                raw = raw.astype(number) + number(0)  # no negative zeros
                near = np.sort(nearest_pivots(unit_rows(raw.astype(np.float64)), of[d], nearest), axis=1).astype(np.int32)
                data = [r.tobytes() for r in raw]
                k = pa.array([blake2b(r, digest_size=16).digest() for r in data], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), k, pa.array(data, pa.binary()), pa.array([r.tobytes() for r in near], pa.binary()), list_keys(near, buckets, d)], names=["id", "k", "x", "p", "keys"])

    described = checkpointed(usable.mapInArrow(tidy(describe), "id long, k binary, x binary, p binary, keys array<long>"))
    nodes = checkpointed(described.groupBy("k").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"), F.any_value("x").alias("x"), F.any_value("p").alias("p"), F.any_value("keys").alias("keys")))
    lists = nodes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    long = checkpointed(lists.where(F.col("c") > tile).select("key", F.ceil(F.col("c") / tile).cast("int").alias("tiles")))
    long = F.broadcast(long) if small(long, BROADCAST_LISTS) else long
    members = nodes.select("k", "rep", "m", "x", "p", F.explode("keys").alias("key")).join(long, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    members = members.withColumn("t", F.pmod(F.xxhash64("k", F.lit(SEED)), F.col("tiles")).cast("int"))
    members = members.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    groups = members.select("key", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "t", "k", "rep", "m", "x", "p")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch], key: int, i: int, j: int) -> pa.RecordBatch:
            g = pa.Table.from_batches(held).combine_chunks()
            has = np.zeros(0, np.int64)
            count, root = has, has
            if g.num_rows > 1:
                g = g.take(pa.compute.sort_indices(g["k"]))
                x = unit_rows(np.frombuffer(b"".join(g["x"].to_pylist()), number).reshape(g.num_rows, -1).astype(np.float64))
                p = np.frombuffer(b"".join(g["p"].to_pylist()), np.int32).reshape(g.num_rows, -1)
                side = g["t"].to_numpy() == j if i != j else None
                count, root = group_links(x, p, g["m"].to_numpy(), (key >> 16) & 0xFFFF, key & 0xFFFF, buckets, side, threshold)
                has = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays([g["k"].combine_chunks().take(pa.array(has, pa.int64())), pa.array(count[has], pa.int64()), *(pa.array(g["rep"].to_numpy()[r], pa.int64()) for r in (has, root[has]))], names=["k", "n", "a", "b"])

        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            k = np.column_stack([batch.column(c).to_numpy() for c in range(3)]) if batch.num_rows else np.zeros((0, 3), np.int64)
            cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                at = tuple(k[a].tolist())
                if now is not None and at != now:
                    yield done(held, *now)
                    held = []
                now = at
                held.append(batch.slice(a, b - a))
        if held:
            yield done(held, *now)

    found = checkpointed(groups.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(tidy(link), "k binary, n long, a long, b long"))
    copies = nodes.select("k", "rep", "m")
    if no_rows(found) and no_rows(copies.where("m > 1")):
        return alone
    links = copies.join(found.groupBy("k").agg(F.sum("n").alias("n")), "k", "left").select("k", "rep", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"))
    rows = checkpointed(described.select("id", "k").join(links, "k"))
    edges = found.select("a", "b").unionByName(rows.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    comp = connected_components(edges).withColumnRenamed("node", "id")
    out = base.join(rows.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").join(comp, "id", "left")
    own = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


@production
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
