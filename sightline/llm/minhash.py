"""Near-duplicate documents by fast similarity sketching.

A document's set is its distinct five-word shingles.  Its sketch has one value
a bin: round after round every shingle is thrown into one bin by that round's
hash, and a bin keeps the least value of the first round that reached it; after
as many rounds as there are bins, round T+i throws every shingle into bin i, so
every bin of a nonempty set fills.  Two sketches agree in a share of bins that
concentrates around the Jaccard similarity.

Sketches are cut into bands.  Documents with equal sets are one node.  Nodes
that share a band are candidates, confirmed on their full sets.  Only links
that components need are looked for: every node is compared with two leaders of
each of its bands; bands whose nodes are of several components after that are
settled in blocks of bounded size, which compare all their sets and give a link
only where it joins two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, ids_repeat, no_rows, one_of_each, production, table, text_of, tidy, without
from .textvec import Words, buffers, distinct, mix, shingles

WIDTH = 5
THRESHOLD = 85
BANDS, ROWS = 24, 5
BINS = BANDS * ROWS
#: Largest filter over candidate ids, in bits (8 MB); a fuller one only lets
#: more documents be shingled a second time.
FILTER_BITS = 26
#: A tile of a crowded band has about so many shingles and nodes at most.
BLOCK_SHINGLES, BLOCK_NODES = 400_000, 1024
STRIPE = 2048

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def sketch(values: np.ndarray, row: np.ndarray, rows: int, bins: int = BINS) -> np.ndarray:
    """``rows x bins`` sketch of the sets; a row without values stays all ones."""
    full = np.iinfo(np.uint64).max
    out = np.full((rows, bins), full, _U)
    with np.errstate(over="ignore"):
        for i in range(2 * bins):
            if not len(values):
                break
            x = mix(values + _U(i + 1) * _GOLD)
            at = ((x >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64) if i < bins else np.full(len(x), i - bins)
            best = np.full(rows * bins, full, _U)
            np.minimum.at(best, row * bins + at, x & _U(0xFFFFFFFF))
            best = best.reshape(rows, bins)
            new = (out == full) & (best != full)
            out[new] = best[new] | (_U(i) << _U(32))
            open_ = (out == full).any(axis=1)
            more = open_[row]
            values, row = values[more], row[more]
    return out


def bands(sketches: np.ndarray, count: int = BANDS, size: int = ROWS) -> np.ndarray:
    """``rows x count`` hashes of consecutive stretches of the sketches."""
    part = sketches[:, : count * size].reshape(len(sketches), count, size)
    with np.errstate(over="ignore"):
        h = np.arange(1, count + 1, dtype=_U)[None, :] * _GOLD
        h = np.broadcast_to(h, part.shape[:2]).copy()
        for j in range(size):
            h = mix(h * _GOLD + part[:, :, j])
    return h.view(np.int64)


def _set_keys(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent sums over each set, equal for equal sets."""
    cut = np.searchsorted(row, np.arange(rows + 1))
    keys = []
    with np.errstate(over="ignore"):
        for salt in (3, 5):
            total = np.zeros(len(values) + 1, _U)
            np.cumsum(mix(values ^ mix(np.array([salt], _U))), out=total[1:])
            keys.append((total[cut[1:]] - total[cut[:-1]]).view(np.int64))
    return keys[0], keys[1]


def _sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """``(first row, values, row, rows)`` of the distinct shingles."""
    for first, raw, off in buffers(texts):
        h, row = shingles(Words(raw, off), WIDTH)
        n = len(off) - 1
        yield first, *distinct(h, row, n), n


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for first, h, row, n in _sets(batch.column(1)):
            count = np.bincount(row, minlength=n)
            k1, k2 = _set_keys(h, row, n)
            b = bands(sketch(h, row, n))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(b.ravel()))
            parts.append(pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(count, pa.int64()), pa.array(k1), pa.array(k2), lists], names=["id", "n", "k1", "k2", "bands"]))
        yield from parts


def _candidate_filter(ids: DataFrame) -> tuple[np.ndarray, int]:
    """Bits set for the ids (column id): one hash, eight bits an id until the
    largest size.  The bits are or-ed before they come to the driver."""
    bits = min(max(int(ids.count() * 8).bit_length(), 16), FILTER_BITS)
    at = F.shiftrightunsigned(F.xxhash64("id"), 64 - bits)
    words = ids.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(xxhash64(id), {64 - bits}), 64) as int))").alias("m")).groupBy("w").agg(F.expr("bit_or(m)").alias("m")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64)
    return out.view(np.uint64), bits


def _full_sets(src: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, k1, k2, shingles) of the documents with these ids and few others; a
    task gives a set once for each id."""
    words, bits = _candidate_filter(ids)
    shared = src.sparkSession.sparkContext.broadcast(words)  # at most 2**FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has, seen = shared.value, set()
        for batch in batches:
            at = batch.column(1).to_numpy().view(np.uint64) >> _U(64 - bits)
            hit = (has[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1)
            batch = batch.filter(pa.array(hit.astype(bool)))
            for first, h, row, n in _sets(batch.column(2)):
                cut = np.searchsorted(row, np.arange(n + 1))
                k1, k2 = _set_keys(h, row, n)
                ids = batch.column(0).slice(first, n)
                new = [(key not in seen, seen.add(key))[0] for key in zip(ids.to_pylist(), k1.tolist(), k2.tolist(), strict=True)]
                out = pa.RecordBatch.from_arrays([ids, pa.array(k1), pa.array(k2), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h.view(np.int64)))], names=["id", "k1", "k2", "shingles"])
                yield out if all(new) else out.filter(pa.array(new))

    return src.where("id IS NOT NULL").select("id", F.xxhash64("id").alias("h"), "t").mapInArrow(tidy(run), "id long, k1 long, k2 long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; b is a leader.

    A pair carries the set of a alone to its leader.  A leader's own set stays
    where it is, however many pairs it has: these are one key with narrow rows on
    the leader's side, which adaptive execution splits."""
    sa = sets.select(F.col("v").alias("a"), F.col("shingles").alias("x"))
    sb = sets.select(F.col("v").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(sa, "a").join(sb, "b").select("a", "b", both.alias("i"), (F.size("x") + F.size("y")).alias("s")).where(100 * F.col("i") >= THRESHOLD * (F.col("s") - F.col("i"))).select("a", "b")


def block_links(values: np.ndarray, size: np.ndarray, label: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
    """Links that join different labels among the sets of a block, as few as
    join all that can be joined.

    values: the sets one after the other, size long each.  Intersections are
    products of indicator columns, STRIPE shingles at a time; a shingle of one
    set only is left out.  side: for two tiles, which tile a set is of; then
    only pairs across count."""
    n = len(size)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1
    r, col = r[shared], col[shared]
    col = np.unique(col, return_inverse=True)[1]
    left = np.arange(n) if side is None else np.flatnonzero(~side)
    right = np.arange(n) if side is None else np.flatnonzero(side)
    both = np.zeros((len(left), len(right)), np.float32)
    cut = np.searchsorted(col, np.arange(0, (col[-1] if len(col) else -1) + 1 + STRIPE, STRIPE))
    for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        part = np.zeros((n, STRIPE), np.float32)
        part[r[a:b], col[a:b] - k * STRIPE] = 1
        both += part[left] @ part[right].T
    i, j = np.nonzero((100 * both >= THRESHOLD * (size[left][:, None] + size[right][None, :] - both)) & (label[left][:, None] != label[right][None, :]))
    root = {x: x for x in set(label.tolist())}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(left[i].tolist(), right[j].tolist(), strict=True):
        x, y = find(int(label[a])), find(int(label[b]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _links_in_blocks(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components (labels l), of all pairs that share a band.

    A band with nodes of one component is settled.  The others are dealt into
    tiles of bounded size, each two tiles of a band meet in one block, and a
    block gives no more links than it joins components."""
    bands = open_.groupBy("band").agg(F.min("l").alias("lo"), F.max("l").alias("hi"), F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("c")).where("lo <> hi")
    tiles = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("c") / BLOCK_NODES)).cast("int")
    x = open_.join(bands.select("band", tiles.alias("tiles")), "band")
    x = x.withColumn("t", F.pmod(F.xxhash64("v", F.lit(11)), F.col("tiles")).cast("int")).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    x = x.select("band", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "t", "v", "l").join(sets, "v").select("band", "i", "j", "t", "v", "l", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch], i: int, j: int) -> pa.RecordBatch:
            g = pa.Table.from_batches(held).combine_chunks()
            found: list[tuple[int, int]] = []
            labels = g["l"].to_numpy()
            if g.num_rows > 1:
                lists = g["shingles"].chunk(0)
                side = g["t"].to_numpy() == j if i != j else None
                found = block_links(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()), labels, side)
            a, b = ([labels[p[k]] for p in found] for k in range(2))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.column_stack([batch.column(c).to_numpy() for c in range(3)])
            cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                at = tuple(k[a].tolist())
                if now is not None and at != now:
                    yield done(held, *now[1:])
                    held = []
                now = at
                held.append(batch.slice(a, b - a))
        if held:
            yield done(held, *now[1:])

    return x.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, ``n_shingles``, ``component_id``, ``kept``.

    Words are runs other than white space with A-Z lower-cased.  A text with
    fewer than five words has its whole sequence as its only shingle; a null,
    empty or blank text has none and links with nothing.  Texts link when the
    intersection of their sets is 85 % of the union or more.  component_id is
    the smallest id reachable by links, itself included; kept rows are those
    whose id that is.  Rows are judged by their texts: rows that repeat an id and a
    text agree, and rows that repeat an id with different texts are linked only
    if these texts are.  A row with a null id has no component and is kept.
    Other columns are not looked at; an empty table gives no rows."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    sig = checkpointed(src.mapInArrow(tidy(_signatures), "id long, n long, k1 long, k2 long, bands array<long>"))
    nodes = sig.where("n > 0 AND id IS NOT NULL").groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands"))
    # a node has a number of its own, fixed when it is written
    nodes = checkpointed(nodes.withColumn("v", F.monotonically_increasing_id()))
    members = nodes.select("v", "n", F.explode("bands").alias("band")).withColumn("o", F.xxhash64("v"))
    lead = F.struct("o", "v", "n")
    led = members.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min(lead).alias("l1"), F.max(lead).alias("l2")).where("c > 1").select("band", "l1", "l2", "c")
    crowd = checkpointed(members.join(led, "band").select("band", "v", "n", F.col("l1.v").alias("p1"), F.col("l1.n").alias("n1"), F.col("l2.v").alias("p2"), F.col("l2.n").alias("n2"), "c"))

    near = lambda x, y: (100 * F.col(x) >= THRESHOLD * F.col(y)) & (100 * F.col(y) >= THRESHOLD * F.col(x))
    pairs = lambda p, n: [F.col("v").alias("a"), F.col(p).alias("b"), F.col("n").alias("na"), F.col(n).alias("nb")]
    first = crowd.where("v <> p1").select(*pairs("p1", "n1"))
    second = crowd.where("v <> p2 AND p1 <> p2").select(*pairs("p2", "n2"))
    tested = checkpointed(first.unionByName(second).where(near("na", "nb")).select("a", "b").distinct())
    comp = None
    if not no_rows(tested) or not no_rows(crowd.where("c > 3")):
        wanted = tested.select(F.col("a").alias("v")).union(tested.select(F.col("b").alias("v"))).union(crowd.where("c > 3").select("v")).distinct()
        wanted = checkpointed(nodes.select("v", "k1", "k2", F.col("rep").alias("id")).join(wanted, "v", "left_semi"))
        sets = _full_sets(src, wanted.select("id")).join(wanted, ["id", "k1", "k2"]).select("v", "shingles")
        # rows that repeat an id and a text are in several tasks
        sets = checkpointed(sets.groupBy("v").agg(F.first("shingles").alias("shingles")) if ids_repeat(src, "id") else sets)
        links = checkpointed(_confirmed(tested, sets))
        comp = connected_components(links)
        # what the leaders left open: nodes of different components in a band
        label = comp.select(F.col("node").alias("v"), "component")
        open_ = crowd.where("c > 3").join(label, "v", "left").select("band", "v", "n", F.coalesce("component", "v").alias("l"))
        found = checkpointed(_links_in_blocks(checkpointed(open_), sets))
        if not no_rows(found):
            # components of components; a label is its component's smallest node
            joined = connected_components(found)
            step = joined.select(F.col("node").alias("component"), F.col("component").alias("_next"))
            grown = comp.join(step, "component", "left").select("node", F.coalesce("_next", "component").alias("component"))
            comp = checkpointed(grown.unionByName(joined.join(comp.select("node"), "node", "left_anti")))
    names = nodes.select("k1", "k2", "n", "v", "rep")
    out = sig.drop("bands").withColumn("named", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.lit(True)))
    if comp is not None:
        # the smallest id of each component
        comp = comp.select(F.col("node").alias("v"), "component")
        least = comp.join(nodes.select("v", "rep"), "v").groupBy("component").agg(F.min("rep").alias("least"))
        names = names.join(comp.join(least, "component").select("v", "least"), "v", "left").withColumn("rep", F.coalesce("least", "rep")).drop("least")
    out = out.join(names.drop("v").withColumn("named", F.lit(True)), ["k1", "k2", "n", "named"], "left")
    own = F.coalesce("rep", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


@production
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@production
def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, with the columns of docs: that of the smallest
    id.  Texts without words are no copies and all stay.

    Where an id is null or repeats, rows are told apart by a hash of id and text
    instead, so rows that share an id are judged apart; of a group any one row
    stays then, and of rows that repeat id and text one.  An empty table stays
    empty."""
    if not ids_repeat(docs):
        return without(docs, near_duplicates(docs).where("not kept").select("doc_id"), [docs["doc_id"]])
    key = F.xxhash64("doc_id", text_of("text"))
    rows = checkpointed(near_duplicates(docs.select(key.alias("doc_id"), "text")).groupBy("doc_id", "kept", (F.col("n_shingles") > 0).alias("words")).agg(F.count(F.lit(1)).alias("c")))
    left = without(docs, rows.where("not kept").select("doc_id"), [key])
    return one_of_each(left, rows.where("kept AND words AND c > 1").select("doc_id"), [key])
