"""What the corpus operators share: checkpoints, table readers, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as every word-counting contract of this package has it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``).

    Only a local session that names none, as in tests, gets a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sightline-checkpoint-"))
    # a folder of this application alone, in the one that was named
    own = sc._jsc.sc().getCheckpointDir().get()
    delete_at_end(spark, own)
    return own


def delete_at_end(spark: SparkSession, folder: str) -> None:
    """Delete the folder when the application ends; until then executors may
    need what is in it to make lost results again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def scratch(spark: SparkSession) -> str:
    """A new folder for tables written between steps, shared and deleted when
    the application ends."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through files that every executor can read again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def no_rows(df: DataFrame) -> bool:
    return not df.take(1)


def small(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; looks at one row more at most."""
    return df.limit(max_rows + 1).count() <= max_rows


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: A graph of at most so many links (16 bytes each) is finished on the driver.
DRIVER_LINKS = 50_000


def _roots(a: list[int], b: list[int]) -> dict[int, int]:
    """The smallest reachable vertex of each vertex of the links."""
    root = {x: x for x in (*a, *b)}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by contraction to local minima.

    edges: columns ``a``, ``b`` (long).  Returns one row per vertex that has an
    edge: ``node``, ``component`` (its smallest reachable vertex).

    Each round orders the vertices anew by a hash, moves every vertex to the
    first of itself and its neighbours, relabels the edges and drops loops and
    repeats.  In a random order a quarter of the vertices or more go each round
    in expectation, whatever the graph (Bögeholz, Brand, Todor 2020), so rounds
    grow with the logarithm of a component's size.  In any order a component
    with an edge loses a vertex, so the rounds end by themselves.  What is left
    after them, DRIVER_LINKS at most, is settled on the driver.  The smallest
    vertex of a component is looked up at the end.
    A minimum is summed up before it is shuffled, so a hub costs its task one
    row per upstream task; joins on a hub's key have a narrow row per edge and
    are left to adaptive skew splitting."""
    e = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    total = None
    for k in count():
        if small(e, DRIVER_LINKS):
            break
        # a permutation of the longs for each k, so no two vertices tie
        place = lambda c: F.xxhash64(F.col(c), F.lit(k))  # noqa: B023, E731
        both = e.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("other")))
        first = both.groupBy("node").agg(F.min(place("other")).alias("_place"), F.min_by("other", place("other")).alias("other"))
        parent = checkpointed(first.select("node", F.when(F.col("_place") < place("node"), F.col("other")).otherwise(F.col("node")).alias("component")))
        if total is None:
            total = parent
        else:
            step = parent.select(F.col("node").alias("component"), F.col("component").alias("_next"))
            total = checkpointed(total.join(step, "component", "left").select("node", F.coalesce("_next", "component").alias("component")))
        of_a = parent.select(F.col("node").alias("a"), F.col("component").alias("_a"))
        of_b = parent.select(F.col("node").alias("b"), F.col("component").alias("_b"))
        moved = e.join(of_a, "a").join(of_b, "b").where("_a <> _b")
        e = checkpointed(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    rest = e.toArrow()
    roots = _roots(rest["a"].to_pylist(), rest["b"].to_pylist())
    last = e.sparkSession.createDataFrame(pa.table({"node": pa.array(list(roots), pa.int64()), "component": pa.array(list(roots.values()), pa.int64())}))
    if total is None:
        return checkpointed(last)
    step = F.broadcast(last.select(F.col("node").alias("component"), F.col("component").alias("_next")))
    total = checkpointed(total.join(step, "component", "left").select("node", F.coalesce("_next", "component").alias("component")))
    least = total.groupBy("component").agg(F.min("node").alias("_least"))
    return checkpointed(total.join(least, "component").select("node", F.col("_least").alias("component")))


#: Keys to drop of at most so many rows are broadcast (some 40 bytes each).
BROADCAST_IDS = 200_000


def _same_keys(docs: DataFrame, rows: DataFrame, keys: list[Column]) -> tuple[DataFrame, Column]:
    """rows with names of its own, broadcast up to a bound, and the condition
    that a row of docs has its keys."""
    rows = rows.toDF(*(f"_key{i}" for i in range(len(keys))))
    rows = F.broadcast(rows) if small(rows, BROADCAST_IDS) else rows
    same = [k.eqNullSafe(rows[f"_key{i}"]) for i, k in enumerate(keys)]
    return rows, functools.reduce(Column.__and__, same)


def without(docs: DataFrame, dropped: DataFrame, keys: list[Column]) -> DataFrame:
    """docs without the rows whose keys are a row of dropped; nulls are equal.

    The keys to drop are counted first, up to a bound.  Up to it they are
    broadcast, so the texts stay where they are; beyond it the join is shuffled."""
    return docs.join(*_same_keys(docs, dropped, keys), "left_anti")


def one_of_each(docs: DataFrame, repeated: DataFrame, keys: list[Column]) -> DataFrame:
    """docs with one row of those whose keys are a row of repeated.  Only these
    rows are moved, summed up to one a task before; nulls are equal."""
    if no_rows(repeated):
        return docs
    again = docs.join(*_same_keys(docs, repeated, keys), "left_semi")
    one = again.groupBy(*(k.alias(f"_key{i}") for i, k in enumerate(keys))).agg(F.first(F.struct(*(again[c] for c in docs.columns))).alias("_row")).select("_row.*")
    return without(docs, repeated, keys).unionByName(one)


def ids_repeat(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether some id is null or in several rows."""
    ids = docs.select(F.col(id_col).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("c"))
    return not no_rows(ids.where("c > 1 OR i IS NULL"))


def numbered_within(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with a number from 1 among those of equal keys, in any order.

    Rows are written first, so a task that runs again gives the same numbers.
    They are counted within the written partitions and then over these, so that
    no key is brought together in one task."""
    rows = checkpointed(rows.withColumn("_nw_own", F.monotonically_increasing_id())).withColumn("_nw_part", F.shiftright("_nw_own", 33))
    counted = rows.groupBy(*keys, "_nw_part").agg(F.count(F.lit(1)).alias("_nw_n"))
    before = F.sum("_nw_n").over(Window.partitionBy(*keys).orderBy("_nw_part").rowsBetween(Window.unboundedPreceding, -1))
    first = counted.select(*(F.col(k).alias(f"_nw_{k}") for k in keys), F.col("_nw_part").alias("_nw_of"), F.coalesce(before, F.lit(0)).alias("_nw_before"))
    at = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_nw_part").orderBy("_nw_own")))
    same = functools.reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_nw_{k}")) for k in keys), F.col("_nw_part") == F.col("_nw_of"))
    return at.join(first, same).withColumn(name, F.col(name) + F.col("_nw_before")).select(*(c for c in rows.columns if c not in ("_nw_own", "_nw_part")), name)


#: Rows of an Arrow batch in the registered queries and stages, while a session
#: has Spark's default of 10,000: texts are long, and a batch is in memory several
#: times, in the JVM and in Python.
BATCH_ROWS = 1_000


def production(run: Callable) -> Callable:
    """A query or stage (spark, ...) at production settings: small Arrow batches,
    unless the session was told a size.  Results are lazy, so the setting stays;
    the operators themselves change no setting."""

    @functools.wraps(run)
    def wrapped(spark: SparkSession, *rest):
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if spark.conf.get(key, "10000") == "10000":
            spark.conf.set(key, str(BATCH_ROWS))
        return run(spark, *rest)

    return wrapped


def release_memory() -> None:
    """Give what this process has freed back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps it
        pass


def tidy(run: Callable) -> Callable:
    """run for mapInArrow that gives its memory back when its task ends.

    Python workers stay alive for later tasks; without this each keeps what its
    largest batch needed while other work wants the executor's memory."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped
