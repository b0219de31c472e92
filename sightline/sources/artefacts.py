"""What a diagnosis leaves behind: linked fact tables and their store."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _id(kind: str, *parts: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(kind), *(F.col(p).cast("string") for p in parts)), 256)


def linked(rivals: DataFrame, gap_rows: DataFrame, actions: DataFrame) -> dict[str, DataFrame]:
    """The tables with ids and links; each has diagnosis_id and pos, its order.

    Gap rows belong to the first rival of their diagnosis and are left out where
    there is none.  The n-th action refers to the n-th gap row that stays, else
    it keeps its own ``action_ref``.  A diagnosis has few rows of each."""
    r = rivals.withColumn("id", _id("rival", "diagnosis_id", "pos"))
    first = r.groupBy("diagnosis_id").agg(F.min_by("id", "pos").alias("rival_id"))
    g = gap_rows.join(first, "diagnosis_id").withColumn("id", _id("gap", "diagnosis_id", "pos"))
    n = F.row_number().over(Window.partitionBy("diagnosis_id").orderBy("pos"))
    refs = g.select("diagnosis_id", n.alias("_n"), F.col("id").alias("_ref"))
    a = actions.withColumn("_n", n).join(refs, ["diagnosis_id", "_n"], "left").withColumn("action_ref", F.coalesce("_ref", "action_ref")).drop("_n", "_ref")
    return {"rivals": r, "gap_rows": g, "actions": a}


#: Where a store's versions are committed, one file each, and what they hold.
COMMITS, KEYS = "_commits", "_keys"


def _files(spark: SparkSession, folder: str):
    """Hadoop's view of the folder: path maker, file system and file context."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(conf)
    return path, fs, jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(path(folder)).toUri(), conf)


def _commits(spark: SparkSession, folder: str) -> list[str]:
    """The versions that were committed, oldest first."""
    path, fs, _ = _files(spark, folder)
    at = path(f"{folder}/{COMMITS}")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return [spark.read.text(f"{folder}/{COMMITS}/{n}").first()["value"] for n in sorted(n for n in names if n.isdigit())]


def _commit(spark: SparkSession, folder: str, version: str) -> None:
    """Make a version visible: its file takes the next free number.  A rename never
    replaces a file, so of two writers one takes the number after."""
    path, fs, context = _files(spark, folder)
    fs.mkdirs(path(f"{folder}/{COMMITS}"))
    staged = path(f"{folder}/{COMMITS}/.{version}")
    out = fs.create(staged, False)
    out.write(bytearray(version.encode()))
    out.close()
    never = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    never[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    n = len(_commits(spark, folder))
    while True:
        try:
            context.rename(staged, path(f"{folder}/{COMMITS}/{n:012d}"), never)
            return
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            n += 1


def save(tables: dict[str, DataFrame], folder: str, by: str) -> str:
    """Store tables that belong together: readers see all of them or none.

    Tables are written below a version of their own, with the values of ``by``
    that each has, and one small file that appears at the end makes the version
    visible.  A value that comes again replaces what earlier versions have of that
    table's rows with it; other values stay.  A write that fails leaves files that
    no reader looks at.  Returns the version."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}/version={version}")
        written = df.sparkSession.read.parquet(f"{folder}/{name}/version={version}")
        written.select(by).distinct().write.parquet(f"{folder}/{KEYS}/{name}/version={version}")
    spark = next(iter(tables.values())).sparkSession
    _commit(spark, folder, version)
    return version


def load(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Tables of a store as of now, all of the same versions: of each value of the
    key the rows of the newest version that has it.  A table that no committed
    version has is left out."""
    versions = _commits(spark, folder)
    path, fs, _ = _files(spark, folder)
    number = spark.createDataFrame([(v, i) for i, v in enumerate(versions)], "version string, _n int")
    out = {}
    for name in names:
        there = [v for v in versions if fs.exists(path(f"{folder}/{name}/version={v}"))]
        if not there:
            continue
        rows, keys = (spark.read.option("basePath", f"{folder}/{p}").parquet(*(f"{folder}/{p}/version={v}" for v in there)).withColumn("version", F.col("version").cast("string")) for p in (name, f"{KEYS}/{name}"))
        by = next(c for c in keys.columns if c != "version")
        # one row a value; the versions of a store are few
        newest = keys.join(F.broadcast(number), "version").groupBy(by).agg(F.max_by("version", "_n").alias("_newest")).withColumnRenamed(by, "_by")
        out[name] = rows.join(newest, rows[by].eqNullSafe(F.col("_by")) & (F.col("version") == F.col("_newest"))).drop("_by", "_newest", "version")
    return out
