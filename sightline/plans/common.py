"""The driver's tables in the roles that the operators know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-06-01 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores: a small file is one
    partition, and parsing its rows takes longer than moving them.  A table of
    many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as accounts; the day of signup follows the key."""
    c = table(spark, sf_dir, "customer")
    plan = F.when(F.col("c_mktsegment") == "BUILDING", "free").when(F.col("c_mktsegment") == "AUTOMOBILE", "basic").when(F.col("c_mktsegment") == "MACHINERY", "pro").otherwise("business")
    at = F.lit("1998-06-01").cast("timestamp_ntz") - F.make_dt_interval((F.col("c_custkey") % 40).cast("int"))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"), plan.alias("plan"), at.alias("created_at"), F.when(F.col("c_acctbal") < 0, at).alias("blocked_at"), F.when(F.col("c_custkey") % 11 == 0, at).alias("deleted_at"))


ACCOUNTS_SQL = """accounts AS (SELECT c_custkey AS id, c_name AS email, CASE c_mktsegment WHEN 'BUILDING' THEN 'free' WHEN 'AUTOMOBILE' THEN 'basic' WHEN 'MACHINERY' THEN 'pro' ELSE 'business' END AS plan,
  TIMESTAMP '1998-06-01' - to_days(CAST(c_custkey % 40 AS INT)) AS created_at, c_acctbal, c_custkey FROM customer)"""


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("account_id"))


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as diagnoses."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("business_id"), status.alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))


DIAGNOSES_SQL = """diagnoses AS (SELECT o_orderkey AS id, o_custkey AS business_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status, o_orderdate AS created_at FROM orders)"""


def made_pages(df: DataFrame) -> DataFrame:
    """df with the columns of parsed pages that it lacks: empty lists and maps,
    nulls for all else."""
    from pyspark.sql import types as T

    from ..sources.pages import SCHEMA

    fields = T.DataType.fromDDL(SCHEMA).fields
    empty = lambda t: F.array().cast(t) if isinstance(t, T.ArrayType) else F.create_map().cast(t) if isinstance(t, T.MapType) else F.lit(None).cast(t)
    own = set(df.columns)
    return df.select(*(F.col(f.name).cast(f.dataType) if f.name in own else empty(f.dataType).alias(f.name) for f in fields))


def pick(values: list, key) -> Column:
    """The value at key modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def pick_sql(values: list, key: str) -> str:
    """The same in SQL; strings are quoted."""
    say = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else "NULL" if v is None else str(v)
    return f"[{', '.join(map(say, values))}][({key}) % {len(values)} + 1]"
