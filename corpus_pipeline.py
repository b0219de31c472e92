"""The corpus pipeline: documents in, training sequences out.

Each stage is one operator of ``sightline.llm`` at its production parameters.
A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sightline.llm.common import shared_folder
from sightline.llm.exact_dedup import exact_dedup_stage
from sightline.llm.minhash import near_duplicates_stage
from sightline.llm.mixing import mixing_stage
from sightline.llm.packing import packing_stage
from sightline.llm.quality import quality_stage

STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("minhash near-dedup", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Classifier and tokenizer have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir.  Intermediate results are
    written to the shared folder that checkpoints use, and each is deleted when
    the next one is complete; the last one holds the rows returned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return docs
