"""A corpus pipeline: toxicity, line dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from undertow.llm import stages
from undertow.llm.common import table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.dedup_lines),
    ("simhash_dedup", stages.dedup_near),
    ("substring_dedup", stages.dedup_substrings),
    ("packing", stages.pack),
]

#: Scores, fingerprints and token ids are beyond SQL; tests/llm/test_stages.py holds each stage and the run against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what lies between them is written to the folder that all machines share, and goes at the end."""
    docs = table(spark, sf_dir, "documents")
    shared = spark.sparkContext.getCheckpointDir() + f"/pipeline-{uuid.uuid4().hex}"
    try:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{shared}/{k}")
            docs = spark.read.parquet(f"{shared}/{k}")
        return STAGES[-1][1](spark, docs, sf_dir).checkpoint()
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(shared)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
