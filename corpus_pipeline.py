"""Documents to training sequences: STAGES applied one after the other, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexspark.llm import stages
from lexspark.llm.common import remove, shared_dir, table

STAGES = [
    ("toxicity", stages.toxicity),
    ("line_dedup", stages.line_dedup),
    ("minhash_dedup", stages.near_dedup),
    ("pii", stages.redaction),
    ("packing", stages.best_fit),
]

#: The first, third, fourth and fifth stage cannot be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
