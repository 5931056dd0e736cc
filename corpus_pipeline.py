"""A corpus pipeline of five stages; each takes what its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from factweave.llm import decontaminate, neardup, packing, private, quality
from factweave.llm.common import deleted, read, scratch, shared_folder

STAGES = [
    ("quality", quality.keep_good),
    ("near_duplicates", neardup.keep_one),
    ("decontaminate", decontaminate.remove_benchmark),
    ("private", private.redact_stage),
    ("packing", packing.pack_stage),
]

#: Tokenizers, trained models and hashed candidates have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            deleted(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
