"""A corpus from raw documents: toxicity, quality, near-duplicates, benchmark decontamination, packing.

Each stage works on what its predecessor kept, written as Parquet into the shared folder and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veriloom import session
from veriloom.llm import decontam, importance, packing, simhash, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("quality_classifier", importance.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontam.stage),
    ("packing", packing.stage),
]

# Models fitted outside the database and a greedy packing: tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{session.shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
