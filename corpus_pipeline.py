"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with the columns of documents; the last one returns their
tokens. Stages are written as Parquet and read again between one another, so each works on exactly what its predecessor kept and a lost
executor costs a part of one stage only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from engram.llm import pipeline
from engram.session import ensure_checkpoint_dir

STAGES = [
    ("quality", pipeline.quality_stage),
    ("line_dedup", pipeline.line_stage),
    ("near_duplicates", pipeline.near_stage),
    ("decontamination", pipeline.decontamination_stage),
    ("tokens", pipeline.token_stage),
]
ORACLE_SQL = None   # learned weights and tokenisation are beyond SQL; tests/llm/test_pipeline.py has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written below the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
