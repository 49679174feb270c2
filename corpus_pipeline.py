"""A corpus pipeline of five stages, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import stages
from strandlake.llm._common import written

STAGES = [
    ("language ID", stages.language_id),
    ("SimHash near-dedup", stages.near_dedup),
    ("suffix-array dedup", stages.substring_dedup),
    ("mixing sources to target weights", stages.mix),
    ("BPE encoding and decoding", stages.encode),
]

#: SQL can express neither compression classification nor byte-pair encoding; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
