"""The corpus pipeline: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from diurna.llm import stages
from diurna.llm.common import staged

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", stages.quality_rules_stage),
    ("n-gram Jaccard join", stages.near_duplicate_stage),
    ("suffix-array dedup", stages.repeated_passage_stage),
    ("benchmark decontamination", stages.decontamination_stage),
    ("packing", stages.packing_stage),
]

#: Packing needs a tokenizer, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = staged(docs, f"stage-{number}")
    return docs
