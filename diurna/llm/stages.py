"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> documents that go on.

All but the last return the columns of documents (doc_id, text, lang, source, n_chars). A
stage handles null and empty texts, repeated rows and empty tables as its operator does.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diurna.llm import decontaminate, packing, quality_rules
from diurna.llm.common import small_or_not, staged, unstage
from diurna.llm.jaccard_join import components
from diurna.llm.suffix_dedup import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: five words, similarity 0.8 or more.
SHINGLE_WORDS, SIMILARITY = 5, 80
#: Bytes of a repeated passage: under 50 words of ordinary length.
PASSAGE_BYTES = 200
#: Words that a worker of the last stage remembers: its executor still holds the heap of the stages before.
REMEMBERED = 200_000


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.judged(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Rows without words, or without an id, are in no group and stay. Different texts under one
    id are documents of their own: they are compared, and stay or go, each for itself.
    """
    docs = docs.select(*COLUMNS)
    text = F.xxhash64("text")
    ids = staged(docs.filter("doc_id is not null").groupBy("doc_id").agg(
        F.count("*").alias("n"), (F.min(text) < F.max(text)).alias("several")).filter("n > 1").select("doc_id", "several"), "repeated")
    several = ids.filter("several").select("doc_id")
    nodes = docs.withColumn("node", F.col("doc_id"))
    some = several.limit(1).count() > 0
    if some:
        nodes = docs.join(small_or_not(several.withColumn("_own", F.lit(True))), "doc_id", "left").select(
            *COLUMNS, F.when(F.col("_own"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")).alias("node"))
    groups = components(nodes.select(F.col("node").alias("doc_id"), "text"), SHINGLE_WORDS, SIMILARITY)
    below = groups._below
    if some:
        named = nodes.join(small_or_not(several), "doc_id", "left_semi").select(F.col("node"), F.col("doc_id").alias("own")).distinct()
        groups = staged(groups.filter("doc_id is not null").withColumnRenamed("doc_id", "node").join(small_or_not(named), "node", "left").select(
            "node", "component_id", F.coalesce("own", "node").alias("own")), "groups")
        first = groups.groupBy("component_id").agg(F.min(F.struct("own", "node")).alias("first"))
        gone = groups.join(first, "component_id").filter("node <> first.node").select("node").distinct()
    else:
        gone = groups.filter("component_id < doc_id").select(F.col("doc_id").alias("node")).distinct()
    gone = staged(gone, "gone")
    unstage(*below)
    kept = nodes.join(small_or_not(gone), "node", "left_anti").select(*COLUMNS)
    # rows that repeat one id with one text are a group as well
    ids = small_or_not(ids.select("doc_id"))
    twice = kept.join(ids, "doc_id", "left_semi").select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return kept.join(ids, "doc_id", "left_anti").select(*COLUMNS).unionByName(twice)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur twice or more are cut out everywhere, at whole characters."""
    return cut(docs.select(*COLUMNS), PASSAGE_BYTES).withColumn(
        "n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.hits(docs, benchmark, COLUMNS).filter("n_hit = 0").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "sequence_tokens")
