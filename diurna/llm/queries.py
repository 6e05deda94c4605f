"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diurna.llm import (decontaminate, fill_middle, jaccard_join, knn_quality, license_scan, line_dedup, merkle, packing,
                        quality_rules, sql, suffix_dedup, token_counts, token_store, url_model)
from diurna.llm.common import bounded_batches


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = license_scan.scan(docs, license_scan.fit(license_scan.corpus_lines(docs)))
    return found.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_licensed"),
                        F.array_join("families", ",").alias("families"), "family", "found")


def op2_quality_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    labels = table(spark, folder, "labels").select("doc_id", "quality").filter(fold != 0)
    scores = knn_quality.scored(docs, knn_quality.fit(*knn_quality.sampled(docs, labels)))
    return scores.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_model.judged(table(spark, folder, "pages"))


def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_token_store(spark: SparkSession, folder: str) -> DataFrame:
    shards = token_store.write(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read(shards, token_store.checksum, "ids_crc32 bigint")


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.prefix_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op7_mixture_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "sequence_tokens")


def op8_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.components(table(spark, folder, "documents"), words=4, percent=85)


def op9_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, folder, "documents"), 400)


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.digests(table(spark, folder, "documents"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.documents_manifest(table(spark, folder, "documents"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.digests(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_quality_neighbours, op3_url_filter, op4_benchmark_decontamination, op5_token_store, op6_token_counts, op7_mixture_packing,
                            op8_ngram_jaccard_join, op9_suffix_array_dedup, op10_quality_rules, op11_line_dedup,
                            op12_merkle_manifest, op13_fill_in_middle)
}
#: The others need a library, a trained model or its floating-point order; tests hold them against plain versions.
SQL: dict[str, str] = {
    "op4_benchmark_decontamination": sql.OP4,
    "op8_ngram_jaccard_join": sql.OP8,
    "op9_suffix_array_dedup": sql.OP9,
    "op10_quality_rules": sql.OP10,
    "op11_line_dedup": sql.OP11,
    "op12_merkle_manifest": sql.OP12,
    "op13_fill_in_middle": sql.OP13,
}
