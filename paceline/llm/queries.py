"""One registered query per operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.adaptive_rules import apply_rules
from paceline.llm.blob_ledger import BASE, count_of, scan_versions, spans_text
from paceline.llm.chosen_path import near_duplicates
from paceline.llm.common import table
from paceline.llm.gru_language import identify_languages
from paceline.llm.heap_kmeans import cluster_vectors
from paceline.llm.histogram_sort import shard_documents
from paceline.llm.line_blocks import extract_main_text
from paceline.llm.line_neighbours import near_duplicate_lines
from paceline.llm.pfair_mix import interleave
from paceline.llm.repair import document_index, encode_shards
from paceline.llm.templates import leaks
from paceline.llm.token_groups import align_tokenizers
from paceline.llm.unit_dedup import repeated_units
from paceline.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_repair_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, compressed, written as shards, and its place and checksum read back from the files."""
    path = scratch_path(spark, "token-shards")
    encode_shards(table(spark, sf_dir, "documents")).write.option("compression", "zstd").parquet(path)
    return document_index(spark, path)


def op2_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op3_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(table(spark, sf_dir, "documents"))


def op6_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_versions(table(spark, sf_dir, "documents"), scratch_path(spark, "ledger"), ["doc_id"])
    counts = [count_of("findings", kind).alias(f"n_{kind}") for kind in BASE]
    return found.select(
        "doc_id", *counts, F.sha2(spans_text("findings", BASE), 256).alias("base_sha256"), spans_text("findings").alias("spans")
    )


def op7_line_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_lines(table(spark, sf_dir, "documents"))


def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weighted by the square root of their size, in blocks of 20,000 characters."""
    mixed = interleave(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "block_no", "slot", "block_offset")


def op11_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards of near-equal bytes; texts are read, and only their digests passed on."""
    found = shard_documents(table(spark, sf_dir, "documents"), 40, ["doc_id"])
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))


def op13_heap_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_repair_token_shards, op2_gru_language, op3_template_leaks, op4_adaptive_rules, op5_unit_dedup, op6_blob_ledger, op7_line_neighbours, op8_chosen_path_join, op9_line_blocks, op10_pfair_mix, op11_histogram_sort, op12_token_groups, op13_heap_kmeans)}
