"""The opN_ queries: thin calls of the operators with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_chats
from .common import Scratch
from .embedding_dedup import near_vectors
from .fill_in_middle import fill_in_middle, restore
from .line_dedup import drop_repeated_lines
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .ngram_lm import score_texts
from .oracle import CODES, FILL, LINES
from .packed_ids import read_packed, write_packed
from .packing import pack_documents
from .quality_classifier import score_quality
from .quality_rules import quality_rules
from .quality_sql import quality_sql
from .suffix_dedup import repeated_passages
from .vector_codes import compress_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(_table(spark, sf_dir, "documents"), path, "word", capacity=2048, keep_ids=False)


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85, bands=27, rows=7)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = write_packed(_table(spark, sf_dir, "documents"), Scratch(spark, "packed"), path, "byte")
    return read_packed(manifest).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("x_n_lines").alias("n_lines"), F.col("x_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(_table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = restore(fill_in_middle(_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_quality_rules": op2_quality_rules,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_ngram_lm": op4_ngram_lm,
    "op5_mix_sources": op5_mix_sources,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_token_binary": op9_token_binary,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_line_dedup": op11_line_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: The other operators have no SQL form; their tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op2_quality_rules": quality_sql(), "op11_line_dedup": LINES, "op12_vector_codes": CODES, "op13_fill_in_middle": FILL}
