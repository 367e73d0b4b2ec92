"""A corpus pipeline of the training-data operators.

Every stage takes all rows that its predecessor kept and, but for the last, returns the columns of
documents. A verdict holds for a row: rows that repeat a doc_id are documents of their own. What a
stage returns must be written before the next one is called, which removes the working tables
of the stage before.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gaugewell.llm.common import Scratch, drop_scratch, scratch_roots, written_order
from gaugewell.llm.mixing import mix_sources
from gaugewell.llm.near_dedup import drop_near_duplicates
from gaugewell.llm.packing import pack_documents
from gaugewell.llm.quality_rules import keep_good
from gaugewell.llm.suffix_dedup import cut_repeated_passages


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_working: list[str] = []


def _stage(f: Stage) -> Stage:
    """f, with its working tables kept until the next stage begins."""

    @wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_scratch(spark, list(_working))
        before = set(scratch_roots())
        out = f(spark, docs, sf_dir)
        _working[:] = [r for r in scratch_roots() if r not in before]
        return out

    return call


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or diverge from their language go."""
    return keep_good(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document of the smallest doc_id stays."""
    return drop_near_duplicates(docs)


@_stage
def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also stand in a document before, by doc_id, are cut; a document without a word left goes."""
    return cut_repeated_passages(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the schedule, which is the order of the written files and their rows."""
    mixed = mix_sources(docs)
    return mixed.orderBy("slot", "place").select(*docs.columns)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places; sequences by number follow the order in which mixing wrote the documents."""
    docs = written_order(docs.select("doc_id", "text"), "x_file", "x_row")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), "word", capacity=2048, keep_ids=False, order=("x_file", "x_row"))


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", passage_dedup),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: Signatures, suffixes, schedules and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table, each written and read again; a stage's table goes when the next is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = list(scratch.made)
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
    return docs
