"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    byte_bpe, chunk_bpe, conversation, html_text, katz, lexical, line_dedup, mtree, packing, quality,
    repeats, simhash, toxicity,
)
from .common import read

Query = Callable[[SparkSession, str], DataFrame]

# Backs off from pairs of words to words to none.
KATZ_ORDER = 3


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(read(spark, sf_dir, "documents"), KATZ_ORDER)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_bytes(read(spark, sf_dir, "documents"))


def op6_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(read(spark, sf_dir, "embeddings"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op11_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.encode_documents(read(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair_conversations(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_byte_bpe,
        op2_toxicity,
        op3_html_text,
        op4_katz,
        op5_repeats,
        op6_mtree,
        op7_simhash,
        op8_quality,
        op9_line_dedup,
        op10_packing,
        op11_chunk_bpe,
        op12_lexical,
        op13_conversation,
    )
}

ORACLES: dict[str, str] = {"op12_lexical": lexical.SQL}
