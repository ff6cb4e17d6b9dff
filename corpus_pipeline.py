"""The corpus pipeline: toxicity, line dedup, near-dedup, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
Rows may be null in any column, repeated or absent; texts may be empty or very long; other
columns stay, whatever their names. A text without a word is packed as its end alone. Of
copies one row stays, the texts of null and empty documents among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnworks.llm import line_dedup, packing, repeats, simhash, toxicity
from kilnworks.llm.common import read, stored

# Bytes of the shortest repeated passage that is taken out: over 50 words of prose.
PASSAGE = 250


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars``, where there is one, follows the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(line_dedup.without_repeated_lines(docs), docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(repeats.remove_repeats(docs, PASSAGE), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("repeats", remove_repeats),
    ("packing", pack),
]

# The classifier, the tokenizer and the fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
