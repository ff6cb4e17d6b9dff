"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import scratch_path

# The white space that separates words in every contract here.
SPACES = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_batch(
    df: DataFrame, handle: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema
) -> DataFrame:
    """Apply a function that keeps no state from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from handle(batch)

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null becomes the empty string."""
    return [text or "" for text in column.to_pylist()]


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stored_by(df: DataFrame, label: str, key: str) -> DataFrame:
    """Like :func:`stored`, in buckets of the key: later joins on it leave it in place."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


def packed(array: np.ndarray) -> bytes:
    """An array's bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def under_safe_names(
    docs: DataFrame, needed: Iterable[str], run: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Apply an operator that keeps columns, those it doesn't need under names of their own.

    What such columns are called can then neither hide nor break a column of the operator.
    """
    safe = {name: name if name in needed else f"extra_{at}" for at, name in enumerate(docs.columns)}
    names = {other: name for name, other in safe.items()}
    out = run(docs.toDF(*safe.values()))
    return out.toDF(*(names.get(name, name) for name in out.columns))
