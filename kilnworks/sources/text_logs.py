"""Text-log scan (SRC-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.ordered import number_rows


def read_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, line_no, line) of every line, blank ones included.

    Files are split like any text file. A line's number is its place in its
    split plus the lines of the splits before it, so no file is read whole.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("log_id"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seen"),
        F.col("value").alias("line"),
    )
    numbered = number_rows(lines, ["log_id"], [F.asc("_seen")], "line_no", F.col("_block"))
    return numbered.select("log_id", "line_no", "line")


def content_lines(raw: DataFrame) -> DataFrame:
    """Trimmed lines; blank ones are dropped but keep their number."""
    return raw.withColumn("line", strip(F.col("line"))).where(F.length("line") > 0)


def unreadable_logs(raw: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """Logs that cannot be analysed: result bundles, and logs without content.

    ``inventory(log_id)`` adds files that have no line at all.
    """
    logs = raw.select("log_id")
    if inventory is not None:
        logs = logs.unionByName(inventory.select("log_id"))
    full = content_lines(raw).select("log_id").distinct()
    bundle = F.endswith("log_id", F.lit(".xcresult"))
    empty = logs.distinct().join(full.withColumn("_full", F.lit(True)), "log_id", "left")
    return empty.where(bundle | F.col("_full").isNull()).select(
        "log_id",
        F.when(bundle, F.lit("result bundles are not text logs"))
        .otherwise(F.lit("no content"))
        .alias("reason"),
    )


def read_text_logs(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: content lines of all readable logs under a path."""
    lines = content_lines(read_raw_lines(spark, path))
    return lines.where(~F.endswith("log_id", F.lit(".xcresult")))
