"""Log inventory: candidate logs under a root (SRC-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import project_of_log

# Build logs of a project and of its archives; package-resolution logs are not builds.
BUILD_LOGS = (
    r"/([^/]+)/(?:Build/Intermediates\.noindex/ArchiveIntermediates/[^/]+/)?"
    r"Logs/Build/[^/]+\.xcactivitylog$"
)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified_at, bytes) of every file; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(
            "path",
            F.col("modificationTime").alias("modified_at"),
            F.col("length").alias("bytes"),
        )
    )


def build_logs(files: DataFrame, project_prefix: str | None = None) -> DataFrame:
    """Activity logs of builds, with their project; newest first."""
    directory = F.regexp_extract("path", BUILD_LOGS, 1)
    found = files.where(F.col("path").rlike(BUILD_LOGS)).withColumn("directory", directory)
    if project_prefix:
        found = found.where(F.startswith("directory", F.lit(project_prefix)))
    return found.withColumn(
        "project", project_of_log(F.concat(F.lit("/"), "directory", F.lit("/Logs/x")))
    ).orderBy(F.desc("modified_at"), "path")


def newest_logs(logs: DataFrame) -> DataFrame:
    """The newest log of each project."""
    return logs.groupBy("project").agg(
        F.max_by("path", F.struct("modified_at", "path")).alias("path"),
        F.max("modified_at").alias("modified_at"),
    )
