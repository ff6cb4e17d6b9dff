"""Metadata providers (UD-2) and redaction of stored tables (SF-27)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import redact_path
from ..functions.redaction import redact_text, redact_value
from ..runtime import written

ENTRY = "build_key string, key string, value string"
WARNING = "provider string, warning string"


# What an error says that comes from the cluster and not from a provider.
CLUSTER_FAILURES = (
    "ExecutorLostFailure",
    "executor lost",
    "FetchFailed",
    "SparkContext was shut down",
    "stopped SparkContext",
    "No space left on device",
)


@dataclass(frozen=True)
class Provider:
    """A named source of (build_key, key, value) rows."""

    name: str
    collect: Callable[[DataFrame], DataFrame]


def run_providers(
    spark: SparkSession, providers: list[Provider], builds: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """UD-2: (entries, warnings). Keys and values are redacted; a later provider
    wins a repeated key; a failing provider becomes a warning. A failure of the cluster
    is none of a provider's and ends the job, so that it can be repeated.

    Each provider's rows are written on their own, so its failure is seen here
    and does not stop the others.
    """
    collected = None
    warnings: list[tuple[str, str]] = []
    for place, provider in enumerate(providers):
        try:
            rows, _ = written(
                provider.collect(builds).select(
                    "build_key",
                    redact_value(F.col("key")).alias("key"),
                    redact_value(F.col("value")).alias("value"),
                    F.lit(place).alias("_place"),
                ),
                "provider",
            )
        except Exception as error:  # a provider may fail in any way
            if any(said in str(error) for said in CLUSTER_FAILURES):
                raise
            warnings.append((provider.name, str(error).splitlines()[0]))
            continue
        collected = rows if collected is None else collected.unionByName(rows)
    reported = spark.createDataFrame(warnings, WARNING).select(
        "provider",
        redact_value(F.concat_ws(": ", "provider", "warning")).alias("warning"),
    )
    if collected is None:
        return spark.createDataFrame([], ENTRY), reported
    entries = collected.groupBy("build_key", "key").agg(
        F.max_by("value", F.struct("_place", "value")).alias("value")
    )
    return entries, reported


# Which rule scrubs which text column of a stored table.
REDACTED_COLUMNS: dict[str, dict[str, str]] = {
    "builds": {"project": "text", "machine_id": "text", "scheme": "text", "build_host": "text"},
    "build_targets": {"name": "text"},
    "build_phases": {"name": "text"},
    "build_files": {"file": "path", "target": "text"},
    "build_swift_timings": {"file": "path", "symbol": "text"},
    "build_diagnostics": {"file": "path", "message": "text", "target": "text", "fingerprint": "text"},
    "build_steps": {"title": "text", "file": "path", "fingerprint": "path"},
    "build_tests": {"message": "text"},
    "build_metadata": {"key": "value", "value": "value"},
}


def redacted_table(rows: DataFrame, table: str, root: str | None = None) -> DataFrame:
    """SF-27: every column that could carry a path or a secret, scrubbed."""
    rules = {
        "text": redact_text,
        "path": lambda column: redact_path(column, root),
        "value": redact_value,
    }
    return rows.withColumns(
        {
            name: rules[rule](F.col(name))
            for name, rule in REDACTED_COLUMNS[table].items()
            if name in rows.columns
        }
    )
