"""Build verdict as a view over append-only facts (AG-31, PF-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def produces_test_bundle(steps: DataFrame) -> DataFrame:
    """PF-7: one row per build with a step whose title names a test bundle."""
    return (
        steps.where(F.contains("title", F.lit(".xctest")))
        .select("day", "build_key")
        .distinct()
    )


def stored_status(
    builds: DataFrame, tests: DataFrame, steps: DataFrame, troubled: DataFrame | None = None
) -> DataFrame:
    """AG-31: the status a reader sees.

    Any failed attempt fails the build, and so does a build listed in
    ``troubled`` (an error or a crash in its log). A succeeded compile with a
    test bundle and no results yet is pending; results without a failure resolve
    a pending build. A failed build never turns green.
    """
    outcome = tests.groupBy("day", "build_key").agg(
        F.bool_or(F.col("status") == "failed").alias("_test_failed"),
        F.count(F.lit(1)).alias("_results"),
    )
    bundle = produces_test_bundle(steps).withColumn("_bundle", F.lit(True))
    joined = builds.join(outcome, ["day", "build_key"], "left").join(
        bundle, ["day", "build_key"], "left"
    )
    failing = F.coalesce("_test_failed", F.lit(False))
    if troubled is not None:
        marks = troubled.select("day", "build_key").distinct().withColumn("_bad", F.lit(True))
        joined = joined.join(marks, ["day", "build_key"], "left")
        failing = failing | F.coalesce("_bad", F.lit(False))
    results = F.coalesce("_results", F.lit(0))
    verdict = (
        F.when(failing, F.lit("failed"))
        .when((F.col("status") == "pending_tests") & (results > 0), F.lit("succeeded"))
        .when(
            (F.col("status") == "succeeded")
            & (results == 0)
            & F.coalesce("_bundle", F.lit(False)),
            F.lit("pending_tests"),
        )
        .otherwise(F.col("status"))
    )
    return joined.select(
        *(verdict.alias("status") if c == "status" else F.col(c) for c in builds.columns)
    )
