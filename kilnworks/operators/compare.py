"""Differences between two builds' sets of facts (SO-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_differences(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """New, resolved and existing facts of each build against its baseline.

    ``pairs(build_key, baseline_build_key)``; ``facts(build_key, fact)``.
    """
    distinct = facts.select("build_key", "fact").distinct()
    now = pairs.join(distinct, "build_key").withColumn("_now", F.lit(True))
    before = pairs.join(
        distinct.withColumnRenamed("build_key", "baseline_build_key"), "baseline_build_key"
    ).withColumn("_before", F.lit(True))
    keys = ["build_key", "baseline_build_key", "fact"]
    return now.join(before, keys, "full").select(
        *keys,
        F.when(F.col("_before").isNull(), F.lit("new"))
        .when(F.col("_now").isNull(), F.lit("resolved"))
        .otherwise(F.lit("existing"))
        .alias("change"),
    )
