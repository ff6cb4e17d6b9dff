"""What retention removes (W-3, J-6, AG-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_of_project(builds: DataFrame) -> DataFrame:
    """W-3: newest build of each project, as an aggregate with a map-side combine.

    Among builds of the newest instant the smallest key is taken.
    """
    instants = builds.groupBy("project", "received_at").agg(
        F.min_by(F.struct("day", "build_key"), "build_key").alias("build")
    )
    return (
        instants.groupBy("project")
        .agg(F.max_by("build", "received_at").alias("build"))
        .select("project", "build.day", "build.build_key")
    )


def _old(keep_days: int, now: Column) -> Column:
    return F.col("received_at") < now - F.expr(f"INTERVAL {int(keep_days)} DAYS")


def prunable_builds(builds: DataFrame, keep_days: int, now: Column) -> DataFrame:
    """J-6: old builds that are not their project's newest; equals what is deleted."""
    keep = newest_of_project(builds).select("day", "build_key")
    return (
        builds.where(_old(keep_days, now))
        .select("day", "build_key", "received_at")
        .join(keep, ["day", "build_key"], "left_anti")
    )


def droppable_days(builds: DataFrame, keep_days: int, now: Column) -> DataFrame:
    """AG-16: days in which every build is prunable."""
    newest = newest_of_project(builds).select("day", "build_key", F.lit(True).alias("_newest"))
    return (
        builds.select("day", "build_key", _old(keep_days, now).alias("_old"))
        .join(newest, ["day", "build_key"], "left")
        .groupBy("day")
        .agg(
            F.bool_and("_old").alias("_all_old"),
            F.bool_or(F.coalesce("_newest", F.lit(False))).alias("_has_newest"),
        )
        .where(F.col("_all_old") & ~F.col("_has_newest"))
        .select("day")
    )
