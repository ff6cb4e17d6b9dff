"""Regression detection: two-window trend (W-4) and baseline comparison (BI-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..runtime import maybe_broadcast
from .history import newest_first, recent_builds
from .ordered import carry_last


def _grew(previous: Column, current: Column, floor: float) -> Column:
    delta = current - previous
    return (
        (previous > floor)
        & (delta >= C.REGRESSION_MIN_SECONDS)
        & (delta / previous * 100.0 >= C.REGRESSION_MIN_PERCENT)
    )


def target_regressions(
    builds: DataFrame, targets: DataFrame, last_n: int, top: int, project: str | None = None
) -> DataFrame:
    """W-4: mean of the last N builds against the N before them.

    The ranking sees at most 2N rows: the limit runs before the window.
    """
    ranked = recent_builds(builds, 2 * last_n, project).select(
        "day",
        "build_key",
        F.row_number().over(Window.orderBy(*newest_first())).alias("rank"),
    )
    means = (
        targets.join(maybe_broadcast(ranked, 2 * last_n), ["day", "build_key"])
        .groupBy("name")
        .agg(
            F.avg(F.when(F.col("rank") <= last_n, F.col("seconds"))).alias("current_seconds"),
            F.avg(F.when(F.col("rank") > last_n, F.col("seconds"))).alias("previous_seconds"),
            F.count(F.lit(1)).alias("observations"),
        )
    )
    before, now = F.col("previous_seconds"), F.col("current_seconds")
    return (
        means.where(_grew(before, now, C.REGRESSION_MIN_SECONDS))
        .withColumn("delta_seconds", now - before)
        .withColumn("delta_percent", (now - before) / before * 100.0)
        .withColumn("confidence", F.lit("trend"))
        .orderBy(F.desc("delta_seconds"), "name")
        .limit(top)
    )


BASELINE_COLUMNS = (
    "day",
    "build_key",
    "category",
    "total_seconds",
    "xcode_version",
    "platform",
    "architecture",
)


def previous_builds(builds: DataFrame) -> DataFrame:
    """J-5: for every build the newest earlier build of its project, if any.

    Builds that arrived at the same instant are not each other's baseline: the
    instants are made distinct first, and each looks back one instant. A project
    is cut by day, so a project with a third of all builds is not one task.
    """
    shape = F.struct(*BASELINE_COLUMNS)
    instants = builds.groupBy("project", "received_at").agg(
        F.min_by(shape, "build_key").alias("newest")
    )
    linked = carry_last(
        instants,
        ["project"],
        ["received_at"],
        F.col("newest"),
        "baseline",
        F.to_date("received_at"),
    ).where(F.col("baseline").isNotNull())
    return builds.join(linked.select("project", "received_at", "baseline"), ["project", "received_at"])


def baseline_comparisons(builds: DataFrame) -> DataFrame:
    """BI-1, build level: totals, category change and environment change."""
    changed = F.lit(False)
    for name in ("xcode_version", "platform", "architecture"):
        changed = changed | (
            F.coalesce(F.col(name), F.lit("")) != F.coalesce(F.col(f"baseline.{name}"), F.lit(""))
        )
    return previous_builds(builds).select(
        "day",
        "build_key",
        "project",
        F.col("baseline.day").alias("baseline_day"),
        F.col("baseline.build_key").alias("baseline_build_key"),
        F.col("baseline.total_seconds").alias("previous_seconds"),
        F.col("total_seconds").alias("current_seconds"),
        F.col("baseline.category").alias("previous_category"),
        F.col("category").alias("current_category"),
        (F.col("category") != F.col("baseline.category")).alias("category_changed"),
        changed.alias("environment_changed"),
    )


def slower_targets(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """J-4: targets of both builds of a pair that took longer, same cache state."""
    mine = targets.select(
        "day",
        "build_key",
        "name",
        F.col("seconds").alias("current_target_seconds"),
        F.col("fetched_from_cache").alias("_cached_now"),
    )
    theirs = targets.select(
        F.col("day").alias("baseline_day"),
        F.col("build_key").alias("baseline_build_key"),
        "name",
        F.col("seconds").alias("previous_target_seconds"),
        F.col("fetched_from_cache").alias("_cached_before"),
    )
    return (
        pairs.join(mine, ["day", "build_key"])
        .join(theirs, ["baseline_day", "baseline_build_key", "name"])
        .where(
            (F.col("current_target_seconds") > F.col("previous_target_seconds"))
            & (F.col("_cached_now") == F.col("_cached_before"))
        )
        .drop("_cached_now", "_cached_before")
    )


def baseline_regressions(builds: DataFrame, targets: DataFrame) -> DataFrame:
    """BI-1, target level, for every build that has a baseline."""
    pairs = baseline_comparisons(builds).where(~F.col("category_changed"))
    before, now = F.col("previous_target_seconds"), F.col("current_target_seconds")
    shifted = F.col("environment_changed")
    return (
        slower_targets(pairs, targets)
        .where(_grew(before, now, 0.0))
        .select(
            "day",
            "build_key",
            "baseline_build_key",
            "project",
            F.lit("target").alias("metric_kind"),
            "name",
            before.alias("previous_seconds"),
            now.alias("current_seconds"),
            (now - before).alias("delta_seconds"),
            ((now - before) / before * 100.0).alias("delta_percent"),
            F.when(shifted, F.lit("low")).otherwise(F.lit("high")).alias("confidence"),
            F.when(shifted, F.array(F.lit("environment_shifted")))
            .otherwise(F.array().cast("array<string>"))
            .alias("caveats"),
            F.when(shifted, F.lit("environment changed between these builds"))
            .otherwise(F.lit("slower than the previous build of this project"))
            .alias("reason"),
        )
    )
