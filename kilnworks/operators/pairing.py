"""Text logs paired with activity logs of the same builds (J-13)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUILD = ["build_key"]


@dataclass(frozen=True)
class Side:
    """What one kind of log says: which builds have one, and its facts by ``build_key``.

    A log that could not be read has a row in ``logs`` and no row in ``metrics``.
    """

    logs: DataFrame
    metrics: DataFrame
    timings: DataFrame
    diagnostics: DataFrame


@dataclass(frozen=True)
class Paired:
    """One analysis per build; each row says in ``origin`` which log it is from."""

    metrics: DataFrame
    timings: DataFrame
    diagnostics: DataFrame


def _of(rows: DataFrame, origin: str) -> DataFrame:
    return rows.withColumn("origin", F.lit(origin))


def _only(rows: DataFrame, builds: DataFrame) -> DataFrame:
    return rows.join(builds.select(*BUILD).distinct(), BUILD, "left_semi")


def _but(rows: DataFrame, builds: DataFrame) -> DataFrame:
    return rows.join(builds.select(*BUILD).distinct(), BUILD, "left_anti")


def _both(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second, allowMissingColumns=True)


def paired(text: Side, activity: Side) -> Paired:
    """J-13, for all builds at once.

    Metrics are the activity log's wherever a build has one, and then stay away if it
    could not be read; else the text log's. Timings go with metrics: the activity log's,
    or the text log's where it has none. Diagnostics are the text log's, or where it
    has none those of an activity log that could be read.
    """
    read = _only(activity.metrics, activity.logs)
    text_metrics = _but(_only(text.metrics, text.logs), activity.logs)
    metrics = _both(_of(read, "activity"), _of(text_metrics, "text"))
    timings = _only(activity.timings, read)
    spare = _but(_only(_only(text.timings, text.logs), metrics), timings)
    diagnostics = _only(text.diagnostics, text.logs)
    other = _but(_only(activity.diagnostics, read), diagnostics)
    return Paired(
        metrics,
        _both(_of(timings, "activity"), _of(spare, "text")),
        _both(_of(diagnostics, "text"), _of(other, "activity")),
    )


def pairing_summary(result: Paired) -> DataFrame:
    """Per build where its metrics, timings and diagnostics are from, and how many."""

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*BUILD).agg(
            F.min("origin").alias(f"{name}_from"), F.count(F.lit(1)).alias(name)
        )

    def number(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).alias(name)

    joined = (
        counted(result.metrics, "metrics")
        .join(counted(result.timings, "timings"), BUILD, "full")
        .join(counted(result.diagnostics, "diagnostics"), BUILD, "full")
    )
    columns = [c for n in ("metrics", "timings", "diagnostics") for c in (F.col(f"{n}_from"), number(n))]
    return joined.select(*BUILD, *columns)
