"""Panels over the stored build history (PF-1..3, 9..11, J-1..3, AG-1..22, T-1..4).

Every function takes the stored tables as DataFrames. ``project=None`` (or an
empty string) means all projects. Recency is arrival order, ties by build key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.activity import rounded_epoch
from ..runtime import maybe_broadcast
from .ordered import top_per_key
from .percentiles import exact_percentiles

P50_P95 = {"p50": 0.5, "p95": 0.95}


def newest_first() -> list[Column]:
    return [F.col("received_at").desc_nulls_last(), F.col("build_key").asc()]


def in_project(builds: DataFrame, project: str | None) -> DataFrame:
    """PF-1."""
    return builds.where(F.col("project") == project) if project else builds


def in_days(df: DataFrame, days: int, as_of: Column) -> DataFrame:
    """PF-2: the window includes the day exactly ``days`` back."""
    return df.where(F.col("day") >= F.date_sub(as_of, days))


def recent_builds(builds: DataFrame, last_n: int, project: str | None = None) -> DataFrame:
    """The last N builds by arrival."""
    return in_project(builds, project).orderBy(*newest_first()).limit(last_n)


def of_recent(
    child: DataFrame, builds: DataFrame, last_n: int, project: str | None = None
) -> DataFrame:
    """J-1: child rows of the last N builds; joining on day prunes partitions."""
    recent = recent_builds(builds, last_n, project).select("day", "build_key")
    return child.join(maybe_broadcast(recent, last_n), ["day", "build_key"])


def find_builds(builds: DataFrame, wanted: DataFrame) -> DataFrame:
    """PF-3: rows of the wanted keys; an unknown key simply has no row."""
    return builds.join(wanted.select("build_key").distinct(), "build_key", "left_semi")


def search_builds(builds: DataFrame, query: str = "", only_failures: bool = False) -> DataFrame:
    """PF-9."""
    status = F.lower(F.coalesce("status", F.lit("")))
    text = F.lower(
        F.concat_ws(
            " ",
            "build_key",
            *(F.coalesce(c, F.lit("")) for c in ("project", "scheme", "status")),
        )
    )
    found = builds
    if only_failures:
        found = found.where(F.contains(status, F.lit("fail")))
    if query:
        found = found.where(F.contains(text, F.lit(query.lower())))
    return found


def masked(builds: DataFrame, attribution: Column) -> DataFrame:
    """PF-10: identity columns the attribution tier does not allow become null."""
    return builds.withColumns(
        {
            "machine_id": F.when(
                attribution.isin("pseudonymous", "identified"), F.col("machine_id")
            ),
            "build_user": F.when(attribution == "identified", F.col("build_user")),
            "build_host": F.when(attribution == "identified", F.col("build_host")),
        }
    )


def projects(builds: DataFrame) -> DataFrame:
    """AG-1."""
    counted = builds.groupBy("project").agg(F.count(F.lit(1)).alias("builds"))
    return counted.orderBy(F.desc("builds"), F.asc("project"))


def project_day_stats(builds: DataFrame, days: int, as_of: Column) -> DataFrame:
    """AG-2."""
    window = in_days(builds, days, as_of)
    timing = exact_percentiles(window, ["project", "day"], "total_seconds", P50_P95).drop("n")
    counts = window.groupBy("project", "day").agg(
        F.count(F.lit(1)).alias("builds"), F.countDistinct("machine_id").alias("machines")
    )
    return counts.join(timing, ["project", "day"], "left")


def duration_percentiles(
    builds: DataFrame, last_n: int, project: str | None = None
) -> DataFrame:
    """AG-3: one row, also for an empty scope. Holds at most N values."""
    seconds = F.col("total_seconds")
    return (
        recent_builds(builds, last_n, project)
        .agg(
            F.count(F.lit(1)).alias("builds"),
            F.percentile(seconds, 0.5).alias("p50"),
            F.percentile(seconds, 0.95).alias("p95"),
            F.min(seconds).alias("min_seconds"),
            F.max(seconds).alias("max_seconds"),
            F.avg(seconds).alias("avg_seconds"),
        )
        .withColumn("enough_history", F.col("builds") >= C.MIN_HISTORY)
    )


def fleet_percentiles(builds: DataFrame, last_n: int, project: str | None = None) -> DataFrame:
    """AG-4."""
    return duration_percentiles(builds, last_n, project).select(
        "builds", "enough_history", "p50", "p95"
    )


def _by_day(builds: DataFrame) -> DataFrame:
    return exact_percentiles(builds, ["day"], "total_seconds", P50_P95).withColumnRenamed(
        "n", "builds"
    )


def daily_percentiles(
    builds: DataFrame, days: int, as_of: Column, project: str | None = None
) -> DataFrame:
    """AG-5: calendar window, oldest first."""
    return _by_day(in_days(in_project(builds, project), days, as_of)).orderBy("day")


def last_active_days(builds: DataFrame, last_n: int, project: str | None = None) -> DataFrame:
    """AG-6: the last N days that have builds, newest first.

    The days are found first, so percentiles run on the kept days only.
    """
    scoped = in_project(builds, project)
    kept = scoped.select("day").distinct().orderBy(F.desc("day")).limit(last_n)
    inside = scoped.join(maybe_broadcast(kept, last_n), "day", "left_semi")
    return _by_day(inside).orderBy(F.desc("day"))


def _ranked(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"),
        F.avg("seconds").alias("avg_seconds"),
        F.max("seconds").alias("max_seconds"),
    )


def target_trend(
    builds: DataFrame, targets: DataFrame, last_n: int, top: int, project: str | None = None
) -> DataFrame:
    """AG-7."""
    return (
        of_recent(targets, builds, last_n, project)
        .groupBy("name")
        .agg(
            F.count(F.lit(1)).alias("observations"),
            F.avg("seconds").alias("avg_seconds"),
            F.max("seconds").alias("max_seconds"),
            F.count_if("fetched_from_cache").alias("cached_builds"),
        )
        .orderBy(F.desc("avg_seconds"), "name")
        .limit(top)
    )


def phase_trend(
    builds: DataFrame, phases: DataFrame, last_n: int, top: int, project: str | None = None
) -> DataFrame:
    """AG-8."""
    ranked = _ranked(of_recent(phases, builds, last_n, project), "name")
    return ranked.orderBy(F.desc("avg_seconds"), "name").limit(top)


def ranked_targets(builds, targets, last_n, top, project=None) -> DataFrame:
    """AG-9, targets."""
    return phase_trend(builds, targets, last_n, top, project).select(
        "name", "avg_seconds", "max_seconds", "observations"
    )


def ranked_phases(builds, phases, last_n, top, project=None) -> DataFrame:
    """AG-9, phases."""
    return ranked_targets(builds, phases, last_n, top, project)


def slowest_targets(targets: DataFrame, days: int, as_of: Column, top: int) -> DataFrame:
    """AG-10."""
    ranked = _ranked(in_days(targets, days, as_of), "name")
    return ranked.orderBy(F.desc("avg_seconds"), "name").limit(top)


def slowest_files(
    builds: DataFrame, files: DataFrame, last_n: int, top: int, project: str | None = None
) -> DataFrame:
    """AG-11."""
    return (
        of_recent(files, builds, last_n, project)
        .groupBy("file")
        .agg(
            F.max("target").alias("target"),
            F.count(F.lit(1)).alias("observations"),
            F.avg("seconds").alias("avg_seconds"),
            F.max("seconds").alias("max_seconds"),
            F.sum("occurrences").alias("compilations"),
        )
        .orderBy(F.desc("avg_seconds"), "file")
        .limit(top)
    )


def slowest_swift_sites(
    builds: DataFrame, timings: DataFrame, last_n: int, top: int, project: str | None = None
) -> DataFrame:
    """AG-12."""
    return (
        of_recent(timings, builds, last_n, project)
        .groupBy("file", "line", "kind")
        .agg(
            F.max("symbol").alias("symbol"),
            F.count(F.lit(1)).alias("observations"),
            F.avg("milliseconds").alias("avg_milliseconds"),
            F.max("milliseconds").alias("max_milliseconds"),
            F.max("target").alias("target"),
        )
        .orderBy(F.desc("avg_milliseconds"), "file", "line", "kind")
        .limit(top)
    )


def diagnostic_trend(
    builds: DataFrame, diagnostics: DataFrame, last_n: int, project: str | None = None
) -> DataFrame:
    """AG-13 over J-3: builds without diagnostics count zero; oldest first."""
    recent = recent_builds(builds, last_n, project).select(
        "day",
        "build_key",
        "received_at",
        rounded_epoch(F.col("started_at"), F.col("received_at")).alias("recorded_at"),
    )
    keys = recent.select("day", "build_key")
    weight = F.col("occurrences")
    counts = (
        diagnostics.join(maybe_broadcast(keys, last_n), ["day", "build_key"], "left_semi")
        .groupBy("day", "build_key")
        .agg(
            F.sum(F.when(F.col("severity") == "warning", weight)).alias("warnings"),
            F.sum(F.when(F.col("severity").isin("error", "fatal"), weight)).alias("errors"),
            F.count("fingerprint").alias("unique_diagnostics"),
        )
    )
    return (
        recent.join(counts, ["day", "build_key"], "left")
        .orderBy("received_at", F.desc("build_key"))
        .select(
            "build_key",
            "recorded_at",
            *(
                F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
                for c in ("warnings", "errors", "unique_diagnostics")
            ),
        )
    )


def diagnostic_clusters(
    builds: DataFrame, diagnostics: DataFrame, last_n: int, top: int, project: str | None = None
) -> DataFrame:
    """AG-14. One row per (build, fingerprint) is stored, so builds are counted
    after a first grouping by both."""
    per_build = (
        of_recent(diagnostics, builds, last_n, project)
        .groupBy("fingerprint", "build_key")
        .agg(
            *(F.max(c).alias(c) for c in ("severity", "category", "message", "file")),
            F.sum("occurrences").alias("occurrences"),
        )
    )
    return (
        per_build.groupBy("fingerprint")
        .agg(
            *(F.max(c).alias(c) for c in ("severity", "category", "message", "file")),
            F.count(F.lit(1)).alias("builds"),
            F.sum("occurrences").alias("occurrences"),
        )
        .orderBy(F.desc("builds"), F.desc("occurrences"), "fingerprint")
        .limit(top)
    )


def flaky_tests(
    builds: DataFrame, tests: DataFrame, last_n: int, top: int, project: str | None = None
) -> DataFrame:
    """AG-15: the tests that failed, those retried in most builds first."""
    failing = failing_tests(builds, tests, last_n, project)
    return failing.orderBy(F.desc("retried_builds"), F.desc("failed"), "suite", "name").limit(top)


def failing_tests(
    builds: DataFrame, tests: DataFrame, last_n: int, project: str | None = None
) -> DataFrame:
    """AG-15, all tests that failed: outcomes per build first, then over builds."""
    failed, passed = F.col("status") == "failed", F.col("status") == "passed"
    per_build = (
        of_recent(tests, builds, last_n, project)
        .groupBy("suite", "name", "build_key")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.count_if(failed).alias("failed"),
            F.count_if(passed).alias("passed"),
            F.avg("seconds").alias("avg_seconds"),
        )
    )
    return (
        per_build.groupBy("suite", "name")
        .agg(
            F.sum("runs").alias("runs"),
            F.sum("failed").alias("failed"),
            F.sum("passed").alias("passed"),
            F.avg("avg_seconds").alias("avg_seconds"),
            F.count_if((F.col("failed") > 0) & (F.col("passed") > 0)).alias("retried_builds"),
        )
        .where(F.col("failed") > 0)
        .withColumn("flaky", F.col("passed") > 0)
    )


def environment_mix(builds: DataFrame, last_n: int, project: str | None = None) -> DataFrame:
    """AG-17."""
    known = [
        F.coalesce(c, F.lit("unknown")).alias(c)
        for c in ("xcode_version", "platform", "architecture")
    ]
    return (
        recent_builds(builds, last_n, project)
        .select(*known, "machine_id", "total_seconds")
        .groupBy("xcode_version", "platform", "architecture")
        .agg(
            F.count(F.lit(1)).alias("builds"),
            F.countDistinct("machine_id").alias("machines"),
            F.avg("total_seconds").alias("avg_seconds"),
        )
        .orderBy(F.desc("builds"), "xcode_version", "platform", "architecture")
    )


def people(builds: DataFrame, last_n: int, project: str | None = None) -> DataFrame:
    """AG-18 over PF-11: builds without a user do not use up the window."""
    named = builds.where(F.col("build_user").isNotNull())
    return (
        recent_builds(named, last_n, project)
        .groupBy(F.col("build_user").alias("user"))
        .agg(
            F.count(F.lit(1)).alias("builds"),
            F.countDistinct(F.coalesce("build_host", "machine_id")).alias("machines"),
            F.avg("total_seconds").alias("avg_seconds"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        )
        .orderBy(F.desc("builds"), "user")
    )


def final_attempts(tests: DataFrame) -> DataFrame:
    """W-2: the last attempt of each test of each build."""
    return tests.groupBy("day", "build_key", "suite", "name").agg(
        F.max_by("status", "attempt").alias("status")
    )


def test_totals(tests: DataFrame) -> DataFrame:
    """AG-19: distinct tests, last-attempt failures, seconds over all attempts."""
    per_test = tests.groupBy("day", "build_key", "suite", "name").agg(
        F.max_by("status", "attempt").alias("status"), F.sum("seconds").alias("seconds")
    )
    return per_test.groupBy("day", "build_key").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"),
    )


def step_totals(steps: DataFrame) -> DataFrame:
    """AG-20."""
    return steps.groupBy("day", "build_key").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("executed").alias("executed"),
        F.coalesce(F.sum(F.when(F.col("executed"), F.col("seconds"))), F.lit(0.0)).alias(
            "executed_seconds"
        ),
    )


def test_rollup(tests: DataFrame) -> DataFrame:
    """AG-21 over J-7: one row per test, nothing correlated."""
    return tests.groupBy("day", "build_key", "suite", "name").agg(
        F.max_by("status", "attempt").alias("status"),
        F.sum("seconds").alias("seconds"),
        F.max_by(
            "message", F.when(F.col("message").isNotNull(), F.col("attempt"))
        ).alias("message"),
        F.count(F.lit(1)).alias("attempts"),
        F.bool_or(F.col("status") == "failed").alias("any_failed"),
    )


def git_context(
    builds: DataFrame, metadata: DataFrame, last_n: int, project: str | None = None
) -> DataFrame:
    """AG-22 over J-3."""
    recent = recent_builds(builds, last_n, project).select(
        "day",
        "build_key",
        "received_at",
        rounded_epoch(F.col("started_at"), F.col("received_at")).alias("recorded_at"),
        "total_seconds",
        "category",
    )
    fields = {"branch": "git.branch", "commit": "git.commit", "dirty": "git.dirty"}
    keys = recent.select("day", "build_key")
    pivoted = (
        metadata.where(F.col("key").isin(*fields.values()))
        .join(maybe_broadcast(keys, last_n), ["day", "build_key"], "left_semi")
        .groupBy("day", "build_key")
        .agg(
            *(
                F.max(F.when(F.col("key") == key, F.col("value"))).alias(name)
                for name, key in fields.items()
            )
        )
    )
    return (
        recent.join(pivoted, ["day", "build_key"], "left")
        .orderBy(*newest_first())
        .select("build_key", "recorded_at", "total_seconds", "category", *fields)
    )


def overview(
    recent: DataFrame, trend: DataFrame, failed_tests: DataFrame
) -> DataFrame:
    """AG-42: one row; the failed count is null while no build has a verdict.

    ``failed_tests`` is every test of :func:`failing_tests`, not a list cut to its top.
    """
    failing = F.contains(F.lower(F.coalesce("status", F.lit(""))), F.lit("fail"))
    builds = recent.agg(
        F.count(F.lit(1)).alias("builds"),
        F.count("status").alias("_known"),
        F.count_if(failing).alias("_failed"),
        F.count_if(F.col("status") == "pending_tests").alias("pending_builds"),
    )
    mean = trend.agg(F.avg("total_seconds").alias("avg_seconds"))
    tests = failed_tests.agg(
        F.count_if("flaky").alias("flaky_tests"),
        F.count_if(F.col("retried_builds") > 0).alias("retried_tests"),
    )
    one = F.lit(1)
    return (
        builds.withColumn("_k", one)
        .join(mean.withColumn("_k", one), "_k")
        .join(tests.withColumn("_k", one), "_k")
        .select(
            "builds",
            "avg_seconds",
            (F.col("_known") > 0).alias("knows_status"),
            F.when(F.col("_known") > 0, F.col("_failed")).alias("failed_builds"),
            "pending_builds",
            "flaky_tests",
            "retried_tests",
        )
    )


def duration_trend(builds: DataFrame, last_n: int, project: str | None = None) -> DataFrame:
    """T-1: the last N builds, oldest first."""
    return (
        recent_builds(builds, last_n, project)
        .orderBy("received_at", F.desc("build_key"))
        .select(
            "build_key",
            rounded_epoch(F.col("started_at"), F.col("received_at")).alias("recorded_at"),
            "project",
            "category",
            "total_seconds",
            "cache_hit_rate",
        )
    )


def build_list(builds: DataFrame, tests: DataFrame, last_n: int = 100) -> DataFrame:
    """T-2 over J-2: the newest builds with their test counts, zero when none."""
    recent = recent_builds(builds, last_n)
    keys = recent.select("day", "build_key")
    mine = tests.join(maybe_broadcast(keys, last_n), ["day", "build_key"], "left_semi")
    counts = test_totals(mine).select(
        "day",
        "build_key",
        F.col("total").alias("total_tests"),
        F.col("failed").alias("failed_tests"),
    )
    return (
        recent.join(counts, ["day", "build_key"], "left")
        .orderBy(*newest_first())
        .select(
            "build_key",
            rounded_epoch(F.col("started_at"), F.col("received_at")).alias("recorded_at"),
            "project",
            "category",
            "total_seconds",
            "cache_hit_rate",
            "status",
            "error_count",
            "warning_count",
            "scheme",
            F.coalesce("total_tests", F.lit(0)).alias("total_tests"),
            F.coalesce("failed_tests", F.lit(0)).alias("failed_tests"),
        )
    )


def fleet_build_list(builds: DataFrame, last_n: int) -> DataFrame:
    """T-2, fleet form: recorded_at keeps its fraction."""
    return recent_builds(builds, last_n).select(
        "build_key",
        "day",
        "project",
        "category",
        "total_seconds",
        "cache_hit_rate",
        "machine_id",
        "xcode_version",
        "platform",
        "architecture",
        F.coalesce("started_at", F.unix_micros("received_at") / F.lit(1e6)).alias(
            "recorded_at"
        ),
        "error_count",
        "warning_count",
        "status",
    )


# T-3: the ordered child lists of the build detail, for any set of builds. Every list is
# ranked per build with a full tie-break, up to the limit that the caller gives.

BUILD = ["day", "build_key"]


def detail_targets(targets: DataFrame, limit: int) -> DataFrame:
    return top_per_key(
        targets, BUILD, [F.desc("seconds"), F.asc("name")], limit, "position"
    )


def detail_phases(phases: DataFrame, limit: int) -> DataFrame:
    return top_per_key(
        phases, BUILD, [F.desc("seconds"), F.asc("name")], limit, "position"
    )


def detail_files(files: DataFrame, limit: int) -> DataFrame:
    order = [F.desc("seconds"), F.asc("file"), F.asc("architecture")]
    return top_per_key(files, BUILD, order, limit, "position")


def detail_swift_timings(timings: DataFrame, limit: int) -> DataFrame:
    order = [F.desc("milliseconds"), *map(F.asc, ("kind", "file", "line", "column_number"))]
    return top_per_key(timings, BUILD, order, limit, "position")


def detail_diagnostics(
    diagnostics: DataFrame, limit: int, first_severities: tuple[str, ...] = ("error",)
) -> DataFrame:
    order = [
        F.col("severity").isin(*first_severities).desc(),
        F.desc("occurrences"),
        F.asc("fingerprint"),
    ]
    return top_per_key(diagnostics, BUILD, order, limit, "position")


def detail_tests(tests: DataFrame, limit: int) -> DataFrame:
    order = [
        F.desc("any_failed"),
        F.col("seconds").desc_nulls_last(),
        F.asc("suite"),
        F.asc("name"),
    ]
    return top_per_key(test_rollup(tests), BUILD, order, limit, "position")


def detail_steps(steps: DataFrame, limit: int) -> DataFrame:
    return top_per_key(steps, BUILD, [F.asc("ordinal")], limit, "position")


def detail_header(builds: DataFrame) -> DataFrame:
    """T-3 and T-4: the build row itself."""
    return builds.withColumn(
        "recorded_at", rounded_epoch(F.col("started_at"), F.col("received_at"))
    )


def detail_children(children: DataFrame, wanted: DataFrame) -> DataFrame:
    """T-4: every child row of the wanted builds, slowest first inside a build."""
    keys = wanted.select("day", "build_key").distinct()
    return children.join(keys, BUILD, "left_semi").orderBy(
        "build_key", F.desc("seconds"), "name"
    )
