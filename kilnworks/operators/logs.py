"""Text-log analysis, all logs in one job.

Input is ``lines(log_id, line_no, line)`` with trimmed, non-blank lines. Each
line is claimed once, by the first handler that recognises it. Stateful rules
(the current test, the pending assertion, the last target) run over the few
lines that take part, chunked along the log, never over whole logs in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import diagnostics as D
from ..functions import loglines as L
from ..functions import tests as X
from ..runtime import written
from .ordered import carry_last, line_chunk, top_per_key

LOG = ["log_id"]
AT = ["log_id", "line_no"]


def _claim(line: Column) -> Column:
    """Handler of a line that no graph rule claims."""
    return (
        F.when(D.is_diagnostic_line(line), F.lit("diagnostic"))
        .when(X.assertion(line).isNotNull(), F.lit("assertion"))
        .when(X.is_started_line(line), F.lit("started"))
        .when(X.is_xctest_line(line), F.lit("xctest"))
        .when(X.is_swift_testing_line(line), F.lit("swift_testing"))
        .when(F.contains(line, F.lit("Restarting after unexpected exit")), F.lit("restart"))
        .when(X.is_crash_line(line), F.lit("crash"))
        .when(
            F.contains(line, F.lit("elapsed")) & X.elapsed(line).isNotNull(), F.lit("elapsed")
        )
    )


def routed(lines: DataFrame) -> DataFrame:
    """Adds ``kind``: the handler that claims the line, null for none.

    A dependency line counts only after a target line of its log; the few that
    come earlier are offered to the other handlers.
    """
    line = F.col("line")
    looks = L.looks_like_graph(line)
    first = (
        F.when(looks & L.declared_targets(line).isNotNull(), F.lit("graph_declared"))
        .when(looks & L.graph_target(line).isNotNull(), F.lit("graph_target"))
        .when(looks & L.is_dependency_line(line), F.lit("graph_dependency"))
    )
    settled = lines.withColumn("kind", F.coalesce(first, _claim(line)))
    maybe = lines.where(L.looks_like_graph(line)).withColumn("kind", first)
    opening = (
        maybe.where(F.col("kind") == "graph_target")
        .groupBy(*LOG)
        .agg(F.min("line_no").alias("_opens"))
    )
    dependency = (
        maybe.where(F.col("kind") == "graph_dependency")
        .join(opening, LOG, "left")
        .withColumn(
            "kind",
            F.when(F.col("_opens") < F.col("line_no"), F.col("kind")).otherwise(_claim(line)),
        )
        .drop("_opens")
    )
    others = settled.where(~F.col("kind").eqNullSafe(F.lit("graph_dependency")))
    return others.unionByName(dependency)


def ingested(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines and routed events as written tables.

    Every analysis below reads the events more than once; the patterns of the
    routing run once, here.
    """
    stored, _ = written(lines, "log-lines")
    events, _ = written(routed(stored), "log-events")
    return stored, events


def _of_kind(events: DataFrame, *kinds: str) -> DataFrame:
    return events.where(F.col("kind").isin(*kinds))


# Diagnostics


def log_diagnostics(events: DataFrame) -> DataFrame:
    """One row per diagnostic line, with category and fingerprint."""
    rows = _of_kind(events, "diagnostic").select(*AT, D.parse(F.col("line")).alias("_d"))
    return with_fingerprint(rows.select(*AT, "_d.*"))


def with_fingerprint(rows: DataFrame) -> DataFrame:
    """Adds category and fingerprint to rows with severity, file and message."""
    marked = rows.withColumn("category", D.classify(F.col("message")))
    return marked.withColumn(
        "fingerprint",
        D.fingerprint(*(F.col(c) for c in ("category", "severity", "file", "message"))),
    )


def deduplicated(diagnostics: DataFrame, order: str = "line_no", keys=None) -> DataFrame:
    """AG-23: one row per fingerprint, the earliest example and the count."""
    keys = keys or LOG
    example = F.struct(
        *(c for c in ("file", "line", "column", "message", "target") if c in diagnostics.columns)
    )
    return (
        diagnostics.groupBy(*keys, "fingerprint", "severity", "category")
        .agg(
            F.count(F.lit(1)).alias("occurrences"),
            F.min_by(example, order).alias("_example"),
            F.min(order).alias("first_seen"),
        )
        .select(*keys, "fingerprint", "severity", "category", "occurrences", "first_seen", "_example.*")
    )


def _failing(severity: Column) -> Column:
    return severity.isin("error", "fatal")


def diagnostic_counts(unique: DataFrame, keys=None) -> DataFrame:
    """AG-24: per line and per fingerprint; fatal counts as an error."""
    keys = keys or LOG
    warning, error = F.col("severity") == "warning", _failing(F.col("severity"))
    return unique.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(warning, F.col("occurrences"))), F.lit(0)).alias(
            "raw_warnings"
        ),
        F.coalesce(F.sum(F.when(error, F.col("occurrences"))), F.lit(0)).alias("raw_errors"),
        F.count_if(warning).alias("unique_warnings"),
        F.count_if(error).alias("unique_errors"),
    )


def swift6_blockers(unique: DataFrame) -> DataFrame:
    """AG-25: unique blockers per log and category."""
    return (
        unique.where(F.col("category").isin(*C.SWIFT6_CATEGORIES))
        .groupBy(*LOG, "category")
        .agg(F.count(F.lit(1)).alias("blockers"))
    )


# Tests


def log_tests(events: DataFrame) -> DataFrame:
    """Test results in log order, with message and fingerprint of failures.

    W-8: a failed XCTest result takes the last assertion since the last start or
    failed result of its log. Swift Testing results carry no message.
    """
    line = F.col("line")
    dotted = F.when(F.col("kind") == "xctest", X.xctest_result(line)).when(
        F.col("kind") == "swift_testing", X.swift_testing_result(line)
    )
    note = F.when(F.col("kind").isin("assertion", "diagnostic"), X.assertion(line))
    steps = (
        _of_kind(events, "assertion", "diagnostic", "started", "xctest", "swift_testing")
        .select(*AT, "kind", dotted.alias("_r"), note.alias("_note"))
        .where((F.col("kind") != "diagnostic") | F.col("_note").isNotNull())
    )
    takes = (F.col("kind") == "xctest") & (F.col("_r.status") == "failed")
    state = F.when(
        F.col("_note").isNotNull() | (F.col("kind") == "started") | takes,
        F.struct(F.col("_note").alias("pending")),
    )
    carried = carry_last(steps, LOG, ["line_no"], state, "_state", line_chunk())
    message = F.when(takes, F.col("_state.pending"))
    mark = F.when(
        message.isNotNull(), F.concat(F.lit("XCTEST_ASSERT:"), X.failure_fingerprint(message))
    )
    return carried.where(F.col("_r").isNotNull()).select(
        *AT,
        (F.col("kind") == "xctest").alias("xctest"),
        F.col("_r.suite").alias("suite"),
        F.col("_r.test").alias("name"),
        F.col("_r.status").alias("status"),
        F.col("_r.seconds").alias("seconds"),
        message.alias("message"),
        F.coalesce(mark, F.col("_r.fingerprint")).alias("fingerprint"),
    )


def log_crashes(events: DataFrame) -> DataFrame:
    """W-7: crashes with the most recently started test of their log."""
    line = F.col("line")
    rows = (
        _of_kind(events, "started", "crash", "diagnostic")
        .select(
            *AT,
            "line",
            F.when(F.col("kind") == "started", X.started(line)).alias("_started"),
            F.when(F.col("kind") != "started", X.crash_type(line)).alias("crash_type"),
            (F.col("kind") == "crash").alias("fails_build"),
        )
        .where(F.col("_started").isNotNull() | F.col("crash_type").isNotNull())
    )
    carried = carry_last(rows, LOG, ["line_no"], F.col("_started"), "test", line_chunk())
    return carried.where(F.col("crash_type").isNotNull()).select(
        *AT, "test", "crash_type", F.col("line").alias("message"), "fails_build"
    )


def failure_clusters(tests: DataFrame) -> DataFrame:
    """AG-26: failed XCTests of a log by assertion; members are a table of their own."""
    failed = tests.where(F.col("xctest") & (F.col("status") == "failed"))
    return failed.groupBy(*LOG, "fingerprint").agg(
        F.lit("test_failure").alias("category"),
        F.count(F.lit(1)).alias("members"),
        F.coalesce(F.min_by("message", "line_no"), F.lit("Test assertion failed")).alias(
            "message"
        ),
        F.min("line_no").alias("first_line"),
    )


def cluster_members(tests: DataFrame) -> DataFrame:
    """AG-26: the tests of each cluster, ordered by line."""
    failed = tests.where(F.col("xctest") & (F.col("status") == "failed"))
    return failed.select(
        *LOG, "fingerprint", "line_no", F.concat_ws(":", "suite", "name").alias("test")
    )


def test_summary(events: DataFrame, tests: DataFrame, crashes: DataFrame) -> DataFrame:
    """AG-27: per log, counted before any cap."""
    results = tests.groupBy(*LOG).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "passed").alias("passed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    crashed = crashes.groupBy(*LOG).agg(
        F.count(F.lit(1)).alias("crashed"), F.count_if("fails_build").alias("fatal")
    )
    restarted = (
        _of_kind(events, "restart").groupBy(*LOG).agg(F.count(F.lit(1)).alias("restarted"))
    )
    joined = results.join(crashed, LOG, "full").join(restarted, LOG, "full")
    counts = ("total", "passed", "failed", "crashed", "fatal", "restarted")
    return joined.select(*LOG, *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))


def slowest_tests(tests: DataFrame, limit: int) -> DataFrame:
    """T-5."""
    order = [F.col("seconds").desc_nulls_last(), F.asc("line_no")]
    return top_per_key(tests, LOG, order, limit, "position")


# Timings


def log_timings(lines: DataFrame) -> DataFrame:
    rows = lines.select(*AT, L.timing(F.col("line")).alias("_t"))
    return rows.where(F.col("_t").isNotNull()).select(*AT, "_t.*")


def phase_seconds(timings: DataFrame) -> DataFrame:
    """AG-29, by phase."""
    return timings.groupBy(*LOG, "phase").agg(F.sum("seconds").alias("seconds"))


def target_seconds(timings: DataFrame) -> DataFrame:
    """AG-29, by target, where a target is named."""
    named = timings.where(F.col("target").isNotNull())
    return named.groupBy(*LOG, "target").agg(F.sum("seconds").alias("seconds"))


def slowest_timing_targets(timings: DataFrame, limit: int) -> DataFrame:
    """T-6."""
    order = [F.desc("seconds"), F.asc("target")]
    return top_per_key(target_seconds(timings), LOG, order, limit, "position")


def text_metrics(lines: DataFrame) -> DataFrame:
    """AG-30: total of the phase rows; null for a log that has none."""
    return (
        lines.groupBy(*LOG)
        .agg(
            F.sum(_metric_timing()["seconds"]).alias("total_seconds"),
            F.count(_metric_timing()).alias("phases"),
            F.count(_metric_timing()["target"]).alias("targets"),
        )
    )


def _metric_timing() -> Column:
    """A timing row that is not a type-check report."""
    line = F.col("line")
    return F.when(L.swift_timing_line(line).isNull(), L.timing(line))


def log_swift_timings(lines: DataFrame) -> DataFrame:
    """SF-13 over whole logs."""
    rows = lines.select(*AT, L.swift_timing_line(F.col("line")).alias("_s"))
    return rows.where(F.col("_s").isNotNull()).select(
        *AT, "_s.kind", "_s.file", F.col("_s.line").alias("line"),
        F.col("_s.column").alias("column_number"), "_s.symbol", "_s.milliseconds",
    )


def first_elapsed(events: DataFrame) -> DataFrame:
    """W-11: the first duration of each log stays."""
    return (
        _of_kind(events, "elapsed")
        .groupBy(*LOG)
        .agg(F.min_by(X.elapsed(F.col("line")), "line_no").alias("seconds"))
    )


# Packages and metadata


def log_packages(lines: DataFrame) -> DataFrame:
    """SO-2: distinct (name, version) per log, with the first source."""
    rows = lines.select(*AT, L.package(F.col("line")).alias("_p"))
    named = rows.where(F.col("_p").isNotNull()).select(*AT, "_p.*")
    first = F.min(F.struct("line_no", "source")).alias("_first")
    return named.groupBy(*LOG, "name", "version").agg(first).select(
        *LOG, "name", "version", F.col("_first.source").alias("source")
    )


def _metadata_rows(lines: DataFrame) -> DataFrame:
    marked = lines.where(L.looks_like_metadata(F.col("line")))
    rows = marked.select(*AT, F.explode(L.metadata_fields(F.col("line"))).alias("_m"))
    return rows.select(*AT, "_m.*")


def log_metadata(lines: DataFrame) -> DataFrame:
    """W-10: first value of each field; the coverage switch keeps its last."""
    first = (
        _metadata_rows(lines)
        .groupBy(*LOG, "field")
        .agg(F.min_by("value", "line_no").alias("value"))
    )
    line = F.col("line")
    switch = F.when(F.contains(line, F.lit(L.COVERAGE_OFF)), F.lit("false")).when(
        F.contains(line, F.lit(L.COVERAGE_ON)), F.lit("true")
    )
    marked = lines.where(L.looks_like_metadata(line))
    coverage = (
        marked.withColumn("_switch", switch)
        .where(F.col("_switch").isNotNull())
        .groupBy(*LOG)
        .agg(F.max_by("_switch", "line_no").alias("value"))
        .select(*LOG, F.lit("code_coverage_enabled").alias("field"), "value")
    )
    frozen = (
        marked.where(F.contains(line, F.lit(L.NO_PACKAGE_RESOLUTION)))
        .select(*LOG)
        .distinct()
        .select(
            *LOG,
            F.lit("disable_automatic_package_resolution").alias("field"),
            F.lit("true").alias("value"),
        )
    )
    return first.unionByName(coverage).unionByName(frozen)


def metadata_hits(lines: DataFrame) -> DataFrame:
    """Lines that set a field for the first time, or name a switch."""
    first = (
        _metadata_rows(lines)
        .groupBy(*LOG, "field")
        .agg(F.min("line_no").alias("line_no"))
        .select(*AT)
    )
    line = F.col("line")
    switches = lines.where(
        L.looks_like_metadata(line)
        & (
            F.contains(line, F.lit(L.COVERAGE_ON))
            | F.contains(line, F.lit(L.COVERAGE_OFF))
            | F.contains(line, F.lit(L.NO_PACKAGE_RESOLUTION))
        )
    ).select(*AT)
    return first.unionByName(switches).distinct()


# Timeline


def timeline(lines: DataFrame, events: DataFrame) -> DataFrame:
    """W-9: one row per change of phase.

    Only (log, line, place, phase) is shuffled; the text of the few lines that
    change the phase is joined back at the end.
    """
    line = F.col("line")
    kind = F.col("kind")
    late = (
        F.when(kind.isin("graph_declared", "graph_target", "graph_dependency"), F.lit("dependency_graph"))
        .when((kind == "diagnostic") & F.contains(line, F.lit("fatal error:")), F.lit("crash"))
        .when(kind == "restart", F.lit("test_restart"))
        .when(kind == "crash", F.lit("crash"))
    )
    places = F.array(
        F.when(L.is_timing_banner(line) | L.timing(line).isNotNull(), F.lit("build_timing")),
        L.phase_keyword(line),
        F.lit(None).cast("string"),
        F.when(L.package(line).isNotNull(), F.lit("package_resolution")),
        late,
    )
    named = events.select(*AT, F.posexplode(places).alias("place", "phase")).where(
        F.col("phase").isNotNull()
    )
    hits = metadata_hits(lines).select(
        *AT, F.lit(2).alias("place"), F.lit("build_metadata").alias("phase")
    )
    marks = named.unionByName(hits)
    before = carry_last(
        marks, LOG, ["line_no", "place"], F.col("phase"), "_before", line_chunk()
    )
    changes = before.where(~F.col("phase").eqNullSafe(F.col("_before"))).drop("_before")
    return changes.join(lines.select(*AT, "line"), AT).select(
        *AT, "place", "phase", F.col("line").alias("message")
    )


# Graph lines


def log_graph_nodes(events: DataFrame) -> DataFrame:
    """Distinct declared targets of each log."""
    node = L.graph_target(F.col("line"))
    rows = _of_kind(events, "graph_target").select(*LOG, node.alias("_n"))
    return rows.select(*LOG, "_n.*").distinct()


def log_graph_edges(events: DataFrame) -> DataFrame:
    """W-6: dependency lines attached to the last target line; self edges dropped."""
    line = F.col("line")
    rows = _of_kind(events, "graph_target", "graph_dependency").select(
        *AT,
        F.when(F.col("kind") == "graph_target", L.graph_target(line)).alias("_target"),
        F.when(F.col("kind") == "graph_dependency", L.graph_dependency(line)).alias("_to"),
    )
    carried = carry_last(rows, LOG, ["line_no"], F.col("_target"), "_from", line_chunk())
    edges = carried.where(F.col("_to").isNotNull()).select(
        *LOG,
        F.col("_from.name").alias("from_name"),
        F.col("_from.project").alias("from_project"),
        F.col("_to.name").alias("to_name"),
        F.coalesce("_to.project", "_from.project").alias("to_project"),
    )
    loop = (F.col("from_name") == F.col("to_name")) & (
        F.col("from_project") == F.col("to_project")
    )
    return edges.where(~loop).distinct()


def declared_counts(events: DataFrame) -> DataFrame:
    """The last stated number of targets of each log."""
    number = L.declared_targets(F.col("line")).try_cast("bigint")
    return (
        _of_kind(events, "graph_declared")
        .groupBy(*LOG)
        .agg(F.max_by(number, "line_no").alias("declared_count"))
    )


# Whole-log results


def log_summary(
    lines: DataFrame, unique: DataFrame, tests: DataFrame
) -> DataFrame:
    """One row per log: counts and the pass or fail verdict."""
    counts = ("raw_warnings", "raw_errors", "unique_warnings", "unique_errors")
    more = ("total", "passed", "failed", "crashed", "fatal", "restarted")
    joined = (
        lines.select(*LOG)
        .distinct()
        .join(diagnostic_counts(unique), LOG, "left")
        .join(tests, LOG, "left")
    )
    zeroed = joined.select(
        *LOG, *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in (*counts, *more))
    )
    broken = (F.col("raw_errors") > 0) | (F.col("failed") > 0) | (F.col("fatal") > 0)
    return zeroed.withColumn(
        "status", F.when(broken, F.lit("failed")).otherwise(F.lit("passed"))
    )


def gate_violations(summary: DataFrame, policy: str) -> DataFrame:
    """PF-8: logs that break a policy (errors, warnings, failures or any)."""
    errors = F.col("raw_errors") > 0
    failures = (F.col("failed") > 0) | (F.col("crashed") > 0)
    rules = {
        "errors": errors,
        "warnings": F.col("raw_warnings") > 0,
        "failures": failures,
        "any": errors | failures,
    }
    return summary.where(rules[policy]).select(*LOG, F.lit(policy).alias("policy"))


def primary_issue(
    lines: DataFrame,
    clusters: DataFrame,
    crashes: DataFrame,
    unique: DataFrame,
    blockers: DataFrame,
    edges: DataFrame,
) -> DataFrame:
    """AG-43: first cluster, else first crash, else first error; and next steps."""
    by_cluster = clusters.groupBy(*LOG).agg(
        F.min_by("message", "fingerprint").alias("_cluster")
    )
    by_crash = crashes.groupBy(*LOG).agg(F.min_by("message", "line_no").alias("_crash"))
    by_error = (
        unique.where(_failing(F.col("severity")))
        .groupBy(*LOG)
        .agg(F.min_by("message", "fingerprint").alias("_error"))
    )
    blocked = blockers.select(*LOG).distinct().withColumn("_blocked", F.lit(True))
    hot = edges.select(*LOG).distinct().withColumn("_hot", F.lit(True))
    joined = lines.select(*LOG).distinct()
    for part in (by_cluster, by_crash, by_error, blocked, hot):
        joined = joined.join(part, LOG, "left")
    steps = F.array_compact(
        F.array(
            F.when(
                F.col("_crash").isNotNull(),
                F.lit("Inspect the XCTest crash context and restart boundary."),
            ),
            F.when(
                F.col("_blocked"),
                F.lit("Review Swift 6 concurrency blockers by category and target."),
            ),
            F.when(
                F.col("_hot"),
                F.lit("Review high fan-in targets as rebuild-impact candidates."),
            ),
        )
    )
    return joined.select(
        *LOG,
        F.coalesce("_cluster", "_crash", "_error").alias("primary_issue"),
        steps.alias("next_steps"),
    )
