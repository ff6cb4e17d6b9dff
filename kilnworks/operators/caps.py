"""Numbering and per-build row caps of a stored document (W-1, W-5, W-12 to W-15).

A cap is always the caller's; no other operator applies one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import line_chunk, number_rows, top_per_key

BUILD = ["build_key"]


def attempt_numbers(
    tests: DataFrame, position: str = "position", explicit: str | None = None
) -> DataFrame:
    """W-1: nth result of (suite, name) in a build, in log order.

    A column with explicit numbers overrides row by row.
    """
    numbered = number_rows(
        tests, [*BUILD, "suite", "name"], [F.asc(position)], "_nth", line_chunk(position)
    )
    nth = F.col("_nth")
    attempt = nth if explicit is None else F.coalesce(F.col(explicit), nth)
    return numbered.withColumn("attempt", attempt.cast("int")).drop("_nth")


def step_ordinals(steps: DataFrame, position: str = "position") -> DataFrame:
    """W-5: 0-based place in start order, missing starts last, ties in log order."""
    order = [F.col("started_at").asc_nulls_last(), F.asc(position)]
    # Starts of one second, and by log order those without one, are counted together.
    second = F.floor("started_at")
    chunk = F.struct(second.isNull().alias("missing"), second.alias("second"),
                     F.when(second.isNull(), line_chunk(position)).alias("part"))
    kept = number_rows(steps, BUILD, order, "_place", chunk)
    return kept.withColumn("ordinal", (F.col("_place") - 1).cast("int")).drop("_place")


def keep_slowest(
    rows: DataFrame, limit: int, key: list[str], value: str = "seconds", ties=None
) -> DataFrame:
    """W-12: the slowest rows of each build, then one row per stored key.

    The cap comes first; among kept rows with the same key the slowest stays.
    """
    ties = ties if ties is not None else key
    order = [F.desc(value), *(F.col(c).asc_nulls_first() for c in ties)]
    kept = top_per_key(rows, BUILD, order, limit, "_place")
    rest = [c for c in rows.columns if c not in (*BUILD, *key)]
    first = kept.groupBy(*BUILD, *key).agg(
        F.min_by(F.struct(*rest), "_place").alias("_row")
    )
    return first.select(*BUILD, *key, "_row.*").select(*rows.columns)


def keep_targets(targets: DataFrame, limit: int) -> DataFrame:
    return keep_slowest(targets, limit, ["name"], ties=["name", "category"])


def keep_phases(phases: DataFrame, limit: int) -> DataFrame:
    return keep_slowest(phases, limit, ["name"])


def keep_files(files: DataFrame, limit: int) -> DataFrame:
    return keep_slowest(
        files,
        limit,
        ["file", "architecture"],
        ties=["file", "step_type", "architecture"],
    )


def keep_swift_timings(timings: DataFrame, limit: int) -> DataFrame:
    key = ["kind", "file", "line", "column_number"]
    return keep_slowest(timings, limit, key, value="milliseconds")


def keep_tests(tests: DataFrame, limit: int, position: str = "position") -> DataFrame:
    """W-13: tests with a run that did not pass come first, then first appearance;
    the runs of one test stay together."""
    per_test = tests.groupBy(*BUILD, "suite", "name").agg(
        F.bool_or(F.col("status") != "passed").alias("_bad"),
        F.min(position).alias("_first"),
    )
    order = [F.desc("_bad"), F.asc("_first"), F.asc(position)]
    placed = top_per_key(
        tests.join(per_test, [*BUILD, "suite", "name"]), BUILD, order, limit, "place"
    )
    return placed.drop("_bad", "_first")


def keep_diagnostics(diagnostics: DataFrame, limit: int) -> DataFrame:
    """W-14."""
    return top_per_key(diagnostics, BUILD, [F.asc("fingerprint")], limit)


def truncation_notes(rows: DataFrame, what: str, limit: int) -> DataFrame:
    """W-15: one note per build whose list is longer than the cap."""
    note = F.format_string(
        f"kept the slowest {limit} of %d {what} (use --detail full for all)", F.col("_n")
    )
    return (
        rows.groupBy(*BUILD)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > limit)
        .select(*BUILD, F.lit(what).alias("list"), note.alias("note"))
    )


def standard_detail(
    rows: DataFrame, limit: int, order: list[Column], keys: list[str] | None = None
) -> DataFrame:
    """W-15: the first rows per build (or per target of a build)."""
    return top_per_key(rows, keys or BUILD, order, limit)


def step_truncation_notes(
    steps: DataFrame, limit: int
) -> DataFrame:
    """W-15, steps: one note per build with the number of steps left out."""
    over = (
        steps.groupBy(*BUILD, "target")
        .agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("_over"))
        .groupBy(*BUILD)
        .agg(F.sum("_over").alias("_dropped"))
        .where(F.col("_dropped") > 0)
    )
    note = F.format_string(
        f"kept the slowest {limit} steps per target; "
        "%d slower-to-report steps omitted (use --detail full for all)",
        F.col("_dropped"),
    )
    return over.select(*BUILD, F.lit("steps").alias("list"), note.alias("note"))
