"""Test reports: JSON trees flattened to one row per run (SRC-4, AG-28)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tests import report_status
from ..runtime import written

# Deepest tree that is walked; a deeper one is an error, not cut.
MAX_DEPTH = 200
# The largest number of an attempt; those without a number come after all others.
_LAST = 4_294_967_295
ATTEMPT_KINDS = ("Repetition", "Test Case Run")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(report_id, document): one report per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("report_id"), F.col("value").alias("document")
    )


def malformed_reports(reports: DataFrame) -> DataFrame:
    bad = F.try_parse_json("document").isNull()
    return reports.where(bad).select("report_id", F.lit("not JSON").alias("reason"))


def _field(node: str, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(node), f"$.{name}", kind)


def _children(nodes: DataFrame, path: str, *keep: str) -> DataFrame:
    """One row per element of the array at ``path`` of ``node``."""
    array = F.try_variant_get(F.col("node"), path, "array<variant>")
    return nodes.select(*keep, F.posexplode(array).alias("_pos", "_child"))


def flattened_reports(reports: DataFrame) -> DataFrame:
    """SRC-4: (report_id, suite, name, status, seconds, message, attempt).

    Walks one level of all trees per round. A node is known by its path, so the
    rows of one report spread over the cluster like any others.
    """
    start = reports.select(
        "report_id",
        F.lit("").alias("path"),
        F.lit(None).cast("string").alias("suite"),
        F.try_parse_json("document").alias("node"),
    )
    tops = _children(start, "$.testNodes", "report_id", "path", "suite")
    frontier = _placed(tops)
    cases = None
    for _ in range(MAX_DEPTH):
        level, count = written(frontier, "report-level")
        if not count:
            break
        kind = F.coalesce(_field("node", "nodeType"), F.lit(""))
        found = level.where(kind == "Test Case")
        cases = found if cases is None else cases.unionByName(found)
        rest = level.where(kind != "Test Case").withColumn(
            "suite",
            F.when(kind == "Test Suite", F.coalesce(_field("node", "name"), F.lit(""))).otherwise(
                F.col("suite")
            ),
        )
        frontier = _placed(_children(rest, "$.children", "report_id", "path", "suite"))
    else:
        raise ValueError(f"reports are nested deeper than {MAX_DEPTH} levels")
    if cases is None:
        cases = level
    return _runs(cases)


def _placed(children: DataFrame) -> DataFrame:
    return children.select(
        "report_id",
        F.concat_ws(".", "path", F.format_string("%06d", "_pos")).alias("path"),
        "suite",
        F.col("_child").alias("node"),
    )


def _message(children: Column) -> Column:
    """Name of the first failure message under a node."""
    failures = F.filter(
        children,
        lambda c: F.try_variant_get(c, "$.nodeType", "string") == "Failure Message",
    )
    return F.coalesce(
        F.try_variant_get(F.get(failures, F.lit(0)), "$.name", "string"),
        F.when(F.size(failures) > 0, F.lit("")),
    )


def _run(node: str) -> list[Column]:
    children = F.try_variant_get(F.col(node), "$.children", "array<variant>")
    return [
        report_status(F.coalesce(_field(node, "result"), F.lit(""))).alias("status"),
        _field(node, "durationInSeconds", "double").alias("seconds"),
        _message(children).alias("message"),
    ]


def _number(run: Column) -> Column:
    """The number of an attempt, null if it is none."""
    text = F.try_variant_get(run, "$.nodeIdentifier", "string")
    number = F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("bigint"))
    return F.when(number <= _LAST, number)


def _runs(cases: DataFrame) -> DataFrame:
    """Attempts of each case in the order of their number; else the case itself.

    The attempts of one case are ordered inside its own array.
    """
    children = F.coalesce(
        F.try_variant_get(F.col("node"), "$.children", "array<variant>"),
        F.array().cast("array<variant>"),
    )
    attempts = F.filter(
        children, lambda c: F.try_variant_get(c, "$.nodeType", "string").isin(*ATTEMPT_KINDS)
    )
    base = cases.select(
        "report_id",
        "path",
        F.coalesce("suite", F.lit("")).alias("suite"),
        F.coalesce(_field("node", "name"), F.lit("")).alias("name"),
        "node",
        attempts.alias("_attempts"),
    )
    single = base.where(F.size("_attempts") == 0).select(
        "report_id", "suite", "name", *_run("node"), F.lit(1).alias("attempt")
    )
    # The order is found inside the array, so no attempt is joined with its place: sizes
    # of tables of variants are guessed far too low, and such a join was broadcast.
    order = F.transform(
        "_attempts", lambda run, pos: F.struct(_number(run).alias("number"), pos.alias("pos"))
    )
    order = F.transform(
        order,
        lambda o: F.struct(
            F.coalesce(o["number"], F.lit(_LAST)).alias("rank"), o["pos"].alias("pos"), o["number"].alias("number")
        ),
    )
    retried = (
        base.where(F.size("_attempts") > 0)
        .select("report_id", "suite", "name", "_attempts", F.posexplode(F.array_sort(order)).alias("_index", "_key"))
        .select(
            "report_id",
            "suite",
            "name",
            F.get("_attempts", F.col("_key.pos")).alias("_run"),
            F.coalesce("_key.number", F.col("_index") + 1).cast("int").alias("attempt"),
        )
        .select("report_id", "suite", "name", *_run("_run"), "attempt")
    )
    return single.unionByName(retried)


def report_summary(runs: DataFrame) -> DataFrame:
    """AG-28: runs per report, attempts counted one by one."""
    return runs.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "passed").alias("passed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
