"""Test-log lines (SF-5, SF-7, SF-8, SF-33) and the grammar registry (UD-1)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .diagnostics import normalize
from .text import captured, has_any, matches, strip

# Line patterns (fixed values).
STARTED = r"Test Case '(?:-\[)?([^\]\s]+)[\s\]]+([^'\]]+)\]?' started"
BRACKETED = (
    r"Test Case '(?:-\[)?([^\]\s]+)[\s\]]+([^'\]]+)\]?' (passed|failed) \(([0-9.]+) seconds?\)"
)
DOTTED = (
    r"Test case '([^'.]+)\.([^']+)' (passed|failed)(?: on '[^']*')?"
    r"(?: \(([0-9.]+) seconds?\))?"
)
SWIFT_TESTING = r"Test '([^']+)' (passed|failed)(?: \(([0-9.]+) seconds?\))?"
ELAPSED = r"([0-9]+(?:\.[0-9]+)?)\s+elapsed"
SWIFT_TESTING_SUITE = "SwiftTesting"

RESULT_TYPE = "struct<suite:string,test:string,status:string,seconds:double,fingerprint:string>"


def _result(suite: Column, test: Column, status: Column, seconds: Column, mark: Column) -> Column:
    return F.when(
        status.isNotNull(),
        F.struct(
            suite.alias("suite"),
            test.alias("test"),
            status.alias("status"),
            seconds.try_cast("double").alias("seconds"),
            F.when(status == "failed", mark).alias("fingerprint"),
        ),
    )


def _xctest_form(line: Column, pattern: str) -> Column:
    suite = strip(F.coalesce(captured(line, pattern, 1), F.lit("")))
    test = strip(F.coalesce(captured(line, pattern, 2), F.lit("")))
    return _result(
        suite,
        test,
        captured(line, pattern, 3),
        captured(line, pattern, 4),
        F.concat(F.lit("XCTEST:"), suite, F.lit(":"), F.lower(test)),
    )


def xctest_result(line: Column) -> Column:
    """Bracketed form first, then the dotted one."""
    return F.coalesce(_xctest_form(line, BRACKETED), _xctest_form(line, DOTTED))


def swift_testing_result(line: Column) -> Column:
    name = strip(F.coalesce(captured(line, SWIFT_TESTING, 1), F.lit("")))
    return _result(
        F.lit(SWIFT_TESTING_SUITE),
        name,
        captured(line, SWIFT_TESTING, 2),
        captured(line, SWIFT_TESTING, 3),
        F.concat(F.lit("SWIFT_TEST:"), F.lower(name)),
    )


def started(line: Column) -> Column:
    """``suite:test`` of a line that announces a start."""
    suite = captured(line, STARTED, 1)
    return F.when(
        suite.isNotNull(), F.concat(suite, F.lit(":"), strip(captured(line, STARTED, 2)))
    )


def assertion(line: Column) -> Column:
    """The trimmed line when it states a failed assertion."""
    return F.when(has_any(F.lower(line), ("xctassert", "assertion failed")), strip(line))


def crash_type(line: Column) -> Column:
    text = F.lower(line)
    return (
        F.when(F.contains(text, F.lit("unexpectedly found nil")), F.lit("unexpected_nil"))
        .when(F.contains(text, F.lit("fatal error:")), F.lit("fatal_error"))
        .when(has_any(text, ("signal sig", "received signal", "exc_crash")), F.lit("signal"))
    )


def elapsed(line: Column) -> Column:
    return captured(line, ELAPSED, 1).try_cast("double")


def failure_fingerprint(message: Column) -> Column:
    """SF-8: the text after ``: XCTAssert`` (whole text when absent), normalised."""
    at = F.locate(": XCTAssert", message)
    tail = F.when(at > 0, F.substr(message, at + 11)).otherwise(message)
    return normalize(tail)


def report_status(verdict: Column) -> Column:
    """SF-33: report verdict to stored status."""
    return (
        F.when(verdict.isin("Passed", "Skipped", "Expected Failure"), F.lit("passed"))
        .when(verdict == "Failed", F.lit("failed"))
        .otherwise(F.lit("started"))
    )


# Routing guards, in the order in which a log line is offered to them.


def is_started_line(line: Column) -> Column:
    return (
        F.contains(line, F.lit("Test Case"))
        & F.contains(line, F.lit(" started"))
        & matches(line, STARTED)
    )


def is_xctest_line(line: Column) -> Column:
    return (
        has_any(line, ("Test Case", "Test case '"))
        & has_any(line, (" passed ", " failed "))
        & (matches(line, BRACKETED) | matches(line, DOTTED))
    )


def is_swift_testing_line(line: Column) -> Column:
    return (
        F.startswith(line, F.lit("Test '")) | F.startswith(line, F.lit("Test case '"))
    ) & matches(line, SWIFT_TESTING)


def is_crash_line(line: Column) -> Column:
    return (
        has_any(line, ("Fatal error:", "Unexpectedly found nil", "signal SIG", "EXC_CRASH"))
        & crash_type(line).isNotNull()
    )


@dataclass(frozen=True)
class Grammar:
    """One test-log format: a name and a line -> result-struct expression."""

    name: str
    result: Callable[[Column], Column]
    started: Callable[[Column], Column] | None = None


class GrammarRegistry:
    """UD-1: formats tried in order; the first that recognises a line wins."""

    def __init__(self, grammars=None):
        self._grammars = list(
            grammars
            if grammars is not None
            else (
                Grammar("xctest", xctest_result, started),
                Grammar("swift-testing", swift_testing_result),
            )
        )

    def register(self, grammar: Grammar, first: bool = False) -> None:
        self._grammars.insert(0 if first else len(self._grammars), grammar)

    def names(self) -> list[str]:
        return [grammar.name for grammar in self._grammars]

    def parse_any(self, line: Column) -> Column:
        found = F.lit(None).cast(RESULT_TYPE)
        for grammar in reversed(self._grammars):
            found = F.coalesce(grammar.result(line).cast(RESULT_TYPE), found)
        return found

    def claimed_by(self, line: Column) -> Column:
        """Name of the grammar that recognises the line."""
        return F.coalesce(
            *(F.when(g.result(line).isNotNull(), F.lit(g.name)) for g in self._grammars),
            F.lit(None).cast("string"),
        )

    def started(self, line: Column) -> Column:
        starts = [g.started(line) for g in self._grammars if g.started is not None]
        return F.coalesce(*starts, F.lit(None).cast("string"))
