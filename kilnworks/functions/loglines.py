"""Timing, phase, package, metadata and graph lines (SF-6, SF-9 to SF-13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import captured, has_any, matches, strip

# Line patterns (fixed values).
TIMING = r"(?i)^(.+?)\s*(?:\(([^)]+)\))?\s*\|\s*([0-9]+(?:\.[0-9]+)?)\s*seconds?\s*$"
RESOLVED_PACKAGE = (
    r"^Resolved package:\s*([A-Za-z0-9_.-]+)(?:\s*:\s*(\S+))?(?:\s*@\s*(\S+))?\s*$"
)
LISTED_PACKAGE = (
    r"^\+\s*([A-Za-z0-9_.-]+)(?:\s+(https?://\S+|/\S+))?"
    r"(?:\s+([0-9]+\.[0-9]+(?:\.[0-9]+)?))?\s*$"
)
COLON_PACKAGE = r"^([A-Za-z0-9_.-]+):\s+(https?://\S+|/\S+?)(?:\s+@\s+([0-9]\S*))?\s*$"
DECLARED_TARGETS = r"Target dependency graph \((\d+) targets?\)"
TARGET = r"Target '([^']+)' in project '([^']+)'"
DEPENDENCY = (
    r"(?:Explicit dependency on target|Target dependency on target) '([^']+)'"
    r"(?: in project '([^']+)')?"
)
SWIFT_TIMING_LINE = (
    r"^(.+?):(\d+):(\d+): warning: (?:(.+?) '([^']+)'|expression) took (\d+)ms to type-check"
)
SWIFT_TIMING_MESSAGE = r"(?:(.+?) '([^']+)' )?took (\d+)ms to type-check"

# Field name and pattern; the first line of a log that matches sets it (fixed values).
METADATA_FIELDS = (
    ("scheme", r"(?:-scheme|Scheme:)\s+([^\s]+)"),
    ("test_plan", r"(?:-testPlan|Test Plan:)\s+([^\s]+)"),
    ("destination", r"-destination\s+(.+?)(?:\s+-\w+|$)"),
    ("xcode_version", r"Xcode\s+([0-9]+(?:\.[0-9]+)+)"),
    ("sdk", r"(?:SDK|sdk)\s*[:=]\s*([^\s]+)"),
    ("project", r"-project\s+([^\s]+)"),
    ("workspace", r"-workspace\s+([^\s]+)"),
    ("result_bundle_path", r"-resultBundlePath\s+([^\s]+)"),
    ("xcconfig_path", r"-xcconfig\s+([^\s]+)"),
    ("platform", r"platform(?:Name)?[:=]\s*([A-Za-z ]+)"),
)
METADATA_MARKERS = ("-scheme", "-workspace", "-project", "Xcode ", "platform", "Code Coverage")
COVERAGE_ON = "-enableCodeCoverage YES"
COVERAGE_OFF = "-enableCodeCoverage NO"
NO_PACKAGE_RESOLUTION = "-disableAutomaticPackageResolution"

# Ordered phase keywords; the first hit wins (fixed values).
PHASE_RULES = (
    ("package_resolution", ("Resolve Package Graph", "Resolved source packages")),
    ("dependency_graph", ("ComputeTargetDependencyGraph", "dependency graph")),
    ("compilation", ("SwiftCompile", "CompileSwift")),
    ("linking", ("Ld ", "Linker")),
    ("test_execution", ("Test Suite", "Test Case")),
)


def timing(line: Column) -> Column:
    """SF-6: struct(phase, target, seconds) of a timing-summary row, else null."""
    text = strip(line)
    phase = strip(captured(text, TIMING, 1))
    seconds = captured(text, TIMING, 3).try_cast("double")
    target = F.nullif(strip(captured(text, TIMING, 2)), F.lit(""))
    return F.when(
        F.contains(text, F.lit("|")) & (F.length(phase) > 0) & (seconds > 0),
        F.struct(phase.alias("phase"), target.alias("target"), seconds.alias("seconds")),
    )


def phase_keyword(line: Column) -> Column:
    """SF-9."""
    rules = iter(PHASE_RULES)
    name, words = next(rules)
    chain = F.when(has_any(line, words), F.lit(name))
    for name, words in rules:
        chain = chain.when(has_any(line, words), F.lit(name))
    return chain


def looks_like_package(line: Column) -> Column:
    return (
        F.startswith(line, F.lit("Resolved package:"))
        | F.startswith(line, F.lit("+"))
        | has_any(line, (": https://", ": /"))
    )


def package(line: Column) -> Column:
    """SF-10: struct(name, source, version); three forms in order."""
    text = strip(line)
    forms = []
    for pattern in (RESOLVED_PACKAGE, LISTED_PACKAGE, COLON_PACKAGE):
        name = captured(text, pattern, 1)
        forms.append(
            F.when(
                name.isNotNull(),
                F.struct(
                    name.alias("name"),
                    captured(text, pattern, 2).alias("source"),
                    captured(text, pattern, 3).alias("version"),
                ),
            )
        )
    return F.when(looks_like_package(text), F.coalesce(*forms))


def looks_like_metadata(line: Column) -> Column:
    return has_any(line, METADATA_MARKERS)


def metadata_fields(line: Column) -> Column:
    """SF-11: array of struct(field, value) for every field named on the line."""
    found = []
    for field, pattern in METADATA_FIELDS:
        raw = captured(line, pattern, 1)
        value = strip(raw) if field == "platform" else F.btrim(raw, F.lit('"'))
        found.append(
            F.when(
                raw.isNotNull(), F.struct(F.lit(field).alias("field"), value.alias("value"))
            )
        )
    return F.array_compact(F.array(*found))


def declared_targets(line: Column) -> Column:
    return captured(line, DECLARED_TARGETS, 1)


def graph_target(line: Column) -> Column:
    """SF-12: struct(name, project) of a target line."""
    name = captured(line, TARGET, 1)
    return F.when(
        F.startswith(line, F.lit("Target '")) & name.isNotNull(),
        F.struct(name.alias("name"), captured(line, TARGET, 2).alias("project")),
    )


def graph_dependency(line: Column) -> Column:
    """SF-12: struct(name, project); the project is null when the line omits it."""
    name = captured(line, DEPENDENCY, 1)
    return F.when(
        name.isNotNull(),
        F.struct(name.alias("name"), captured(line, DEPENDENCY, 2).alias("project")),
    )


def looks_like_graph(line: Column) -> Column:
    return has_any(line, ("Target dependency graph", "Target '", "dependency on target"))


def _kind(symbol: Column) -> Column:
    return F.when(symbol.isNotNull(), F.lit("function_body")).otherwise(F.lit("type_check"))


def swift_timing_line(line: Column) -> Column:
    """SF-13, text-log form."""
    ms = captured(line, SWIFT_TIMING_LINE, 6)
    symbol = captured(line, SWIFT_TIMING_LINE, 5)
    return F.when(
        F.contains(line, F.lit("ms to type-check")) & ms.isNotNull(),
        F.struct(
            _kind(symbol).alias("kind"),
            captured(line, SWIFT_TIMING_LINE, 1).alias("file"),
            F.coalesce(captured(line, SWIFT_TIMING_LINE, 2).try_cast("bigint"), F.lit(0)).alias(
                "line"
            ),
            F.coalesce(captured(line, SWIFT_TIMING_LINE, 3).try_cast("bigint"), F.lit(0)).alias(
                "column"
            ),
            symbol.alias("symbol"),
            F.coalesce(ms.try_cast("double"), F.lit(0.0)).alias("milliseconds"),
        ),
    )


def swift_timing_message(message: Column) -> Column:
    """SF-13, activity-log form: struct(kind, symbol, milliseconds)."""
    ms = captured(message, SWIFT_TIMING_MESSAGE, 3)
    symbol = captured(message, SWIFT_TIMING_MESSAGE, 2)
    return F.when(
        ms.isNotNull(),
        F.struct(
            _kind(symbol).alias("kind"),
            symbol.alias("symbol"),
            ms.try_cast("double").alias("milliseconds"),
        ),
    )


def is_timing_banner(line: Column) -> Column:
    return F.contains(line, F.lit("Build Timing Summary"))


def is_dependency_line(line: Column) -> Column:
    return F.contains(line, F.lit("dependency on target")) & matches(line, DEPENDENCY)
