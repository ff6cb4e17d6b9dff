"""Diagnostic lines: parsing, classification and fingerprints (SF-1 to SF-4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import UNICODE, captured, has_any, strip

# Line patterns (fixed values).
LOCATED = r"^(.+?):(\d+):(\d+):\s*(note|warning|error|fatal error):\s*(.*)$"
BARE = r"^.*?\b(note|warning|error|fatal error):\s*(.*)$"
VOLATILE = r"0x[0-9a-fA-F]+|\b[0-9a-fA-F]{16,}\b|\b\d{4,}\b"

# Ordered rules: the first category with a phrase in the message wins (fixed values).
CATEGORY_RULES = (
    ("swift_actor_isolation", ("actor-isolated", "main actor-isolated", "actor isolation")),
    ("swift_sendable", ("sendable", "does not conform to the sendable")),
    (
        "swift_concurrency",
        ("isolation boundary", "swift 6", "data race", "concurrency-safe", "nonisolated"),
    ),
    ("linker", ("undefined symbol", "duplicate symbol", "linker command", "ld:")),
    (
        "code_signing",
        ("code sign", "codesign", "provisioning profile", "no signing certificate"),
    ),
    (
        "x_c_test",
        ("xctest", "xctassert", "test suite", "testing failed", "failed to run tests"),
    ),
    ("simulator", ("simulator", "simctl", "unable to boot", "device not found")),
    (
        "spm",
        (
            "swiftpm",
            "package resolution",
            "package.swift",
            "missing package product",
            "dependency graph",
        ),
    ),
    (
        "memory_lifecycle",
        (
            "retain cycle",
            "strong reference cycle",
            "memory leak",
            "deallocated while",
            "over-released",
        ),
    ),
    ("app_intents", ("app intent", "appintents")),
    (
        "build_configuration",
        ("build setting", "deployment target", "unsupported architecture", "no such module"),
    ),
    ("crash", ("crashed", "signal sigabrt", "fatal error:", "exc_bad_access")),
    ("deprecation", ("is deprecated", "deprecated in", "was deprecated")),
)

MAX_POSITION = 4_294_967_295


def position(text: Column) -> Column:
    number = text.try_cast("bigint")
    return F.when(number <= MAX_POSITION, number)


def looks_like_diagnostic(line: Column) -> Column:
    """Cheap guard, so the patterns run on candidate lines only."""
    return has_any(line, ("warning:", "error:", "fatal error:"))


def is_diagnostic_line(line: Column) -> Column:
    """True when :func:`parse` recognises the line; the bare form covers the located one."""
    return looks_like_diagnostic(line) & strip(line).rlike(UNICODE + BARE)


def parse(line: Column) -> Column:
    """SF-1: struct(severity, file, line, column, message), null for other lines."""
    text = strip(line)
    located = captured(text, LOCATED, 4)
    bare = captured(text, BARE, 1)
    word = F.coalesce(located, bare)
    severity = F.when(word == "fatal error", F.lit("fatal")).otherwise(word)
    return F.when(
        word.isNotNull(),
        F.struct(
            severity.alias("severity"),
            F.when(located.isNotNull(), captured(text, LOCATED, 1)).alias("file"),
            F.when(located.isNotNull(), position(captured(text, LOCATED, 2))).alias("line"),
            F.when(located.isNotNull(), position(captured(text, LOCATED, 3))).alias("column"),
            F.when(
                located.isNotNull(), F.regexp_extract(text, UNICODE + LOCATED, 5)
            )
            .otherwise(strip(F.regexp_extract(text, UNICODE + BARE, 2)))
            .alias("message"),
        ),
    )


def normalize(message: Column) -> Column:
    """SF-2: volatile parts become ``<id>``, white space collapses, case folds."""
    masked = F.regexp_replace(message, UNICODE + VOLATILE, "<id>")
    return F.lower(strip(F.regexp_replace(masked, r"(?U)\s+", " ")))


def classify(message: Column) -> Column:
    """SF-3: first matching category, else ``unknown``."""
    text = F.lower(message)
    rules = iter(CATEGORY_RULES)
    name, phrases = next(rules)
    chain = F.when(has_any(text, phrases), F.lit(name))
    for name, phrases in rules:
        chain = chain.when(has_any(text, phrases), F.lit(name))
    return chain.otherwise(F.lit("unknown"))


def fingerprint(category: Column, severity: Column, file: Column, message: Column) -> Column:
    """SF-4: ``category:severity:file:normalised message``."""
    return F.concat_ws(":", category, severity, F.coalesce(file, F.lit("")), normalize(message))
