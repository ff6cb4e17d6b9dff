"""Activity-section columns (SF-14 to SF-23) and the partition day (SF-24)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import APPLE_EPOCH_OFFSET, CLOCK_SKEW_SECONDS, KNOWN_ARCHITECTURES
from .text import WHITESPACE, captured, strip

# Ordered prefixes of a step's signature or title (fixed values).
STEP_RULES = (
    ("SwiftCompile", "swiftCompilation"),
    ("CompileSwift", "swiftCompilation"),
    ("SwiftDriver", "swiftCompilation"),
    ("SwiftEmitModule", "swiftCompilation"),
    ("CompileC", "cCompilation"),
    ("CompileAssetCatalog", "compileAssetCatalog"),
    ("CompileStoryboard", "compileStoryboard"),
    ("CompileXIB", "compileXIB"),
    ("PrecompileModule", "cCompilation"),
    ("ScanDependencies", "scanDependencies"),
    ("Ld ", "linker"),
    ("Libtool", "linker"),
    ("PhaseScriptExecution", "scriptExecution"),
    ("CopySwiftLibs", "copySwiftLibs"),
    ("CpResource", "copy"),
    ("Copy ", "copy"),
    ("CpHeader", "copy"),
    ("PBXCp", "copy"),
    ("CodeSign", "codeSign"),
    ("ProcessInfoPlistFile", "processInfoPlist"),
    ("Touch", "touch"),
    ("WriteAuxiliaryFile", "writeAuxiliaryFile"),
    ("CreateBuildDirectory", "createBuildDirectory"),
    ("RegisterExecutionPolicyException", "other"),
    ("Validate", "validate"),
)
WRAPPER_TITLE = r"^Build target (\S+)|^(\S+) \(project "
STEP_TARGET = r"\(in target '([^']+)'"
VERDICTS = ("succeeded", "failed", "cancelled")


def step_type(signature: Column, title: Column) -> Column:
    """SF-14."""
    text = F.when(F.length(signature) == 0, title).otherwise(signature)
    chain = None
    for prefix, kind in STEP_RULES:
        hit = F.startswith(text, F.lit(prefix)) | F.startswith(title, F.lit(prefix))
        chain = (F if chain is None else chain).when(hit, F.lit(kind))
    return chain.otherwise(F.lit("other"))


def strip_file_url(url: Column) -> Column:
    return F.regexp_replace(url, "^file://", "")


def _words(text: Column) -> Column:
    return F.split(strip(text), r"(?U)\s+")


def step_file(document_url: Column, signature: Column) -> Column:
    """SF-15."""
    token = F.get(
        F.filter(
            _words(signature),
            lambda w: F.startswith(w, F.lit("/")) & F.contains(w, F.lit(".")),
        ),
        F.lit(0),
    )
    return F.coalesce(
        F.when(F.length(document_url) > 0, strip_file_url(document_url)), token
    )


def step_architecture(signature: Column, title: Column) -> Column:
    """SF-16."""
    tail = F.rtrim(
        F.rtrim(F.substring_index(title, "(", -1), F.lit(WHITESPACE)), F.lit(")")
    )
    named = F.when(F.contains(title, F.lit("(")) & tail.isin(*KNOWN_ARCHITECTURES), tail)
    token = F.get(
        F.filter(_words(signature), lambda w: w.isin(*KNOWN_ARCHITECTURES)), F.lit(0)
    )
    return F.coalesce(named, token)


def step_target(signature: Column, title: Column) -> Column:
    """SF-17, step form."""
    return F.coalesce(captured(signature, STEP_TARGET, 1), captured(title, STEP_TARGET, 1))


def wrapper_target(title: Column) -> Column:
    """SF-17, wrapper-section form."""
    return F.coalesce(captured(title, WRAPPER_TITLE, 1), captured(title, WRAPPER_TITLE, 2))


def labelled(subtitle: Column, label: str) -> Column:
    """SF-18: first non-empty value under a label of a ``|``-separated subtitle."""
    parts = F.transform(F.split(subtitle, "[|]"), strip)
    values = F.transform(
        F.filter(parts, lambda p: F.startswith(p, F.lit(label))),
        lambda p: strip(F.substr(p, F.lit(len(label) + 1))),
    )
    return F.get(F.filter(values, lambda v: F.length(v) > 0), F.lit(0))


def verdict(result: Column) -> Column:
    """SF-19: first verdict word, bare and lowercase."""
    words = F.transform(
        _words(result),
        lambda w: F.lower(F.regexp_replace(w, r"^\P{IsAlphabetic}+|\P{IsAlphabetic}+$", "")),
    )
    return F.get(F.filter(words, lambda w: w.isin(*VERDICTS)), F.lit(0))


def step_fingerprint(
    kind: Column, target: Column, architecture: Column, file: Column, signature: Column
) -> Column:
    """SF-20."""
    return F.concat_ws(
        ":",
        F.lit("step"),
        kind,
        target,
        F.coalesce(architecture, F.lit("-")),
        F.coalesce(file, signature),
    )


def duration(started: Column, stopped: Column) -> Column:
    """SF-21."""
    return F.when(stopped >= started, stopped - started)


def executed(step_started: Column, build_started: Column) -> Column:
    """SF-22: false only for a step that began before its build, skew allowed."""
    return F.coalesce(step_started >= build_started - F.lit(CLOCK_SKEW_SECONDS), F.lit(True))


def apple_to_unix(seconds: Column) -> Column:
    """SF-23."""
    return seconds + F.lit(APPLE_EPOCH_OFFSET)


def day_of(started: Column, today: Column | None = None) -> Column:
    """SF-24: UTC day of a start time; today when it is missing or unusable."""
    fallback = F.current_date() if today is None else today
    usable = started.isNotNull() & ~F.isnan(started) & (started >= 0)
    usable = usable & (started < F.lit(float("inf")))
    days = F.floor(F.when(usable, started) / F.lit(86400.0)).try_cast("int")
    return F.coalesce(F.date_from_unix_date(days), fallback)


def rounded_epoch(started: Column, received: Column) -> Column:
    """Recorded-at seconds: start time, else arrival, rounded to whole seconds."""
    return F.round(F.coalesce(started, F.unix_micros(received) / F.lit(1e6))).cast("bigint")
