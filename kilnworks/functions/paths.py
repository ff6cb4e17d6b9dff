"""Source paths, locations and project names (SF-26, SF-29 to SF-32)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .redaction import redact_home
from .text import captured, last_segment, slashes


def _is_tail(full: Column, tail: Column) -> Column:
    return (F.length(tail) > 0) & F.endswith(full, F.concat(F.lit("/"), tail))


def same_file(left: Column, right: Column) -> Column:
    """SF-29: equal after separator folding, or one is a whole-segment tail of the other."""
    a, b = slashes(left), slashes(right)
    return (a == b) | _is_tail(a, b) | _is_tail(b, a)


def basename(path: Column) -> Column:
    return last_segment(slashes(path))


def redact_path(path: Column, root: str | None = None) -> Column:
    """SF-26: ``<repo>`` for the root prefix, else ``<home>`` for home directories."""
    folded = slashes(path)
    if root is None:
        return redact_home(folded)
    prefix = root.replace("\\", "/").removesuffix("/")
    return F.when(
        F.startswith(folded, F.lit(prefix)),
        F.concat(F.lit("<repo>"), F.substr(folded, F.lit(len(prefix) + 1))),
    ).otherwise(redact_home(folded))


def location_in(message: Column) -> Column:
    """SF-30: struct(file, line) of the first ``File.swift:line`` in a message."""
    # Text before the first marker, back to the last white space.
    at = F.locate(".swift:", message)
    head = F.substr(message, F.lit(1), at + F.lit(5))
    file = F.regexp_extract(head, r"(?Us)(\S*)$", 1)
    digits = F.nullif(F.regexp_extract(F.substr(message, at + 7), r"^([0-9]+)", 1), F.lit(""))
    line = digits.try_cast("bigint")
    return F.when(
        at > 0,
        F.struct(
            file.alias("file"),
            F.when((line > 0) & (line <= 4_294_967_295), line).alias("line"),
        ),
    )


def is_package_manifest(path: Column) -> Column:
    """SF-31."""
    return basename(path).isin("Package.swift", "Package.resolved")


def project_of_log(path: Column) -> Column:
    """SF-32: directory before ``/Logs/`` without its generated suffix."""
    directory = last_segment(F.substring_index(path, "/Logs/", 1))
    name = captured(directory, r"^(.+)-[a-z0-9]{3,}$", 1)
    return F.coalesce(name, directory)
