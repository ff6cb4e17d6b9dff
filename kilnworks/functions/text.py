"""Small text helpers shared by the column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters with the Unicode White_Space property (fixed values).
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Unicode classes, and "." stops only at a newline.
UNICODE = "(?Ud)"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only the ASCII blank."""
    return F.btrim(text, F.lit(WHITESPACE))


def captured(text: Column, pattern: str, group: int = 1) -> Column:
    """The group's text, or null where the pattern or the group matched nothing."""
    return F.nullif(F.regexp_extract(text, UNICODE + pattern, group), F.lit(""))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(UNICODE + pattern)


def has_any(text: Column, needles) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(text, F.lit(needle))
    return hit


def slashes(path: Column) -> Column:
    """Backslash separators become forward slashes."""
    return F.translate(path, "\\", "/")


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
