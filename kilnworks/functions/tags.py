"""Metadata tags and user-supplied entries (PF-12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import TAG_MAX_KEY, TAG_MAX_VALUE, USER_MAX_ENTRIES
from .text import strip

ALLOWED_KEY = r"^[A-Za-z0-9_-]+$"


def tag_reason(key: Column, value: Column) -> Column:
    """Why a key or value is refused; null when both are fine."""
    return (
        F.when(F.length(key) == 0, F.lit("empty key"))
        .when(F.length(value) == 0, F.lit("empty value"))
        .when(F.octet_length(key) > TAG_MAX_KEY, F.lit("key too long"))
        .when(F.octet_length(value) > TAG_MAX_VALUE, F.lit("value too long"))
        .when(~key.rlike(ALLOWED_KEY), F.lit("key has other characters"))
    )


def parse_tag(argument: Column) -> Column:
    """struct(key, value, reason) of one ``key=value`` argument."""
    at = F.locate("=", argument)
    key = strip(F.substr(argument, F.lit(1), at - 1))
    value = strip(F.substr(argument, at + 1))
    reason = F.when(at == 0, F.lit("no equals sign")).otherwise(tag_reason(key, value))
    return F.struct(
        F.when(reason.isNull(), F.concat(F.lit("tag."), key)).alias("key"),
        F.when(reason.isNull(), value).alias("value"),
        reason.alias("reason"),
    )


def user_entry_reason(key: Column, value: Column) -> Column:
    """Like a tag, but an empty value is allowed."""
    return (
        F.when(F.length(key) == 0, F.lit("empty key"))
        .when(F.octet_length(key) > TAG_MAX_KEY, F.lit("key too long"))
        .when(~key.rlike(ALLOWED_KEY), F.lit("key has other characters"))
        .when(F.octet_length(value) > TAG_MAX_VALUE, F.lit("value too long"))
    )


def user_entries(document: Column) -> Column:
    """struct(entries, reason) of a user JSON object: string values only."""
    variant = F.try_parse_json(document)
    is_object = F.startswith(F.schema_of_variant(variant), F.lit("OBJECT"))
    keys = F.json_object_keys(document)
    entries = F.from_json(document, "map<string,string>")
    all_text = ~F.schema_of_variant(variant).rlike(r": (?!STRING)")
    bad = F.filter(
        F.map_entries(entries),
        lambda e: user_entry_reason(e["key"], e["value"]).isNotNull(),
    )
    first_bad = F.get(bad, F.lit(0))
    reason = (
        F.when(variant.isNull(), F.lit("not JSON"))
        .when(~is_object, F.lit("not an object"))
        .when(F.size(keys) > USER_MAX_ENTRIES, F.lit("too many entries"))
        .when(~all_text, F.lit("value is not a string"))
        .when(F.size(bad) > 0, user_entry_reason(first_bad["key"], first_bad["value"]))
    )
    return F.struct(
        F.when(
            reason.isNull(),
            F.transform_keys(entries, lambda k, v: F.concat(F.lit("user."), k)),
        ).alias("entries"),
        reason.alias("reason"),
    )
