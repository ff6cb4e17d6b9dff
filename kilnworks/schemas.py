"""Stored tables and the build document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# table -> (DDL, key columns)
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "builds": (
        "build_key string, day date, project string, category string, total_seconds double, "
        "compiled_count int, cache_hit_rate double, started_at double, machine_id string, "
        "xcode_version string, platform string, architecture string, received_at timestamp, "
        "error_count int, warning_count int, status string, scheme string, "
        "replayed_steps int, build_user string, build_host string",
        ("day", "build_key"),
    ),
    "build_targets": (
        "day date, build_key string, name string, seconds double, category string, "
        "fetched_from_cache boolean, compiled_count int",
        ("day", "build_key", "name"),
    ),
    "build_phases": (
        "day date, build_key string, name string, seconds double",
        ("day", "build_key", "name"),
    ),
    "build_files": (
        "day date, build_key string, file string, architecture string, seconds double, "
        "target string, step_type string, occurrences int",
        ("day", "build_key", "file", "architecture"),
    ),
    "build_swift_timings": (
        "day date, build_key string, kind string, file string, line int, column_number int, "
        "symbol string, milliseconds double, target string",
        ("day", "build_key", "kind", "file", "line", "column_number"),
    ),
    "build_diagnostics": (
        "day date, build_key string, fingerprint string, severity string, category string, "
        "occurrences int, message string, file string, line int, target string",
        ("day", "build_key", "fingerprint"),
    ),
    "build_tests": (
        "day date, build_key string, suite string, name string, status string, "
        "seconds double, message string, attempt int",
        ("day", "build_key", "suite", "name", "attempt"),
    ),
    "build_steps": (
        "day date, build_key string, ordinal int, fingerprint string, step_type string, "
        "title string, file string, target string, architecture string, seconds double, "
        "started_at double, ended_at double, fetched_from_cache boolean, executed boolean",
        ("day", "build_key", "ordinal"),
    ),
    "build_metadata": (
        "day date, build_key string, key string, value string",
        ("day", "build_key", "key"),
    ),
}

CHILD_TABLES = tuple(name for name in TABLES if name != "builds")

WIRE = (
    "wire_version int, build_key string, project string, category string, "
    "total_seconds double, compiled_count bigint, cache_hit_rate double, "
    "error_count bigint, warning_count bigint, status string, started_at double, "
    "attribution string, machine_id string, user string, host string, "
    "xcode_version string, platform string, architecture string, "
    "targets array<struct<name:string,seconds:double,category:string,"
    "fetched_from_cache:boolean,compiled_count:bigint>>, "
    "phases array<struct<name:string,seconds:double>>, "
    "files array<struct<file:string,seconds:double,target:string,step_type:string,"
    "architecture:string,occurrences:bigint>>, "
    "swift_timings array<struct<kind:string,file:string,line:bigint,column:bigint,"
    "symbol:string,milliseconds:double,target:string>>, "
    "steps array<struct<fingerprint:string,step_type:string,title:string,file:string,"
    "target:string,architecture:string,seconds:double,started_at:double,ended_at:double,"
    "fetched_from_cache:boolean,executed:boolean>>, "
    "diagnostics array<struct<fingerprint:string,severity:string,category:string,"
    "occurrences:bigint,message:string,file:string,line:bigint,target:string>>, "
    "tests array<struct<suite:string,name:string,status:string,seconds:double,"
    "message:string>>"
)


def columns(table: str) -> list[str]:
    return [part.split()[0] for part in TABLES[table][0].split(", ")]


def typed(rows: DataFrame, table: str) -> DataFrame:
    """The table's columns, in order and with their stored types."""
    fields = [part.split() for part in TABLES[table][0].split(", ")]
    return rows.select(*(F.col(name).cast(kind).alias(name) for name, kind in fields))
