"""Build documents: validation and shredding into stored rows (SRC-2, SRC-3, SRC-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..functions.activity import day_of
from ..operators.caps import attempt_numbers

REQUIRED = (
    "wire_version",
    "build_key",
    "project",
    "category",
    "total_seconds",
    "compiled_count",
    "error_count",
    "warning_count",
    "attribution",
    "targets",
    "phases",
)
# Starts from the year 10000 on are no clock's; no partition is made for them.
START_LIMIT = 253_402_300_800.0
DETAIL = ("files", "swift_timings", "steps", "diagnostics", "tests")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per line; bad lines are kept with a reason."""
    return parse_documents(spark.read.text(path), F.col("value"))


def parse_documents(rows: DataFrame, text: Column) -> DataFrame:
    """SRC-2: the document as struct ``doc``, and ``reason`` when it is refused."""
    parsed = F.from_json(
        text,
        schemas.WIRE + ", _corrupt string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    # An exploded text is parsed once; a filter on the reason would parse it again for
    # every field that the reason looks at.
    once = rows.select("*", F.explode(F.array(parsed)).alias("doc"))
    return once.withColumn("reason", refusal(F.col("doc")))


def refusal(doc: Column) -> Column:
    """Why a document is refused; null when it is accepted."""
    missing = F.lit(False)
    for name in REQUIRED:
        missing = missing | doc[name].isNull()
    negative = (
        (doc["compiled_count"] < 0) | (doc["error_count"] < 0) | (doc["warning_count"] < 0)
    )
    known = (
        doc["category"].isin(*C.BUILD_CATEGORIES)
        & doc["attribution"].isin(*C.ATTRIBUTIONS)
        & (doc["status"].isNull() | doc["status"].isin(*C.BUILD_STATUSES))
        & F.forall(doc["targets"], lambda t: t["category"].isin(*C.BUILD_CATEGORIES))
    )
    start = doc["started_at"]
    impossible = (start >= START_LIMIT) & (start < F.lit(float("inf")))
    return (
        F.when(doc.isNull() | doc["_corrupt"].isNotNull(), F.lit("not a build document"))
        .when(missing | negative | ~known, F.lit("not a build document"))
        .when(doc["wire_version"] != C.WIRE_VERSION, F.lit("unsupported wire version"))
        .when(F.length(doc["build_key"]) == 0, F.lit("empty build key"))
        .when(impossible, F.lit("start time out of range"))
    )


def accepted_documents(parsed: DataFrame, today: Column | None = None) -> DataFrame:
    """One row per accepted document; absent detail lists are empty."""
    good = parsed.where(F.col("reason").isNull())
    others = [c for c in parsed.columns if c not in ("doc", "reason")]
    flat = good.select(*others, "doc.*").drop("_corrupt")
    return flat.withColumns({c: F.coalesce(c, F.array()) for c in DETAIL}).withColumn(
        "day", day_of(F.col("started_at"), today)
    )


def rejected_documents(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).drop("doc")


def build_rows(documents: DataFrame, received_at: Column) -> DataFrame:
    """The ``builds`` row of each document."""
    return documents.select(
        "build_key",
        "day",
        "project",
        "category",
        "total_seconds",
        F.col("compiled_count").cast("int"),
        "cache_hit_rate",
        "started_at",
        "machine_id",
        "xcode_version",
        "platform",
        "architecture",
        received_at.alias("received_at"),
        F.col("error_count").cast("int"),
        F.col("warning_count").cast("int"),
        "status",
        F.lit(None).cast("string").alias("scheme"),
        F.lit(0).alias("replayed_steps"),
        F.col("user").alias("build_user"),
        F.col("host").alias("build_host"),
    )


def _exploded(documents: DataFrame, name: str) -> DataFrame:
    return documents.select("day", "build_key", F.posexplode(name).alias("position", "_item")).select(
        "day", "build_key", "position", "_item.*"
    )


def _first_items(documents: DataFrame, name: str, *keys: str, blank: str = "") -> DataFrame:
    """The items of a list; on a repeated key the first of the list stays.

    Found inside the list, so no item is moved. Items sorted by key and place repeat the
    key of the item before. A missing ``blank`` field is the empty text.
    """

    def field(item: Column, key: str) -> Column:
        return F.coalesce(item[key], F.lit("")) if key == blank else item[key]

    def placed(item: Column, place: Column) -> Column:
        key = F.struct(*(field(item, k).alias(k) for k in keys))
        return F.struct(key.alias("key"), place.alias("place"), item.alias("item"))

    def firsts(items: Column) -> Column:
        return F.filter(
            items,
            lambda item, i: (i == 0) | ~item["key"].eqNullSafe(F.get(items, i - 1)["key"]),
        )

    # The one-element list names the sorted items, which are then sorted once.
    kept = F.transform(F.array(F.sort_array(F.transform(name, placed))), firsts)
    rows = documents.select("day", "build_key", F.explode(F.get(kept, F.lit(0))).alias("_kept"))
    rows = rows.select("day", "build_key", F.col("_kept.place").alias("position"), "_kept.item.*")
    return rows.withColumn(blank, F.coalesce(blank, F.lit(""))) if blank else rows


def _first_per_key(rows: DataFrame, table: str) -> DataFrame:
    """On a key that several documents hold the first place in their lists stays."""
    keys = list(schemas.TABLES[table][1])
    rest = [c for c in schemas.columns(table) if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), "position").alias("_row"))
    return first.select(*keys, "_row.*")


def shred(documents: DataFrame, distinct: bool = False) -> dict[str, DataFrame]:
    """SRC-3: child rows by table.

    Of ``distinct`` documents, each with a key of its own, no row but those of tests is
    moved.
    """
    timings = _first_items(documents, "swift_timings", "kind", "file", "line", "column")
    keyed = {
        "build_targets": _first_items(documents, "targets", "name"),
        "build_phases": _first_items(documents, "phases", "name"),
        "build_files": _first_items(documents, "files", "file", "architecture", blank="architecture"),
        "build_swift_timings": timings.withColumnRenamed("column", "column_number"),
        "build_diagnostics": _first_items(documents, "diagnostics", "fingerprint"),
    }
    if not distinct:
        keyed = {table: _first_per_key(frame, table) for table, frame in keyed.items()}
    rows = {
        **keyed,
        "build_steps": _exploded(documents, "steps").withColumn("ordinal", F.col("position")),
        "build_tests": attempt_numbers(_exploded(documents, "tests")),
    }
    return {table: schemas.typed(frame, table) for table, frame in rows.items()}


def _nested(
    children: DataFrame, name: str, order: list[str], fields: list[str | Column]
) -> DataFrame:
    """Child rows of each build as one ordered array, as a document holds them; never
    broadcast, however small the files that it is read from."""
    item = F.struct(*order, F.struct(*fields).alias("_item"))
    return children.groupBy("day", "build_key").agg(
        F.transform(F.sort_array(F.collect_list(item)), lambda e: e["_item"]).alias(name)
    ).hint("merge")


def export_documents(
    builds: DataFrame,
    targets: DataFrame,
    phases: DataFrame,
    tests: DataFrame | None = None,
    files: DataFrame | None = None,
    timings: DataFrame | None = None,
    steps: DataFrame | None = None,
    diagnostics: DataFrame | None = None,
) -> DataFrame:
    """SRC-9: (build_key, document) with one JSON text per build.

    Lists are whole: a document holds every row of its build, in the order of W-12,
    tests and steps in log order and diagnostics by fingerprint. A caller who wants shorter lists caps them before (W-12,
    W-13). Durations that are not finite are written as null, and null fields stay.
    """
    finite = F.when(
        ~F.isnan("total_seconds") & (F.abs("total_seconds") < F.lit(float("inf"))),
        F.col("total_seconds"),
    )
    keys = ["day", "build_key"]
    joined = (
        builds.withColumn("total_seconds", finite)
        .join(
            _nested(
                targets.withColumn("_slow", -F.col("seconds")),
                "targets",
                ["_slow", "name"],
                ["name", "seconds", "category", "fetched_from_cache", "compiled_count"],
            ),
            keys,
            "left",
        )
        .join(
            _nested(
                phases.withColumn("_slow", -F.col("seconds")),
                "phases",
                ["_slow", "name"],
                ["name", "seconds"],
            ),
            keys,
            "left",
        )
    )
    nested = ["targets", "phases"]
    if tests is not None:
        fields = ["suite", "name", "status", "seconds", "message"]
        joined = joined.join(_nested(tests, "tests", ["position"], fields), keys, "left")
        nested.append("tests")
    if files is not None:
        fields = ["file", "seconds", "target", "step_type", "architecture", "occurrences"]
        slow = files.withColumn("_slow", -F.col("seconds"))
        joined = joined.join(
            _nested(slow, "files", ["_slow", "file", "step_type", "architecture"], fields), keys, "left"
        )
        nested.append("files")
    if timings is not None:
        fields = ["kind", "file", "line", F.col("column_number").alias("column"), "symbol", "milliseconds", "target"]
        slow = timings.withColumn("_slow", -F.col("milliseconds"))
        order = ["_slow", "kind", "file", "line", "column_number"]
        joined = joined.join(_nested(slow, "swift_timings", order, fields), keys, "left")
        nested.append("swift_timings")
    if steps is not None:
        fields = ["fingerprint", "step_type", "title", "file", "target", "architecture", "seconds"]
        fields += ["started_at", "ended_at", "fetched_from_cache", "executed"]
        joined = joined.join(_nested(steps, "steps", ["ordinal"], fields), keys, "left")
        nested.append("steps")
    if diagnostics is not None:
        fields = ["fingerprint", "severity", "category", "occurrences", "message", "file", "line", "target"]
        joined = joined.join(_nested(diagnostics, "diagnostics", ["fingerprint"], fields), keys, "left")
        nested.append("diagnostics")
    body = F.struct(
        F.lit(C.WIRE_VERSION).alias("wire_version"),
        "build_key",
        "project",
        "category",
        "total_seconds",
        "compiled_count",
        "cache_hit_rate",
        "error_count",
        "warning_count",
        "status",
        "started_at",
        F.lit("identified").alias("attribution"),
        "machine_id",
        F.col("build_user").alias("user"),
        F.col("build_host").alias("host"),
        "xcode_version",
        "platform",
        "architecture",
        *(F.coalesce(c, F.array()).alias(c) for c in nested),
    )
    text = F.to_json(body, {"ignoreNullFields": "false"})
    return joined.select("build_key", text.alias("document"))
