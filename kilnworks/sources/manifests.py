"""Test-run manifests and their pairing with builds (SRC-5, J-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.ordered import carry_each, earlier_chunks, line_chunk
from .text_logs import read_raw_lines

FILE = ["manifest_id"]
BOUNDARY = "auxiliaryLogUniqueIdentifier"


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return read_raw_lines(spark, path).withColumnRenamed("log_id", "manifest_id")


def _tag(line: Column, tag: str) -> Column:
    """Text of a line that is exactly one element of this tag."""
    open_, close = f"<{tag}>", f"</{tag}>"
    size = F.length(line) - len(open_) - len(close)
    whole = F.startswith(line, F.lit(open_)) & F.endswith(line, F.lit(close)) & (size >= 0)
    return F.when(whole, F.substr(line, F.lit(len(open_) + 1), size))


def manifest_entries(lines: DataFrame) -> DataFrame:
    """SRC-5: (manifest_id, file_name, activity_log_id, test_failures, domain_type).

    ``lines(manifest_id, line_no, line)``. A value belongs to the key on the line
    before it; an entry ends at the first boundary key after its file name.
    """
    line = strip(F.col("line"))
    keyed = lines.select(*FILE, "line_no", line.alias("line")).withColumn(
        "key", _tag(F.col("line"), "key")
    )
    observable = F.when(F.col("key").isin("primaryObservable", "auxiliaryObservable"), F.col("key"))
    before = {"_previous": F.struct("key"), "_observable": observable}
    marked = carry_each(keyed, FILE, ["line_no"], before, line_chunk())
    values = marked.where(F.col("key").isNull() & F.col("_previous.key").isNotNull()).select(
        *FILE,
        "line_no",
        F.col("_previous.key").alias("key"),
        _tag(F.col("line"), "string").alias("text"),
        _tag(F.col("line"), "integer").try_cast("bigint").alias("number"),
        (F.col("_observable") == "primaryObservable").alias("primary"),
    )
    wanted = values.where(
        F.col("key").isin(BOUNDARY, "domainType", "fileName")
        | ((F.col("key") == "totalNumberOfTestFailures") & F.col("primary"))
    )
    entered = _entries(wanted)

    def last(key: str, value: str) -> Column:
        return F.max_by(value, F.when(F.col("key") == key, F.col("line_no")))

    return (
        entered.groupBy(*FILE, "_entry")
        .agg(
            last("fileName", "text").alias("file_name"),
            last(BOUNDARY, "text").alias("activity_log_id"),
            last("totalNumberOfTestFailures", "number").alias("test_failures"),
            last("domainType", "text").alias("domain_type"),
        )
        .where(F.col("file_name").isNotNull())
        .drop("_entry")
    )


def _entries(wanted: DataFrame) -> DataFrame:
    """Adds ``_entry``: the last line up to each that ends an entry.

    An entry ends at a boundary key whose nearest boundary or file name before it is a
    file name. A chunk's own lines decide this but for its first such key, for which the
    last one of the chunks before decides.
    """
    stop = F.when(F.col("key").isin(BOUNDARY, "fileName"), F.col("key"))
    tagged = wanted.withColumns({"_chunk": line_chunk(), "_stop": stop})
    inside = Window.partitionBy(*FILE, "_chunk").orderBy("line_no")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = F.last("_stop", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    ends = F.when((F.col("_stop") == BOUNDARY) & (F.col("_before") == "fileName"), F.col("line_no"))
    local = (
        tagged.withColumn("_before", before)
        .withColumn("_ends", ends)
        .withColumn("_here", F.max("_ends").over(so_far))
    )
    stops = F.when(F.col("_stop").isNotNull(), F.col("line_no"))
    chunks = local.groupBy(*FILE, "_chunk").agg(
        F.min(F.when(F.col("_stop").isNotNull(), F.struct("line_no", "_stop"))).alias("_first"),
        F.max_by("_stop", stops).alias("_last"),
        F.max("_ends").alias("_inner"),
    )
    earlier = earlier_chunks(FILE)
    opened = (F.col("_first._stop") == BOUNDARY) & (F.col("_carried") == "fileName")
    carried = (
        chunks.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier))
        .withColumn("_opens", F.when(opened, F.col("_first.line_no")))
        .withColumn("_outer", F.max(F.coalesce("_inner", "_opens")).over(earlier))
        .select(*FILE, "_chunk", "_opens", "_outer")
    )
    reached = F.when(F.col("_opens") <= F.col("line_no"), F.col("_opens"))
    return local.join(carried, [*FILE, "_chunk"]).withColumn(
        "_entry", F.coalesce("_here", reached, "_outer")
    )


def paired_results(entries: DataFrame, builds: DataFrame) -> DataFrame:
    """J-12: the result bundle of each build, by the id Xcode recorded."""
    named = entries.where(F.col("activity_log_id").isNotNull())
    return named.withColumnRenamed("activity_log_id", "build_key").join(
        builds.select("day", "build_key"), "build_key"
    )
