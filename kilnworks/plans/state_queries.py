"""Registered queries over streams that keep state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import joined_in_place, scratch_path, unbroadcast
from ..streaming import stateful
from ..streaming.ingest import Ingest, document_stream
from ..streaming.panels import PercentilePanel
from .registry import Registry, Tables, day_text, rounded
from .store_queries import SHORT_ITEMS, quarter_documents

BUILDS = "build_key string, status string, received_at timestamp"
RESULTS = "build_key string, result_at timestamp"
# Results come from five minutes before their build to fifteen after it.
DELAY = "(cast(build_key as bigint) % 41 - 10) * 30"
IN_TIME = f"{DELAY} <= 600"


def _timed_files(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Streams of all builds and of the first result of each that has one.

    A last event on either side, a day after all others, moves the watermarks past them.
    """
    clock = t.builds.agg((F.max("received_at") + F.expr("interval 1 day")).alias("at"))
    builds = t.builds.select("build_key", "status", "received_at").unionByName(
        clock.select(F.lit("clock").alias("build_key"), F.lit("none").alias("status"), F.col("at").alias("received_at"))
    )
    tested = t.tests.select("build_key").distinct()
    results = (
        t.builds.join(tested, "build_key", "left_semi")
        .select("build_key", F.expr(f"received_at + make_dt_interval(0, 0, 0, {DELAY})").alias("result_at"))
        .unionByName(clock.select(F.lit("clock").alias("build_key"), F.col("at").alias("result_at")))
    )
    out = []
    for name, rows, schema in (("builds", builds, BUILDS), ("results", results, RESULTS)):
        path = scratch_path(t.spark, f"stream-{name}")
        with unbroadcast(t.spark):
            rows.write.parquet(path)
        out.append(t.spark.readStream.schema(schema).parquet(path))
    return out[0], out[1]


def _finished(stream: DataFrame, schema: str, name: str) -> DataFrame:
    """Rows of a stream that is run to its end."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-state")
    writer = stream.writeStream.format("parquet").option("checkpointLocation", state)
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(schema).parquet(out)


def alerts(t: Tables) -> DataFrame:
    return _finished(stateful.pending_alerts(*_timed_files(t)), stateful.ALERTS, "alerts")


def answered(t: Tables) -> DataFrame:
    joined = stateful.answered_builds(*_timed_files(t))
    rows = _finished(joined, f"{BUILDS}, result_at timestamp", "answered")
    return rows.where("build_key <> 'clock'")


def delivered(t: Tables) -> DataFrame:
    """Changes as a consumer gets them that reads on after a batch was repeated."""
    spark = t.spark
    source, out = scratch_path(spark, "incoming"), scratch_path(spark, "delivered")
    with joined_in_place(spark):
        quarter_documents(t).select("document").write.text(source, compression="gzip")
    ingest = Ingest(spark, scratch_path(spark, "history"))
    ingest.run(document_stream(spark, source), ingest.store_documents, "documents", once=True).awaitTermination()

    def consume() -> None:
        stream = stateful.delivered_once(ingest.change_stream())
        writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state")
        writer.trigger(availableNow=True).start(out).awaitTermination()

    consume()
    again = spark.read.text(source).select(
        "value",
        F.col("_metadata.file_modification_time").alias("received_at"),
        F.col("_metadata.file_path").alias("source"),
    )
    last = ingest.changes().agg(F.max(F.struct("run", "batch")).alias("m")).first()["m"]
    ingest.store_documents(again, last["batch"], last["run"])
    consume()
    return spark.read.schema(stateful.DELIVERED).parquet(out)


def percentile_panel(t: Tables) -> DataFrame:
    """Percentiles by day and project, refreshed by two streams into one store."""
    t.place(SHORT_ITEMS)
    ingest = Ingest(t.spark, scratch_path(t.spark, "history"))
    panel = PercentilePanel(ingest, "durations", "project", "total_seconds", {"p50": 0.5, "p95": 0.95})
    clean = F.col("category") == "clean"
    for name, part in (("clean", t.builds.where(clean)), ("other", t.builds.where(~clean))):
        source = scratch_path(t.spark, "incoming")
        with joined_in_place(t.spark):
            quarter_documents(t, part).select("document").write.text(source, compression="gzip")
        stream = document_stream(t.spark, source)
        ingest.run(stream, panel.store_documents, name, once=True).awaitTermination()
    return panel.read()


def register(r: Registry) -> None:
    r.add(
        "stream_percentile_panel",
        lambda t: rounded(day_text(percentile_panel(t)), "p50", "p95", digits=8),
        "v_builds v_targets",
        """select cast(cast(date_trunc('quarter', received_at) as date) as varchar) as day, project,
             count(*) as n, round(quantile_cont(total_seconds, 0.5), 8) as p50,
             round(quantile_cont(total_seconds, 0.95), 8) as p95 from v_builds
           where build_key in (select build_key from v_targets) group by 1, 2""",
    )
    r.add(
        "stream_pending_alerts",
        lambda t: alerts(t).select("build_key", F.unix_seconds("due_at").alias("due_at")),
        "v_builds v_tests",
        f"""select build_key, cast(epoch(received_at) as bigint) + 600 as due_at
            from v_builds b where status = 'pending_tests' and not ({IN_TIME} and exists (
              select 1 from v_tests t where t.build_key = b.build_key))""",
    )
    r.add(
        "stream_answered_builds",
        lambda t: answered(t).select(
            "build_key", "status", F.unix_seconds("result_at").alias("result_at")
        ),
        "v_builds v_tests",
        f"""select build_key, status, case when {IN_TIME} and build_key in (
              select build_key from v_tests)
              then cast(epoch(received_at) as bigint) + {DELAY} end as result_at from v_builds""",
    )
    r.add(
        "stream_delivered_changes",
        lambda t: delivered(t).select("build_key", "change"),
        "v_builds v_targets",
        """select build_key, 'stored' as change from v_builds
           where build_key in (select build_key from v_targets)""",
    )
