"""Continuous ingest (ST-1 to ST-8).

Facts are appended by ``foreachBatch`` through the same store operations as batch
ingest, so a batch that is replayed changes nothing. The verdict of a build is the
view of :mod:`kilnworks.operators.verdict`; late results need no update in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as C
from ..operators.verdict import stored_status
from ..runtime import maybe_broadcast, written
from ..sources import documents
from ..sources.store import DAY_BOUND, HistoryStore, new_results

INTENTS = "day date, build_key string, run string, batch bigint"
CHANGES = "day date, build_key string, change string, run string, batch bigint"
REJECTS = "source string, value string, reason string, run string, batch bigint"
RESULTS = (
    "build_key string, suite string, name string, status string, seconds double, "
    "message string, attempt int"
)


def document_stream(
    spark: SparkSession, path: str, since: Column | None = None, files_per_trigger: int = 1000
) -> DataFrame:
    """ST-1: documents that appear under a path, each read once.

    ``since`` skips the backlog: files modified before it are not imported.
    """
    lines = (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
        .select(
            "value",
            F.col("_metadata.file_modification_time").alias("received_at"),
            F.col("_metadata.file_path").alias("source"),
        )
    )
    return lines if since is None else lines.where(F.col("received_at") >= since)


def result_stream(spark: SparkSession, path: str) -> DataFrame:
    """ST-3: late test results as JSON lines."""
    return spark.readStream.schema(RESULTS).json(path)


class Ingest:
    """Stores builds and results of a stream, with rejects and change messages.

    Tables beside the store are partitioned by run and batch. A run is one checkpoint:
    its id lies in the checkpoint folder, so streams that share a store, or a stream that
    starts anew, never write over each other, and a repeated batch writes over its own
    rows only.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self.store = HistoryStore(spark, root)

    def _write(self, rows: DataFrame, table: str, batch: int, run: str, mode: str) -> None:
        keyed = rows.withColumns({"run": F.lit(run), "batch": F.lit(batch)})
        keyed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(
            "run", "batch"
        ).parquet(f"{self.root}/{table}")

    def _write_once(self, rows: DataFrame, table: str, batch: int, run: str) -> None:
        self._write(rows, table, batch, run, "overwrite")

    # What a batch is about to store is noted first. If the batch is cut off after the
    # append, its repetition finds nothing new, but still announces what was noted.

    def _intend(self, keys: DataFrame, kind: str, batch: int, run: str) -> None:
        rows = keys.select("day", "build_key").distinct()
        self._write(rows, f"intents_{kind}", batch, run, "append")

    def _announce(self, kind: str, change: str, table: str, batch: int, run: str) -> None:
        noted = self._read(f"intents_{kind}", INTENTS)
        noted = noted.where((F.col("run") == run) & (F.col("batch") == batch))
        there = self.store.read(table).select("day", "build_key")
        days = maybe_broadcast(noted.select("day").distinct(), DAY_BOUND)
        keys = noted.select("day", "build_key").distinct()
        stored = keys.join(
            there.join(days, "day", "left_semi"), ["day", "build_key"], "left_semi"
        )
        message = stored.select("day", "build_key", F.lit(change).alias("change"))
        self._write_once(message, f"changes_{kind}", batch, run)

    def store_documents(self, batch_rows: DataFrame, batch: int, run: str = "") -> None:
        """ST-1, ST-2, ST-6, ST-7: validate, quarantine, shred, store, announce."""
        # One day for the whole batch, whose documents are read several times.
        today = F.lit(self.spark.range(1).select(F.current_date()).first()[0])
        read = documents.parse_documents(batch_rows, F.col("value"))
        bare = F.col("reason").isNull() & ~usable_document(F.col("doc"))
        refused = F.when(bare, F.lit("no usable measurements"))
        wrong = F.coalesce("reason", "refused").isNotNull()
        # The text stays only where it is handed on.
        kept = read.withColumn("refused", refused).withColumn("value", F.when(wrong, F.col("value")))
        parsed, _ = written(kept, "parsed")
        self._write_once(
            documents.rejected_documents(parsed).select("source", "value", "reason"),
            "rejected",
            batch,
            run,
        )
        bad = parsed.where(F.col("refused").isNotNull())
        self._write_once(
            bad.select("source", "value", F.col("refused").alias("reason")), "refused", batch, run
        )
        usable = parsed.where(F.col("refused").isNull()).drop("refused", "value")
        first = self._first_documents(documents.accepted_documents(usable, today), batch_rows, today)
        builds = documents.build_rows(first, F.col("received_at"))
        self.store.insert(
            builds,
            documents.shred(first, distinct=True),
            accepting=lambda keys: self._intend(keys, "builds", batch, run),
            distinct=True,
        )
        self._announce("builds", "stored", "builds", batch, run)

    def _first_documents(self, usable: DataFrame, batch_rows: DataFrame, today: Column) -> DataFrame:
        """One document per key: the first to arrive.

        Keys are counted first; only documents of a repeated key are moved, and read
        again with their text, which orders those that arrived together.
        """
        key = ["day", "build_key"]
        counted = usable.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        repeated, n = written(counted.where(F.col("_n") > 1).select(*key), "repeated")
        if not n:
            return usable
        read = documents.parse_documents(batch_rows, F.col("value"))
        again = documents.accepted_documents(read, today).where(usable_document())
        order = F.struct("received_at", "source", "value")
        once = (
            again.join(maybe_broadcast(repeated, n), key, "left_semi")
            .groupBy(*key)
            .agg(F.min_by(F.struct(*usable.columns), order).alias("_first"))
        )
        firsts, _ = written(once.select("_first.*"), "documents")
        return usable.join(maybe_broadcast(repeated, n), key, "left_anti").unionByName(firsts)

    def store_results(self, batch_rows: DataFrame, batch: int, run: str = "") -> None:
        """ST-3: attach results of known builds; park the others and retry them.

        A result without build, suite, name or status is rejected; without an attempt
        it is the first. Parked rows are only ever added: a later batch of any run
        attaches those whose build has come.
        """
        columns = [f.split()[0] for f in RESULTS.split(", ")]
        rows = batch_rows.select(*columns).withColumn("attempt", F.coalesce("attempt", F.lit(1)))
        whole = F.lit(True)
        for name in ("build_key", "suite", "name", "status"):
            whole = whole & F.col(name).isNotNull()
        rows, _ = written(rows.distinct(), "results")
        self._write_once(rows.where(~whole), "rejected_results", batch, run)
        rows = rows.where(whole)
        builds = self.store.read("builds")
        parked = rows.join(builds.select("build_key"), "build_key", "left_anti")
        self._write_once(parked, "parked_results", batch, run)
        everything = rows.unionByName(self._parked()).distinct()
        attached, count = written(
            new_results(everything, builds, self.store.read("build_tests")), "attached"
        )
        self._intend(attached, "results", batch, run)
        if count:
            self.store.append(attached, "build_tests")
        self._announce("results", "results", "build_tests", batch, run)

    def _parked(self) -> DataFrame:
        return self._read("parked_results", RESULTS + ", run string, batch bigint").drop(
            "run", "batch"
        )

    def waiting(self) -> DataFrame:
        """Results that came before their build and are not attached yet."""
        key = ["build_key", "suite", "name", "attempt"]
        stored = self.store.read("build_tests").select(*key)
        return self._parked().distinct().join(stored, key, "left_anti")

    def _read(self, table: str, schema: str) -> DataFrame:
        path = f"{self.root}/{table}"
        if not self.store._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def rejects(self) -> DataFrame:
        """ST-7: documents that were rejected or refused, with the reason."""
        return self._read("rejected", REJECTS).unionByName(self._read("refused", REJECTS))

    def changes(self) -> DataFrame:
        """ST-5: one message per stored build or attached result set."""
        return self._read("changes_builds", CHANGES).unionByName(
            self._read("changes_results", CHANGES)
        )

    def change_stream(self, table: str = "changes_builds") -> DataFrame:
        """ST-5: the change messages as a stream for other consumers.

        A batch that is repeated after a failure may send its messages again;
        :func:`kilnworks.streaming.stateful.delivered_once` drops the repetitions.
        """
        return self.spark.readStream.schema(CHANGES).parquet(f"{self.root}/{table}")

    def verdicts(self) -> DataFrame:
        """ST-4: build rows with the status their results give them now."""
        return stored_status(
            self.store.read("builds"),
            self.store.read("build_tests"),
            self.store.read("build_steps"),
        )

    def refresh_panel(
        self, name: str, panel: Callable[[DataFrame], DataFrame], touched_days: DataFrame
    ) -> None:
        """ST-8: rebuild a day-partitioned panel for the touched days only."""
        days = touched_days.select("day").distinct()
        builds = self.store.read("builds").join(
            maybe_broadcast(days, DAY_BOUND), "day", "left_semi"
        )
        panel(builds).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("day").parquet(f"{self.root}/panels/{name}")

    def _run_id(self, checkpoint: str) -> str:
        """The id of a checkpoint, made on its first start."""
        path = f"{checkpoint}/run-id"
        if not self.store._exists(f"{path}/_SUCCESS"):
            fresh = self.spark.range(1).select(F.lit(uuid.uuid4().hex).alias("run"))
            fresh.coalesce(1).write.mode("overwrite").text(path)
        return "r" + self.spark.read.text(path).first()[0]

    def run(
        self,
        stream: DataFrame,
        handler: Callable[[DataFrame, int, str], None],
        name: str,
        once: bool = False,
    ) -> StreamingQuery:
        checkpoint = f"{self.root}/checkpoints/{name}"
        run = self._run_id(checkpoint)
        writer = stream.writeStream.foreachBatch(
            lambda rows, batch: handler(rows, batch, run)
        ).option("checkpointLocation", checkpoint)
        if once:
            writer = writer.trigger(availableNow=True)
        return writer.start()


def usable_document(doc: Column | None = None) -> Column:
    """ST-7: a document with a measurement of real work.

    A clean action only sets up: it has no targets and files, compiled nothing, and all
    its phases are known preparations. It is no build, however long it took.
    """

    def field(name: str) -> Column:
        return F.col(name) if doc is None else doc[name]

    def items(name: str) -> Column:
        return F.size(F.coalesce(field(name), F.array()))

    measured = (items("files") > 0) | (items("swift_timings") > 0)
    bare = (items("targets") == 0) & (items("files") == 0) & (field("compiled_count") == 0)

    def preparation(phase: Column) -> Column:
        known = F.lit(False)
        for title in C.SETUP_PHASES:
            known = known | F.startswith(phase["name"], F.lit(title))
        return F.coalesce(known, F.lit(False))

    setup_only = bare & (items("phases") > 0) & F.forall(field("phases"), preparation)
    timed = field("total_seconds").isNotNull() & (
        (items("targets") > 0) | (items("phases") > 0)
    )
    return measured | (~setup_only & timed)


def deduplicated_stream(builds: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """ST-2, pure stream form: one row per (day, build_key) inside the watermark."""
    return builds.withWatermark("received_at", watermark).dropDuplicatesWithinWatermark(
        ["day", "build_key"]
    )
