"""The day-partitioned history store (SRC-7, SRC-8, SRC-10, SRC-11).

Facts are append-only Parquet tables partitioned by day. Keys are kept unique by
anti joins before each append; the build row is written last, so a repeated
batch completes what an interrupted one left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.activity import day_of
from ..operators import retention
from ..runtime import maybe_broadcast, written

# Days in one batch or one retention run: one row each, a century is 36 525.
DAY_BOUND = 40_000


def with_day(builds: DataFrame, today: Column | None = None) -> DataFrame:
    """SRC-7: partition day from the start time."""
    return builds.withColumn("day", day_of(F.col("started_at"), today))


def first_writer(batch: DataFrame, arrival: str) -> DataFrame:
    """One row per (day, build_key): the first to arrive."""
    rest = [c for c in batch.columns if c not in ("day", "build_key")]
    order = F.struct(F.col(arrival), *(F.col(c) for c in rest if c != arrival))
    return (
        batch.groupBy("day", "build_key")
        .agg(F.min_by(F.struct(*rest), order).alias("_row"))
        .select("day", "build_key", "_row.*")
        .select(*batch.columns)
    )


def unseen(batch: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet; only the batch's days are scanned."""
    days = batch.select("day").distinct()
    there = stored.join(maybe_broadcast(days, DAY_BOUND), "day", "left_semi").select(*keys)
    return batch.join(there, keys, "left_anti")


def accepted(batch: DataFrame, stored: DataFrame, arrival: str) -> DataFrame:
    """SRC-8 as a plan: build rows to insert."""
    return unseen(first_writer(batch, arrival), stored, ["day", "build_key"])


def insert_outcome(batch: DataFrame, stored: DataFrame, arrival: str) -> DataFrame:
    """SRC-8: for every key of the batch, ``stored`` or ``duplicate``."""
    fresh = accepted(batch, stored, arrival).select("day", "build_key", F.lit(True).alias("_new"))
    outcome = F.when(F.col("_new"), F.lit("stored")).otherwise(F.lit("duplicate"))
    return (
        batch.select("day", "build_key")
        .distinct()
        .join(fresh, ["day", "build_key"], "left")
        .select("day", "build_key", outcome.alias("outcome"))
    )


def new_results(results: DataFrame, builds: DataFrame, stored_tests: DataFrame) -> DataFrame:
    """SRC-11 as a plan: late results of known builds that are not stored yet.

    The day comes from the build; results of unknown builds give no row.
    """
    days = builds.select("build_key", "day")
    key = ["day", "build_key", "suite", "name", "attempt"]
    placed = results.join(days, "build_key")
    once = placed.groupBy(*key).agg(
        F.min(F.struct("status", "seconds", "message")).alias("_row")
    )
    return unseen(once, stored_tests, key).select(
        *key[:-1], "_row.status", "_row.seconds", "_row.message", "attempt"
    )


def kept_rows(rows: DataFrame, doomed: DataFrame) -> DataFrame:
    """SRC-10 as a plan: what retention leaves of a table."""
    return rows.join(doomed.select("day", "build_key"), ["day", "build_key"], "left_anti")


@dataclass
class HistoryStore:
    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame:
        ddl = schemas.TABLES[table][0]
        if not self._exists(self.path(table)):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(self.path(table)).select(
            *schemas.columns(table)
        )

    def append(self, rows: DataFrame, table: str) -> None:
        """Append rows, gathered by day so that a day gets few files.

        A day with very many rows is split again by the planner, which aims at
        its advisory partition size.
        """
        (
            schemas.typed(rows, table)
            .hint("rebalance", "day")
            .write.mode("append")
            .option("compression", "zstd")
            .partitionBy("day")
            .parquet(self.path(table))
        )

    def insert(
        self,
        builds: DataFrame,
        children: dict[str, DataFrame],
        arrival: str = "received_at",
        accepting: Callable[[DataFrame], None] | None = None,
        distinct: bool = False,
    ) -> DataFrame:
        """SRC-8: store new builds with their rows; returns the accepted keys.

        Children first, the build row last: an interrupted insert is repeated
        whole, and what it already wrote is recognised table by table. ``accepting``
        gets the accepted keys before anything is stored.

        ``distinct`` builds are stored rows with a key of their own, and the children are
        theirs alone: then only keys are compared, and rows move once, to their day.
        """
        key = ["day", "build_key"]
        total = -1
        if distinct:
            found, total = written(builds.select(*key), "found")
            known = self._exists(self.path("builds"))
            fresh = unseen(found, self.read("builds"), key) if known else found
        else:
            fresh = accepted(builds, self.read("builds"), arrival)
        fresh, count = written(fresh, "accepted")
        keys = fresh.select(*key)
        if accepting:
            accepting(keys)
        if not count:
            return keys

        def mine(rows: DataFrame) -> DataFrame:
            if count == total:
                return rows
            return rows.join(maybe_broadcast(keys, count), key, "left_semi")

        for table, rows in children.items():
            new = mine(rows)
            if self._exists(self.path(table)):
                stored = self.read(table).select(*key).distinct()
                days = maybe_broadcast(keys.select("day").distinct(), DAY_BOUND)
                there = stored.join(days, "day", "left_semi")
                done, n = written(keys.join(there, key, "left_semi"), "done")
                if n:
                    new = new.join(maybe_broadcast(done, n), key, "left_anti")
            self.append(new, table)
        self.append(mine(builds) if distinct else fresh, "builds")
        return keys

    def attach_tests(self, results: DataFrame) -> int:
        """SRC-11: returns the number of newly stored results."""
        rows, count = written(
            new_results(results, self.read("builds"), self.read("build_tests")), "results"
        )
        if count:
            self.append(rows, "build_tests")
        return count

    def prune_preview(self, keep_days: int, now: Column) -> DataFrame:
        return retention.prunable_builds(self.read("builds"), keep_days, now)

    def prune(self, keep_days: int, now: Column) -> int:
        """SRC-10: drop whole days, rewrite days that keep some builds."""
        builds = self.read("builds")
        doomed, total = written(
            retention.prunable_builds(builds, keep_days, now).select("day", "build_key"),
            "doomed",
        )
        if not total:
            return 0
        whole_days = [
            r["day"] for r in retention.droppable_days(builds, keep_days, now).collect()
        ]
        mixed = doomed.where(~F.col("day").isin(whole_days)) if whole_days else doomed
        mixed_days = mixed.select("day").distinct()
        for table in (*schemas.CHILD_TABLES, "builds"):
            if not self._exists(self.path(table)):
                continue
            for day in whole_days:
                self._remove(f"{self.path(table)}/day={day}")
            touched = self.read(table).join(
                maybe_broadcast(mixed_days, DAY_BOUND), "day", "left_semi"
            )
            before = {r["day"] for r in touched.select("day").distinct().collect()}
            rest, _ = written(kept_rows(touched, mixed), "kept")
            after = {r["day"] for r in rest.select("day").distinct().collect()}
            if after:
                (
                    rest.hint("rebalance", "day")
                    .write.mode("overwrite")
                    .option("partitionOverwriteMode", "dynamic")
                    .partitionBy("day")
                    .parquet(self.path(table))
                )
            for day in before - after:
                self._remove(f"{self.path(table)}/day={day}")
        return total

    def _file(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _exists(self, path: str) -> bool:
        system, file = self._file(path)
        return system.exists(file)

    def _remove(self, path: str) -> None:
        system, file = self._file(path)
        system.delete(file, True)
