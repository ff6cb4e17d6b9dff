"""Stateful streams: alerts for builds without results, late results, one delivery of changes.

State is bounded by event time: whatever the watermark has passed is decided, emitted if
need be, and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WAIT = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PENDING = "pending_tests"
# Earlier than any time a timestamp can hold, in milliseconds.
NEVER = -(1 << 62)
# Keys of one run that share a state of delivered messages.
RUN_SHARDS = 64
# Shards of the keys of builds that wait for results.
ALERT_SHARDS = 1024

ALERTS = "build_key string, received_at timestamp, due_at timestamp"
DELIVERED = "day date, build_key string, change string, run string, batch bigint"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Streams with timers or maps need it; it holds for streams started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _millis(spark: SparkSession, interval: str) -> int:
    parts = F.expr(f"unix_millis(timestamp_seconds(0) + interval {interval})")
    return spark.range(1).select(parts).first()[0]


class PendingAlerts(StatefulProcessor):
    """Per shard of keys: the builds that wait, when they came and whether results came.

    Results ahead of their build are remembered for as long as they can count. A shard has
    one timer, for the first of its waits to end: state is read and written once a shard and
    batch, not once a build.
    """

    def __init__(self, wait: int, early: int):
        self.wait, self.early = wait, early

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState(
            "waiting", "keys array<string>, received array<bigint>, answered array<boolean>"
        )
        self.ahead = handle.getValueState("ahead", "keys array<string>, results array<array<bigint>>")
        self.timer = handle.getValueState("timer", "at bigint")

    def _load(self) -> tuple[dict[str, tuple[int, bool]], dict[str, list[int]]]:
        """Builds with their arrival and whether they are answered; results of no build yet."""
        builds, results = {}, {}
        if self.waiting.exists():
            keys, received, answered = self.waiting.get()
            builds = dict(zip(keys, zip(received, answered)))
        if self.ahead.exists():
            results = dict(zip(*self.ahead.get()))
        return builds, results

    def _save(self, builds: dict[str, tuple[int, bool]], results: dict[str, list[int]]) -> None:
        if builds:
            received, answered = zip(*builds.values())
            self.waiting.update((list(builds), list(received), list(answered)))
        else:
            self.waiting.clear()
        if results:
            self.ahead.update((list(results), [list(ats) for ats in results.values()]))
        else:
            self.ahead.clear()
        ends = [received + self.wait for received, _ in builds.values()]
        ends += [max(ats) + self.early for ats in results.values()]
        before = self.timer.get()[0] if self.timer.exists() else None
        first = min(ends, default=None)
        if first == before:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if first is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(first)
            self.timer.update((first,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pending: dict[str, int] = {}
        came: dict[str, list[int]] = {}
        for part in rows:
            for build, kind, at in zip(part["build_key"], part["kind"], part["at_millis"].tolist()):
                if kind == "pending":
                    pending[build] = min(at, pending.get(build, at))
                elif kind == "result":
                    came.setdefault(build, []).append(at)
        builds, results = self._load()
        for build, at in pending.items():
            if build not in builds:
                builds[build] = at, False
                came[build] = came.get(build, []) + list(results.pop(build, ()))
        for build, ats in came.items():
            if build in builds:
                received, answered = builds[build]
                in_time = any(received - self.early <= at <= received + self.wait for at in ats)
                builds[build] = received, answered or in_time
            else:
                results[build] = sorted({*results.get(build, ()), *ats})
        self._save(builds, results)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        builds, results = self._load()
        # Spark deletes a timer that has expired.
        self.timer.clear()
        ended = {b: v for b, v in builds.items() if v[0] + self.wait <= now}
        self._save(
            {b: v for b, v in builds.items() if b not in ended},
            {b: ats for b, ats in results.items() if max(ats) + self.early > now},
        )
        silent = [(b, received) for b, (received, answered) in ended.items() if not answered]
        if silent:
            keys, received = zip(*silent)
            received = pd.Series(received, dtype="int64")
            yield pd.DataFrame(
                {
                    "build_key": keys,
                    "received_at": pd.to_datetime(received, unit="ms"),
                    "due_at": pd.to_datetime(received + self.wait, unit="ms"),
                }
            )

    def close(self) -> None:
        pass


def pending_alerts(
    builds: DataFrame, results: DataFrame, wait: str = WAIT, early: str = WAIT, lateness: str = WAIT
) -> DataFrame:
    """ST-4: one row per pending build whose results did not come within the wait.

    ``builds(build_key, received_at, status)``, ``results(build_key, result_at)``. A
    result counts from ``early`` before its build to ``wait`` after it. The alert comes
    once the watermark, ``lateness`` behind the newest event, has passed the end of the
    wait; every build moves it, pending or not. Rows without a key or a time are ignored.
    """
    spark = builds.sparkSession
    keep_state_on_disk(spark)
    kind = F.when(F.col("status") == PENDING, "pending").otherwise("other")
    events = builds.select("build_key", kind.alias("kind"), F.col("received_at").alias("at"))
    events = events.unionByName(
        results.select("build_key", F.lit("result").alias("kind"), F.col("result_at").alias("at"))
    )
    keyed = (
        events.where(F.col("build_key").isNotNull() & F.col("at").isNotNull())
        .withWatermark("at", lateness)
        .withColumn("at_millis", F.unix_millis("at"))
        # Other builds only move the watermark. The second term, which never holds, names
        # the time, so that the planner leaves this filter above the watermark.
        .where((F.col("kind") != "other") | (F.col("at_millis") < NEVER))
    )
    processor = PendingAlerts(_millis(spark, wait), _millis(spark, early))
    shard = F.pmod(F.xxhash64("build_key"), F.lit(ALERT_SHARDS))
    return keyed.withColumn("shard", shard).groupBy("shard").transformWithStateInPandas(
        processor, ALERTS, outputMode="Append", timeMode="EventTime"
    )


def answered_builds(
    builds: DataFrame, results: DataFrame, wait: str = WAIT, early: str = WAIT, lateness: str = WAIT
) -> DataFrame:
    """ST-3 as a stream-stream outer join: builds with the results that came in time.

    ``builds(build_key, received_at, ...)``, ``results(build_key, result_at, ...)``, no
    other name in both. A build without such a result has one row without it, which
    appears once both watermarks have passed the time in which one could come; then
    neither side keeps the build or the result any longer.
    """
    left = builds.withWatermark("received_at", lateness)
    right = results.withColumnRenamed("build_key", "_result_key").withWatermark("result_at", lateness)
    same = F.expr(
        f"build_key = _result_key and result_at >= received_at - interval {early} "
        f"and result_at <= received_at + interval {wait}"
    )
    return left.join(right, same, "leftOuter").drop("_result_key")


class DeliveredOnce(StatefulProcessor):
    """Per run and shard of keys: the last batch, and what it has delivered.

    A run numbers its batches and ends one before it starts the next, so a message of an
    earlier batch, or one that the last batch has sent before, is a repetition.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "batch bigint, sent array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows))
        last, sent = self.last.get() if self.last.exists() else (-1, ())
        sent = set(sent)
        fresh = []
        for row in part.sort_values(["batch", "build_key", "change"]).itertuples(index=False):
            if row.batch < last:
                continue
            if row.batch > last:
                last, sent = row.batch, set()
            message = f"{row.change} {row.build_key}"
            if message not in sent:
                sent.add(message)
                fresh.append((row.day, row.build_key, row.change, row.run, row.batch))
        self.last.update((int(last), sorted(sent)))
        yield pd.DataFrame(fresh, columns=["day", "build_key", "change", "run", "batch"])

    def close(self) -> None:
        pass


def delivered_once(changes: DataFrame) -> DataFrame:
    """ST-5: a stream of change messages without the repetitions of replayed batches.

    State holds the messages of one batch per run, whatever the number of builds.
    """
    keep_state_on_disk(changes.sparkSession)
    shard = F.pmod(F.xxhash64("build_key"), F.lit(RUN_SHARDS)).alias("shard")
    names = ["day", "build_key", "change", "run", "batch"]
    return (
        changes.select(*names, shard)
        .groupBy("run", "shard")
        .transformWithStateInPandas(DeliveredOnce(), DELIVERED, outputMode="Append", timeMode="None")
    )
