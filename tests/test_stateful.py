"""Streams with state: alerts, late results, one delivery; restarts and bounded state."""

import pytest
from pyspark.sql import functions as F

from kilnworks.streaming import stateful
from kilnworks.streaming.ingest import CHANGES

MINUTE = 60


class Files:
    """Streams over folders that rows are added to, run from one checkpoint."""

    def __init__(self, spark, path, make, schemas):
        self.spark, self.path, self.make, self.schemas = spark, str(path), make, schemas
        for name, schema in schemas.items():
            self.add(name, [], schema)

    def add(self, name, rows, schema=None):
        df = self.spark.createDataFrame(rows, schema or self.schemas[name])
        for column, kind in df.dtypes:
            if column.endswith("_at"):
                df = df.withColumn(column, F.timestamp_seconds(column))
        df.coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")
        self.read_as = getattr(self, "read_as", {}) | {name: df.schema}

    def run(self):
        streams = [self.spark.readStream.schema(self.read_as[n]).parquet(f"{self.path}/{n}") for n in self.schemas]
        writer = self.make(*streams).writeStream.format("parquet")
        query = writer.option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start(f"{self.path}/out")
        query.awaitTermination()
        return query

    def rows(self):
        return self.spark.read.parquet(f"{self.path}/out")


TIMED = {
    "builds": "build_key string, received_at bigint, status string",
    "results": "build_key string, result_at bigint",
}


def pending(key, minute):
    return (key, minute * MINUTE, "pending_tests")


def test_alerts_come_once_and_only_without_results(spark, tmp_path):
    files = Files(spark, tmp_path, stateful.pending_alerts, TIMED)
    files.add("builds", [pending("silent", 100), pending("silent", 100), pending("answered", 100), pending("early", 103)])
    files.add("builds", [("passed", 100 * MINUTE, "succeeded"), (None, 1, "pending_tests"), ("no time", None, "pending_tests")])
    files.add("results", [("answered", 105 * MINUTE), ("answered", 106 * MINUTE), ("early", 98 * MINUTE), ("orphan", 99 * MINUTE)])
    files.run()
    assert files.rows().count() == 0
    # The process is started anew from its checkpoint; the waits have not ended yet.
    files.add("builds", [pending("too late", 112)])
    files.add("results", [("silent", 111 * MINUTE)])
    files.run()
    assert files.rows().count() == 0
    files.add("builds", [("clock", 200 * MINUTE, "succeeded")])
    files.add("results", [("too late", 123 * MINUTE)])
    query = files.run()
    got = {(r.build_key, r.received_at.timestamp() / MINUTE, r.due_at.timestamp() / MINUTE) for r in files.rows().collect()}
    assert got == {("silent", 100, 110), ("too late", 112, 122)}
    assert files.rows().count() == 2
    # Everything is decided: no build, result or timer is held any more.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    files.add("builds", [pending("silent", 100), ("clock", 300 * MINUTE, "succeeded")])
    files.run()
    assert files.rows().count() == 2


def test_builds_that_wait_for_nothing_reach_no_state_but_move_the_watermark(spark, tmp_path):
    files = Files(spark, tmp_path, stateful.pending_alerts, TIMED)
    files.add("builds", [pending("silent", 100), ("clock", 200 * MINUTE, "succeeded")])
    query = files.run()
    assert [r.build_key for r in files.rows().collect()] == ["silent"]
    plan = query._jsq.explainInternal(False)
    assert "other" in plan[: plan.index("EventTimeWatermark")], plan


def test_builds_that_wait_share_a_state_and_a_timer(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "ALERT_SHARDS", 3)
    files = Files(spark, tmp_path, stateful.pending_alerts, TIMED)
    files.add("builds", [pending(f"b{i}", 100 + i) for i in range(60)])
    files.add("results", [(f"b{i}", (95 + i) * MINUTE) for i in range(0, 60, 4)] + [("ahead", 104 * MINUTE)])
    query = files.run()
    # A shard has at most builds, results ahead of theirs and a timer.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * 3
    silent = {f"b{i}" for i in range(60) if i % 4}

    def alerts_at(minute):
        files.add("builds", [("clock", minute * MINUTE, "succeeded")])
        files.run()
        return sorted(r.build_key for r in files.rows().collect())

    # The watermark is ten minutes behind the newest event, which came in minute 159; a
    # wait ends when it is reached.
    assert alerts_at(149) == sorted(silent & {f"b{i}" for i in range(40)})
    files.add("results", [("b58", 165 * MINUTE)])
    files.run()
    assert alerts_at(400) == sorted(silent - {"b58"})


@pytest.mark.parametrize("order", [0, 1])
def test_an_early_result_counts_whatever_comes_first(spark, tmp_path, order):
    files = Files(spark, tmp_path, stateful.pending_alerts, TIMED)
    steps = [
        lambda: files.add("results", [("near", 95 * MINUTE), ("far", 91 * MINUTE), ("far", 80 * MINUTE)]),
        lambda: files.add("builds", [pending("near", 100), pending("far", 102)]),
    ]
    for step in steps if order else reversed(steps):
        step()
        files.run()
    files.add("builds", [("clock", 300 * MINUTE, "succeeded")])
    files.run()
    assert [r.build_key for r in files.rows().collect()] == ["far"]


def test_builds_are_joined_with_results_in_time(spark, tmp_path):
    files = Files(spark, tmp_path, stateful.answered_builds, TIMED)
    files.add("builds", [pending("early", 100), pending("late", 100), pending("never", 100), pending("twice", 100)])
    files.add("results", [("early", 92 * MINUTE), ("twice", 101 * MINUTE), ("twice", 109 * MINUTE), ("orphan", 100 * MINUTE)])
    files.run()
    files.add("results", [("late", 108 * MINUTE), ("never", 111 * MINUTE)])
    query = files.run()
    held = sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])
    assert held > 0
    clock = 300 * MINUTE
    files.add("builds", [("clock", clock, "x")])
    files.add("results", [("clock", clock)])
    query = files.run()
    got = sorted((r.build_key, r.result_at and r.result_at.timestamp() / MINUTE) for r in files.rows().collect())
    assert got[1:] == [("early", 92), ("late", 108), ("never", None), ("twice", 101), ("twice", 109)]
    # Only the two rows that moved the clock are left.
    assert sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"]) == 2


def test_repeated_batches_are_delivered_once(spark, tmp_path):
    files = Files(spark, tmp_path, stateful.delivered_once, {"changes": CHANGES})
    first = [(None, f"b{i}", "stored", "r1", 0) for i in range(30)]
    files.add("changes", first)
    files.add("changes", [(None, "b1", "results", "r1", 0), (None, "b1", "stored", "r2", 0)])
    files.run()
    files.add("changes", [*first, (None, "noted", "stored", "r1", 0)])
    files.run()
    files.add("changes", [(None, f"c{i}", "stored", "r1", 1) for i in range(30)])
    files.add("changes", first)
    query = files.run()
    files.add("changes", [(None, "c1", "stored", "r1", 1), (None, "d", "stored", "r1", 2)])
    files.run()
    got = [(r.build_key, r.change, r.run) for r in files.rows().collect()]
    assert len(got) == len(set(got)) == 30 + 2 + 1 + 30 + 1
    # One state a shard, which holds the messages of its last batch.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * stateful.RUN_SHARDS
