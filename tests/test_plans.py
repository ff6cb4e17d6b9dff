"""What the physical plans must look like."""

import os

from pyspark.sql import functions as F

from kilnworks import runtime
from kilnworks.operators import activity, graph, history, regressions
from kilnworks.plans import activity_queries, store_queries
from kilnworks.plans.catalog import catalog
from kilnworks.plans.registry import Tables
from kilnworks.plans.views import table
from kilnworks.sources import reports

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_recent_builds_are_a_top_k_not_a_sort(spark):
    t = Tables(spark, SF)
    plan = plan_of(history.target_trend(t.builds, t.targets, 50, 10))
    assert plan.count("TakeOrderedAndProject") == 2
    assert "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_only_needed_columns_are_read(spark):
    plan = plan_of(history.projects(table(spark, SF, "v_builds")))
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert schemas and all("o_totalprice" not in line for line in schemas)


def test_caps_drop_rows_before_the_shuffle(spark):
    t = Tables(spark, SF)
    assert "WindowGroupLimit" in plan_of(history.detail_targets(t.targets, 100))


def test_day_window_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "builds")
    table(spark, SF, "v_builds").where(
        F.col("day") < F.lit("1995-03-01").cast("date")
    ).write.partitionBy("day").parquet(path)
    stored = spark.read.parquet(path)
    plan = plan_of(history.in_days(stored, 3, F.lit("1995-01-31").cast("date")))
    assert "PartitionFilters: [isnotnull(day" in plan


def test_baselines_do_not_window_whole_projects(spark):
    plan = plan_of(regressions.previous_builds(table(spark, SF, "v_builds")))
    assert "_chunk" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_queries_register_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)


def test_steps_of_a_long_build_all_have_a_number(spark):
    from kilnworks.operators import caps

    steps = spark.range(20_050).select(
        F.lit("b").alias("build_key"),
        F.when(F.col("id") % 3 > 0, (F.col("id") % 500).cast("double") / 7).alias("started_at"),
        F.col("id").alias("position"),
    )
    rows = sorted(caps.step_ordinals(steps).collect(), key=lambda r: r.ordinal)
    assert [r.ordinal for r in rows] == list(range(20_050))
    keys = [(r.started_at is None, r.started_at or 0, r.position) for r in rows]
    assert keys == sorted(keys)


def test_a_scope_leaves_no_files(spark):
    root = runtime.scratch_root(spark)
    pairs = spark.createDataFrame([("g", 1, 2), ("g", 2, 3)], "graph string, src int, dst int")
    before = set(os.listdir(root))
    with runtime.scratch_scope(spark):
        kept, _ = runtime.written(pairs, "scoped")
        assert graph.closure(kept).count() == 3
        assert set(os.listdir(root)) > before
    assert set(os.listdir(root)) == before


def test_attempts_of_reports_are_numbered_without_a_join(spark):
    rows = spark.createDataFrame([("r", "{}")], "report_id string, document string")
    assert "Join" not in plan_of(reports.flattened_reports(rows))


def test_texts_for_a_stream_are_stored_compressed(spark):
    class Ingest:
        store_documents = None

        def run(self, stream, *_, **__):
            self.stream = stream
            return self

        def awaitTermination(self):  # noqa: N802
            self.files = [f for path in runtime._made[-1:] for f in os.listdir(path)]

    ingest = Ingest()
    ingest.spark = spark
    store_queries._ingest_texts(ingest, spark.createDataFrame([("{}",)], "document string"), "texts")
    assert [f for f in ingest.files if f.startswith("part-") and f.endswith(".txt.gz")]


def test_sections_are_derived_where_their_items_lie(spark):
    t = Tables(spark, SF)
    activity_queries.Model(t)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with runtime.joined_in_place(spark):
        plan = plan_of(t.sections.repartition(n, "build_key"))
    # Roots and their preparation are dealt out by the key of their order, nothing else moves.
    assert "hashpartitioning(build_key" not in plan and plan.count("Exchange") == 2
    for query in ("activity_files", "replayed_steps", "activity_messages", "standard_detail_files"):
        plan = plan_of(catalog().queries[query](spark, SF))
        # Owners that one step reads are not stored, and found without moving sections.
        assert "default.owned_" not in plan and "Exchange hashpartitioning" not in plan


def test_documents_are_made_where_their_items_lie(spark):
    t = Tables(spark, SF)
    for make in (store_queries.quarter_documents, store_queries.full_documents):
        with runtime.joined_in_place(spark):
            plan = plan_of(make(t))
        # Rows are not dealt by day, nor lists once they are made.
        assert "hashpartitioning(day" not in plan and "Broadcast" not in plan
        t = Tables(spark, SF)


def test_sections_that_are_rejected_climb_where_their_items_lie(spark):
    rows = activity_queries.broken_sections(Tables(spark, SF))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with runtime.joined_in_place(spark):
        plan = plan_of(rows.repartition(n, "build_key"))
    assert "hashpartitioning(build_key" not in plan
    stored = runtime.written(rows, "sections")[0]
    for large in (10, 1_000_000):
        found = activity.climbed_by_build(rows, large)
        wanted = activity.climbed(stored)
        assert found.exceptAll(wanted).isEmpty() and wanted.exceptAll(found).isEmpty()
