"""Small text logs with known results."""

import random

import pytest
from pyspark.sql import functions as F

from kilnworks.operators import graph, logs
from kilnworks.sources import text_logs

SAMPLE = """+ Marlin https://example.org/marlin.git 3.4.1
+ Tidepool /opt/pkgs/Tidepool 0.9.2
+ Gull https://example.org/gull.git 2.0.0
xcodebuild test -project Tides.xcodeproj -scheme TidesNightly -testPlan Coast -destination 'platform=macOS,arch=arm64' -enableCodeCoverage YES
Xcode 15.4
/srv/agent/Dock.swift:7:11: warning: variable 'berth' was never used
note: Target dependency graph (2 targets)
Target 'TidesKit' in project 'Tides'
Target 'Tides' in project 'Tides'
    -> Explicit dependency on target 'TidesKit' in project 'Tides'
/srv/agent/Quay.swift:31:2: error: value of type 'Pier' has no member 'depth'
/srv/agent/Dock.swift:7:11: warning: variable 'berth' was never used
/srv/agent/Buoy.swift:88:20: warning: will never be executed
/srv/agent/Dock.swift:7:11: warning: variable 'berth' was never used
Test Suite 'CoastTests' started
Test Case '-[CoastTests testEbb]' started.
Test Case '-[CoastTests testEbb]' passed (0.041 seconds).
Test Case '-[CoastTests testFlood]' started.
Test Case '-[CoastTests testFlood]' passed (1.250 seconds).
Test Case '-[CoastTests testSurge]' started.
Fatal error: Unexpectedly found nil in a berth list
Restarting after unexpected exit, crash, or test timeout
Test Case '-[CoastTests testSurge]' failed (2.004 seconds).
Test Case '-[CoastTests testSlack]' started.
Test Case '-[CoastTests testSlack]' passed (0.300 seconds).
IDETestOperationsObserverDebug: 7.125 elapsed"""

MOORING = """Test Case '-[MooringTests testWinch]' started.
/srv/agent/MooringTests.swift:52: error: -[MooringTests testWinch] : XCTAssertEqual failed: rope is short
Test Case '-[MooringTests testWinch]' failed (0.070 seconds).
Test Case '-[MooringTests testKnot]' started.
/srv/agent/MooringTests.swift:90: error: -[MooringTests testKnot] : XCTAssertTrue failed - loose
Test Case '-[MooringTests testKnot]' failed (0.310 seconds).
Test Case '-[MooringTests testAnchor]' started.
/srv/agent/MooringTests.swift:52: error: -[MooringTests testAnchor] : XCTAssertEqual failed: rope is short
Test Case '-[MooringTests testAnchor]' failed (0.090 seconds)."""

CYCLE = """Target dependency graph (3 targets)
Target 'Ferry' in project 'Fleet'
    -> Explicit dependency on target 'Crane' in project 'Fleet'
Target 'Barge' in project 'Fleet'
    -> Explicit dependency on target 'Ferry'
Target 'Crane' in project 'Fleet'
    -> Explicit dependency on target 'Barge'"""

ORPHAN = """Explicit dependency on target 'X' in project 'P'
Explicit dependency on target 'Y': warning: not yet
Target 'A' in project 'P'
Explicit dependency on target 'A' in project 'P'
Explicit dependency on target 'B' in project 'P'"""

PLAIN = """hello
  Fatal error: early
Test Case '-[S a]' started.
Test 'swift one' failed (1.5 seconds)
5.5 elapsed
9.5 elapsed"""


def lines_of(spark, seed=None):
    rows = []
    for name, text in (
        ("sample", SAMPLE),
        ("mooring", MOORING),
        ("cycle", CYCLE),
        ("orphan", ORPHAN),
        ("plain", PLAIN),
    ):
        rows += [(name, i + 1, line) for i, line in enumerate(text.split("\n"))]
    if seed is not None:
        random.Random(seed).shuffle(rows)
    raw = spark.createDataFrame(rows, "log_id string, line_no bigint, line string")
    if seed is not None:
        raw = raw.repartition(seed)
    return text_logs.content_lines(raw)


def run(spark, seed=None):
    lines, events = logs.ingested(lines_of(spark, seed))
    unique = logs.deduplicated(logs.log_diagnostics(events))
    tests = logs.log_tests(events)
    crashes = logs.log_crashes(events)
    summary = logs.log_summary(lines, unique, logs.test_summary(events, tests, crashes))
    return {
        "summary": {r.log_id: r for r in summary.collect()},
        "tests": sorted(
            (r.log_id, r.line_no, r.suite, r.name, r.status, r.message or "")
            for r in tests.collect()
        ),
        "crashes": sorted((r.log_id, r.test or "", r.crash_type) for r in crashes.collect()),
        "clusters": sorted(
            (r.log_id, r.fingerprint, r.members)
            for r in logs.failure_clusters(tests).collect()
        ),
        "edges": sorted(
            (r.log_id, r.from_name, r.to_name, r.to_project)
            for r in logs.log_graph_edges(events).collect()
        ),
        "metadata": {
            (r.log_id, r.field): r.value for r in logs.log_metadata(lines).collect()
        },
        "packages": sorted(
            (r.name, r.version) for r in logs.log_packages(lines).collect()
        ),
        "timeline": sorted(
            (r.log_id, r.line_no, r.place, r.phase)
            for r in logs.timeline(lines, events).collect()
        ),
        "elapsed": {r.log_id: r.seconds for r in logs.first_elapsed(events).collect()},
    }


@pytest.fixture(scope="module")
def result(spark):
    return run(spark)


def test_sample_counts(result):
    row = result["summary"]["sample"]
    # "Fatal error:" is a diagnostic too: the bare form finds "error:" in it.
    assert (row.raw_warnings, row.unique_warnings, row.raw_errors) == (4, 2, 2)
    assert (row.total, row.passed, row.failed, row.crashed, row.restarted) == (4, 3, 1, 1, 1)
    assert row.status == "failed"
    assert result["elapsed"]["sample"] == 7.125
    assert result["packages"] == [
        ("Gull", "2.0.0"),
        ("Marlin", "3.4.1"),
        ("Tidepool", "0.9.2"),
    ]


def test_metadata_first_value_stays(result):
    meta = result["metadata"]
    assert meta["sample", "scheme"] == "TidesNightly"
    assert meta["sample", "test_plan"] == "Coast"
    assert meta["sample", "destination"] == "'platform=macOS,arch=arm64'"
    assert meta["sample", "xcode_version"] == "15.4"
    assert meta["sample", "code_coverage_enabled"] == "true"


def test_crash_belongs_to_the_started_test(result):
    assert ("sample", "CoastTests:testSurge", "unexpected_nil") in result["crashes"]
    # Without a started test, and claimed as a diagnostic by its "error:".
    assert ("plain", "", "fatal_error") in result["crashes"]


def test_failures_take_their_assertion_and_cluster(result):
    failed = [t for t in result["tests"] if t[0] == "mooring"]
    assert [t[4] for t in failed] == ["failed"] * 3
    assert all("XCTAssert" in t[5] for t in failed)
    assert sorted(c[2] for c in result["clusters"] if c[0] == "mooring") == [1, 2]


def test_dependency_lines_need_a_target(result):
    assert [e for e in result["edges"] if e[0] == "orphan"] == [("orphan", "A", "B", "P")]
    assert [e for e in result["edges"] if e[0] == "cycle"] == [
        ("cycle", "Barge", "Ferry", "Fleet"),
        ("cycle", "Crane", "Barge", "Fleet"),
        ("cycle", "Ferry", "Crane", "Fleet"),
    ]
    # The early dependency line with a warning is a diagnostic instead.
    assert result["summary"]["orphan"].raw_warnings == 1


def test_first_elapsed_stays(result):
    assert result["elapsed"]["plain"] == 5.5


def test_timeline_changes_only(result):
    phases = [t[3] for t in result["timeline"] if t[0] == "sample"]
    assert all(a != b for a, b in zip(phases, phases[1:]))
    # The log begins with its packages; the command line follows.
    assert phases[:2] == ["package_resolution", "build_metadata"]
    # "Fatal error:" went to the diagnostics, which mark a crash only in lower case.
    assert "crash" not in phases and "test_restart" in phases


def test_row_order_and_partitions_do_not_matter(spark, result):
    assert run(spark, seed=5) == result


def test_cycle_from_a_log(spark):
    _, events = logs.ingested(lines_of(spark))
    nodes = logs.log_graph_nodes(events).withColumnRenamed("log_id", "graph")
    edges = logs.log_graph_edges(events).withColumnRenamed("log_id", "graph")
    members = graph.cycle_members(graph.edge_set(nodes, edges)).collect()
    assert sorted((r.graph, r.member, r.cycle) for r in members) == [
        ("cycle", "Fleet::Barge", "Fleet::Barge"),
        ("cycle", "Fleet::Crane", "Fleet::Barge"),
        ("cycle", "Fleet::Ferry", "Fleet::Barge"),
    ]


def test_file_scan_numbers_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\n\n  two \r\nthree")
    (tmp_path / "empty.log").write_text("\n \n")
    (tmp_path / "b.xcresult").write_text("x")
    raw = text_logs.read_raw_lines(spark, str(tmp_path))
    rows = sorted(
        (r.log_id.rsplit("/", 1)[1], r.line_no, r.line)
        for r in text_logs.read_text_logs(spark, str(tmp_path)).collect()
    )
    assert rows == [("a.log", 1, "one"), ("a.log", 3, "two"), ("a.log", 4, "three")]
    bad = {
        r.log_id.rsplit("/", 1)[1]: r.reason for r in text_logs.unreadable_logs(raw).collect()
    }
    assert bad == {"empty.log": "no content", "b.xcresult": "result bundles are not text logs"}


def test_splits_of_one_file_are_numbered_through(spark, tmp_path):
    path = tmp_path / "long.log"
    path.write_text("\n".join(f"line {i}" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        raw = text_logs.read_raw_lines(spark, str(path))
        wrong = raw.where(F.concat(F.lit("line "), F.col("line_no").cast("string")) != F.col("line"))
        assert raw.count() == 5000 and wrong.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
