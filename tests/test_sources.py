"""Documents, store, reports, manifests, activity sections and streams."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from kilnworks import runtime
from kilnworks.operators import activity
from kilnworks.sources import documents, inventory, manifests, providers, reports
from kilnworks.sources.store import HistoryStore
from kilnworks.streaming.ingest import Ingest, document_stream, result_stream

DAY = 86400.0
START = 1_700_000_000.0


def document(key, **changes):
    body = {
        "wire_version": 2,
        "build_key": key,
        "project": "App",
        "category": "clean",
        "total_seconds": 10.0,
        "compiled_count": 1,
        "cache_hit_rate": None,
        "error_count": 0,
        "warning_count": 0,
        "status": "succeeded",
        "started_at": START,
        "attribution": "anonymous",
        "targets": [
            {"name": "Core", "seconds": 5.0, "category": "clean", "fetched_from_cache": False, "compiled_count": 1},
            {"name": "Core", "seconds": 1.0, "category": "clean", "fetched_from_cache": False, "compiled_count": 0},
        ],
        "phases": [{"name": "Prepare build", "seconds": 2.5}],
        "steps": [
            {"fingerprint": "f", "step_type": "codeSign", "title": "Sign AppTests.xctest", "seconds": 1.0,
             "fetched_from_cache": False, "executed": True}
        ],
        "tests": [
            {"suite": "S", "name": "t", "status": "failed", "seconds": 0.5, "message": "boom"},
            {"suite": "S", "name": "t", "status": "passed", "seconds": 0.4},
        ],
    }
    body.update(changes)
    return json.dumps(body)


def parsed(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "value string")
    return documents.parse_documents(rows, F.col("value"))


def test_documents_are_checked_and_shredded(spark):
    rows = parsed(
        spark,
        [
            document("good"),
            "{ nonsense",
            "",
            document("v1", wire_version=1),
            document(""),
            document("bad", category="huge"),
            document("typed", total_seconds="fast"),
            document("bare", **{k: [] for k in ("steps", "tests")}),
        ],
    )
    reasons = [r.reason for r in documents.rejected_documents(rows).collect()]
    assert sorted(reasons) == [
        "empty build key",
        "not a build document",
        "not a build document",
        "not a build document",
        "not a build document",
        "unsupported wire version",
    ]
    good = documents.accepted_documents(rows)
    children = documents.shred(good)
    targets = children["build_targets"].where("build_key = 'good'").collect()
    assert [(r.name, r.seconds, str(r.day)) for r in targets] == [("Core", 5.0, "2023-11-14")]
    tests = children["build_tests"].collect()
    assert sorted((r.attempt, r.status) for r in tests) == [(1, "failed"), (2, "passed")]
    assert children["build_files"].count() == 0


def ingest_documents(spark, root, texts):
    good = documents.accepted_documents(parsed(spark, texts))
    store = HistoryStore(spark, root)
    keys = store.insert(
        documents.build_rows(good, F.timestamp_seconds("started_at")), documents.shred(good)
    )
    return store, keys.count()


def test_exported_lists_are_whole(spark):
    """More rows than any cap of W-12 and W-13 come back from the document."""
    texts = ("build_key project category status machine_id build_user build_host "
             "xcode_version platform architecture").split()  # fmt: skip
    numbers = ["total_seconds", "cache_hit_rate", "started_at"]
    counts = ["compiled_count", "error_count", "warning_count"]
    builds = spark.range(1).select(
        F.lit("2024-03-01").cast("date").alias("day"),
        *(F.lit("a").alias(c) for c in texts),
        *(F.lit(2.0).alias(c) for c in numbers),
        *(F.lit(1).alias(c) for c in counts),
    )
    sizes = {"targets": 150, "phases": 80, "tests": 2100, "files": 700}
    keyed = {n: spark.range(k).select(
        F.lit("2024-03-01").cast("date").alias("day"), F.lit("a").alias("build_key"),
        F.format_string("n%05d", "id").alias("name"), F.col("id").cast("double").alias("seconds"),
        F.col("id").cast("int").alias("position"), F.lit("x").alias("category"),
        F.lit(False).alias("fetched_from_cache"), F.lit(1).alias("compiled_count"),
        F.lit("S").alias("suite"), F.lit("passed").alias("status"), F.lit("m").alias("message"),
        F.format_string("f%05d", "id").alias("file"), F.lit("t").alias("target"),
        F.lit("swift").alias("step_type"), F.lit("arm64").alias("architecture"),
        F.lit(1).alias("occurrences"),
    ) for n, k in sizes.items()}
    row = documents.export_documents(builds, **keyed).first()
    body = json.loads(row.document)
    assert {n: len(body[n]) for n in sizes} == sizes
    assert body["files"][0]["file"] == "f00699" and body["tests"][0]["name"] == "n00000"


def test_store_first_writer_attach_and_prune(spark, tmp_path):
    root = str(tmp_path / "h")
    texts = [
        document("a", tests=[]),
        document("b", started_at=START + DAY * 40),
        document("c", started_at=START + 60, project="Solo"),
    ]
    store, stored = ingest_documents(spark, root, texts)
    assert stored == 3
    _, again = ingest_documents(spark, root, [document("a", project="Changed"), texts[1]])
    assert again == 0
    assert {r.project for r in store.read("builds").collect()} == {"App", "Solo"}
    assert store.read("build_targets").count() == 3
    results = spark.createDataFrame(
        [("a", "S", "x", "failed", 1.0, None, 1), ("gone", "S", "x", "passed", 1.0, None, 1)],
        "build_key string, suite string, name string, status string, seconds double, "
        "message string, attempt int",
    )
    assert store.attach_tests(results) == 1
    assert store.attach_tests(results) == 0
    now = F.timestamp_seconds(F.lit(START + DAY * 41))
    preview = sorted(r.build_key for r in store.prune_preview(30, now).collect())
    assert preview == ["a"]
    assert store.prune(30, now) == 1
    assert sorted(r.build_key for r in store.read("builds").collect()) == ["b", "c"]
    assert sorted({r.build_key for r in store.read("build_tests").collect()}) == ["b", "c"]


def test_prune_drops_whole_days(spark, tmp_path):
    texts = [document("old"), document("new", started_at=START + DAY * 60)]
    store, _ = ingest_documents(spark, str(tmp_path / "h"), texts)
    store.prune(30, F.timestamp_seconds(F.lit(START + DAY * 61)))
    assert [str(r.day) for r in store.read("builds").select("day").collect()] == ["2024-01-13"]
    assert store.read("build_targets").select("build_key").distinct().count() == 1


def test_streams_quarantine_replay_and_late_results(spark, tmp_path):
    incoming, late = tmp_path / "in", tmp_path / "late"
    incoming.mkdir()
    late.mkdir()
    clean = {"tests": []}
    (incoming / "1.json").write_text(
        "\n".join([document("a", **clean), document("a", project="Twice", **clean), "{bad"])
        + "\n"
        + document("idle", targets=[], phases=[], steps=[], tests=[])
    )
    ingest = Ingest(spark, str(tmp_path / "h"))
    stream = document_stream(spark, str(incoming))

    def run(source, handler, name):
        ingest.run(source, handler, name, once=True).awaitTermination()

    run(stream, ingest.store_documents, "docs")
    assert [r.build_key for r in ingest.store.read("builds").collect()] == ["a"]
    verdict = ingest.verdicts().first()
    assert verdict.status == "pending_tests"
    rejected = spark.read.parquet(f"{ingest.root}/rejected")
    refused = spark.read.parquet(f"{ingest.root}/refused")
    assert (rejected.count(), refused.count()) == (1, 1)
    # A replay under a new checkpoint adds nothing.
    run(stream, ingest.store_documents, "docs-again")
    assert ingest.store.read("build_targets").count() == 1
    assert [(r.build_key, r.change) for r in ingest.changes().collect()] == [("a", "stored")]

    def result(key, status):
        return json.dumps(
            {"build_key": key, "suite": "S", "name": "t", "status": status, "seconds": 1.0, "attempt": 1}
        )

    (late / "1.json").write_text(result("a", "passed") + "\n" + result("b", "failed"))
    results = result_stream(spark, str(late))
    run(results, ingest.store_results, "results")
    assert ingest.verdicts().first().status == "succeeded"
    assert [r.build_key for r in ingest.waiting().collect()] == ["b"]
    # The build of the waiting result arrives; the next batch attaches it.
    (incoming / "2.json").write_text(document("b", started_at=START - DAY * 400, **clean))
    run(stream, ingest.store_documents, "docs")
    (late / "2.json").write_text(result("a", "passed"))
    run(results, ingest.store_results, "results")
    status = {r.build_key: r.status for r in ingest.verdicts().collect()}
    assert status == {"a": "succeeded", "b": "failed"}
    assert ingest.waiting().count() == 0
    days = {str(r.day) for r in ingest.store.read("builds").select("day").collect()}
    assert days == {"2023-11-14", "2022-10-10"}
    ingest.refresh_panel(
        "per_day", lambda b: b.groupBy("day").count(), ingest.store.read("builds")
    )
    assert spark.read.parquet(f"{ingest.root}/panels/per_day").count() == 2


def test_streams_keep_each_others_rows(spark, tmp_path):
    """Two sources, both at batch 0, with the same key on two days and bad input."""
    first, second = tmp_path / "one", tmp_path / "two"
    first.mkdir()
    second.mkdir()
    clean = {"tests": []}
    only_setup = {
        "targets": [], "steps": [], "tests": [], "compiled_count": 0,
        "phases": [{"name": "Prepare clean", "seconds": 9.0}],
    }
    (first / "1.json").write_text(
        "\n".join([document("a", **clean), "{bad1", document("setup", **only_setup)])
    )
    (second / "1.json").write_text(
        "\n".join(
            [
                document("a", started_at=START + DAY * 3, **clean),
                document("late", started_at=1e15, **clean),
                document("later", started_at=1e300, **clean),
                document("mixed", **{**only_setup, "compiled_count": 1}),
                "{bad2",
            ]
        )
    )
    ingest = Ingest(spark, str(tmp_path / "h"))
    for path in (first, second):
        stream = document_stream(spark, str(path))
        ingest.run(stream, ingest.store_documents, path.name, once=True).awaitTermination()
    messages = sorted((str(r.day), r.build_key) for r in ingest.changes().collect())
    assert messages == [("2023-11-14", "a"), ("2023-11-14", "mixed"), ("2023-11-17", "a")]
    assert len({r.run for r in ingest.changes().collect()}) == 2
    rejects = sorted((r.reason, r.value[:5]) for r in ingest.rejects().collect())
    assert [reason for reason, _ in rejects] == [
        "no usable measurements",
        "not a build document",
        "not a build document",
        "start time out of range",
        "start time out of range",
    ]
    assert {value for _, value in rejects if value.startswith("{bad")} == {"{bad1", "{bad2"}


def test_a_repeated_batch_announces_what_it_had_stored(spark, tmp_path):
    ingest = Ingest(spark, str(tmp_path / "h"))
    rows = spark.createDataFrame(
        [(document("a"), "s")], "value string, source string"
    ).withColumn("received_at", F.timestamp_seconds(F.lit(START)))
    announce, ingest._announce = ingest._announce, lambda *_: None
    ingest.store_documents(rows, 0, "r1")
    assert ingest.changes().count() == 0
    ingest._announce = announce
    for _ in range(2):
        ingest.store_documents(rows, 0, "r1")
        assert [(r.build_key, r.change) for r in ingest.changes().collect()] == [("a", "stored")]


def test_parked_results_outlive_their_run(spark, tmp_path):
    ingest = Ingest(spark, str(tmp_path / "h"))
    schema = ("build_key string, suite string, name string, status string, "
              "seconds double, message string, attempt int")  # fmt: skip

    def results(*keys):
        return spark.createDataFrame([(k, "S", "t", "passed", 1.0, None, 1) for k in keys], schema)

    broken = spark.createDataFrame([("c", None, "t", "passed", 1.0, None, None)], schema)
    ingest.store_results(results("c").unionByName(broken), 0, "r1")
    ingest.store_results(results("d"), 0, "r2")
    assert sorted(r.build_key for r in ingest.waiting().collect()) == ["c", "d"]
    assert spark.read.parquet(f"{ingest.root}/rejected_results").count() == 1
    rows = spark.createDataFrame(
        [(document("c", tests=[]), "s")], "value string, source string"
    ).withColumn("received_at", F.timestamp_seconds(F.lit(START)))
    ingest.store_documents(rows, 0, "docs")
    for batch in (0, 1):
        ingest.store_results(results(), batch, "r3")
        assert [r.build_key for r in ingest.waiting().collect()] == ["d"]
        assert ingest.store.read("build_tests").count() == 1
    changes = sorted((r.build_key, r.change) for r in ingest.changes().collect())
    assert changes == [("c", "results"), ("c", "stored")]


def test_backlog_is_skipped(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    (incoming / "1.json").write_text(document("a"))
    ingest = Ingest(spark, str(tmp_path / "h"))
    later = F.timestamp_seconds(F.lit(time.time() + 3600))
    stream = document_stream(spark, str(incoming), since=later)
    ingest.run(stream, ingest.store_documents, "docs", once=True).awaitTermination()
    assert ingest.store.read("builds").count() == 0


def node(kind, name="", children=(), **more):
    return {"nodeType": kind, "name": name, "children": list(children), **more}


def test_report_trees(spark):
    message = node("Failure Message", "F.swift:34: failed")
    tree = {
        "testNodes": [
            node(
                "Test Plan",
                children=[
                    node(
                        "Something New",
                        children=[
                            node(
                                "Test Suite",
                                "Flaky",
                                [
                                    node(
                                        "Test Case",
                                        "broken()",
                                        [
                                            node("Repetition", "Retry", [message], nodeIdentifier="2", result="Failed", durationInSeconds=0.2),
                                            node("Repetition", "First", [message], nodeIdentifier="1", result="Failed", durationInSeconds=0.1),
                                            node("Repetition", "Odd", nodeIdentifier="x", result="Passed"),
                                        ],
                                        result="Failed",
                                    ),
                                    node("Test Case", "stable()", result="Skipped", durationInSeconds=0.5),
                                    node("Test Case", "new()", result="Who knows"),
                                ],
                            )
                        ],
                    )
                ],
            )
        ]
    }
    rows = spark.createDataFrame(
        [("r", json.dumps(tree)), ("empty", "{}"), ("bad", "{")], "report_id string, document string"
    )
    runs = reports.flattened_reports(rows)
    got = sorted((r.suite, r.name, r.attempt, r.status, r.seconds, r.message) for r in runs.collect())
    assert got == sorted(
        [
            ("Flaky", "broken()", 1, "failed", 0.1, "F.swift:34: failed"),
            ("Flaky", "broken()", 2, "failed", 0.2, "F.swift:34: failed"),
            ("Flaky", "broken()", 3, "passed", None, None),
            ("Flaky", "stable()", 1, "passed", 0.5, None),
            ("Flaky", "new()", 1, "started", None, None),
        ],
        key=lambda r: r[:3],
    )
    summary = reports.report_summary(runs).first()
    assert (summary.total, summary.passed, summary.failed) == (5, 2, 2)
    assert [r.report_id for r in reports.malformed_reports(rows).collect()] == ["bad"]


def test_manifests(spark):
    def entry(uid, name, failures):
        return f"""<key>auxiliaryLogUniqueIdentifier</key>
			<string>{uid}</string>
			<key>auxiliaryObservable</key>
			<dict>
				<key>totalNumberOfTestFailures</key>
				<integer>0</integer>
			</dict>
			<key>domainType</key>
			<string>unit</string>
			<key>fileName</key>
			<string>{name}</string>
			<key>primaryObservable</key>
			<dict>
				<key>totalNumberOfTestFailures</key>
				<integer>{failures}</integer>
			</dict>"""

    text = "<dict>\n" + entry("A", "1.xcresult", 2) + "\n" + entry("B", "2.xcresult", 0)
    lines = spark.createDataFrame(
        [("m", i, line) for i, line in enumerate(text.split("\n"))],
        "manifest_id string, line_no bigint, line string",
    )
    entries = manifests.manifest_entries(lines.repartition(5))
    got = sorted((r.file_name, r.activity_log_id, r.test_failures, r.domain_type) for r in entries.collect())
    assert got == [("1.xcresult", "A", 2, "unit"), ("2.xcresult", "B", 0, "unit")]
    builds = spark.createDataFrame([("A", "2024-01-01")], "build_key string, day string")
    paired = manifests.paired_results(entries, builds).collect()
    assert [(r.build_key, r.file_name) for r in paired] == [("A", "1.xcresult")]


def test_log_inventory(spark, tmp_path):
    for name in (
        "App-abc1/Logs/Build/1.xcactivitylog",
        "App-abc1/Logs/Package/2.xcactivitylog",
        "App-abc1/Build/Intermediates.noindex/ArchiveIntermediates/App/Logs/Build/3.xcactivitylog",
        "Other-abc1/Logs/Build/4.xcactivitylog",
        "App-abc1/Logs/Build/notes.txt",
    ):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("x")
    logs = inventory.build_logs(inventory.list_files(spark, str(tmp_path)), "App")
    assert sorted(r.path.rsplit("/", 1)[1][0] for r in logs.collect()) == ["1", "3"]
    assert [r.project for r in inventory.newest_logs(logs).collect()] == ["App"]


def test_failing_provider_becomes_a_warning(spark):
    builds = spark.createDataFrame([("b", "me@example.com")], "build_key string, who string")
    entries, warnings = providers.run_providers(
        spark,
        [
            providers.Provider("git", lambda b: b.select("build_key", F.lit("git.author").alias("key"), F.col("who").alias("value"))),
            providers.Provider("broken", lambda b: b.select(F.raise_error(F.lit("no probe")).alias("build_key"), F.lit("k").alias("key"), F.lit("v").alias("value"))),
        ],
        builds,
    )
    rows = entries.collect()
    assert [r.key for r in rows] == ["git.author"] and rows[0].value.startswith("user-")
    assert [r.provider for r in warnings.collect()] == ["broken"]


def test_a_lost_executor_is_no_warning(spark):
    def collect(builds):
        raise RuntimeError("Job aborted: ExecutorLostFailure (executor 3 exited)")

    builds = spark.createDataFrame([("b",)], "build_key string")
    with pytest.raises(RuntimeError):
        providers.run_providers(spark, [providers.Provider("git", collect)], builds)


SECTION = (
    "build_key string, section_id string, parent_id string, ord bigint, title string, "
    "signature string, subtitle string, time_started double, time_stopped double, "
    "was_fetched_from_cache boolean, localized_result_string string, document_url string"
)


def section(build, ident, parent, order, title, signature="", start=None, stop=None, cached=False, subtitle="", result=""):
    return (build, ident, parent, order, title, signature, subtitle, start, stop, cached, result, None)


@pytest.fixture(scope="module")
def sections(spark):
    tag = "CompileSwift normal arm64 /a/{}.swift (in target '{}' from project 'P')"
    rows = [
        section("nested", "r", None, 0, "Build", start=100.0, stop=130.0, result="Build succeeded"),
        section("nested", "p", "r", 1, "Prepare", start=100.0, stop=101.0, subtitle="Scheme App | Destination iPhone"),
        section("nested", "w", "r", 2, "Build target Core", start=101.0, stop=120.0),
        section("nested", "s1", "w", 3, "Compile (arm64)", tag.format("A", "Core"), 102.0, 110.0),
        section("nested", "s2", "s1", 4, "Compile (x86_64)", tag.format("A", "Core"), 103.0, 109.0),
        section("nested", "s3", "w", 5, "Compile old", tag.format("B", "Core"), 50.0, 60.0),
        section("flat", "r", None, 0, "Build", start=200.0, stop=260.0, result="Cleanup failed."),
        section("flat", "a", "r", 1, "Compile", tag.format("A", "App"), 210.0, 220.0),
        section("flat", "b", "r", 2, "Compile", tag.format("B", "App"), 215.0, 230.0, True),
        section("flat", "g", "r", 3, "Group"),
        section("flat", "c", "g", 4, "Compile", tag.format("C", "Kit"), 199.5, 205.0, True),
        section("none", "r", None, 0, "Build", start=1.0, stop=2.0),
    ]
    return spark.createDataFrame(rows, SECTION)


def test_activity_sections(spark, sections):
    owned = activity.owned(activity.walked(sections))
    facts = activity.build_facts(sections)
    steps = activity.steps(owned, facts)
    ran = {(r.build_key, r.section_id): r.executed for r in steps.collect()}
    # A start half a second before the build is skew, one of 50 s a replay.
    assert ran == {
        ("nested", "s1"): True,
        ("nested", "s2"): True,
        ("nested", "s3"): False,
        ("flat", "a"): True,
        ("flat", "b"): True,
        ("flat", "c"): True,
    }
    targets = activity.target_results(steps, activity.target_spans(owned))
    got = {
        (r.build_key, r.name): (r.seconds, r.category, r.compiled_count, r.fetched_from_cache)
        for r in targets.collect()
    }
    assert got == {
        ("nested", "Core"): (19.0, "clean", 2, False),
        ("flat", "App"): (20.0, "incremental", 1, False),
        ("flat", "Kit"): (5.5, "noop", 0, True),
    }
    builds = {r.build_key: r for r in activity.build_results(facts, targets).collect()}
    assert builds["nested"].category == "clean" and builds["nested"].cache_status == "cold"
    assert builds["flat"].category == "incremental" and builds["flat"].cache_status == "partial"
    assert builds["none"].category == "unknown" and builds["none"].cache_hit_rate is None
    assert (builds["nested"].scheme, builds["nested"].platform) == ("App", "iPhone")
    assert (builds["nested"].status, builds["flat"].status) == ("succeeded", "failed")
    files = activity.files(steps).where("build_key = 'nested'").collect()
    assert sorted((r.file, r.architecture) for r in files) == [
        ("/a/A.swift", "arm64"),
        ("/a/A.swift", "x86_64"),
        ("/a/B.swift", "arm64"),
    ]
    notes = activity.architectures(activity.files(steps)).collect()
    assert [(r.build_key, r.names) for r in notes] == [("nested", "arm64, x86_64")]
    phases = sorted((r.build_key, r.name) for r in activity.phases(owned).collect())
    assert phases == [("flat", "Compile"), ("nested", "Prepare")]


def test_sections_climb_and_are_rejected(spark):
    rng = random.Random(3)
    rows, parents = [], {}
    for build in range(12):
        for i in range(60):
            key = (f"b{build}", f"s{i}")
            parents[key] = None if i == 0 else f"s{rng.randrange(i)}" if rng.random() < 0.85 else rng.choice(["gone", f"s{rng.randrange(60)}"])
    parents["b0", "s7"] = "s7"
    parents |= {("b1", "s3"): "s9", ("b1", "s9"): "s3", ("b2", "s4"): "s8", ("b2", "s8"): "s6", ("b2", "s6"): "s4"}
    for depth in range(300):
        parents["deep", f"d{depth}"] = f"d{depth - 1}" if depth else None
    titles = {}
    for n, (build, ident) in enumerate(parents):
        titles[build, ident] = f"Build target T{n}" if n % 9 == 5 else "Group"
        rows.append(section(build, ident, parents[build, ident], n, titles[build, ident]))
    want = {}
    for key in parents:
        way, at = [], key
        while at in parents and at not in way:
            way.append(at)
            at = (at[0], parents[at])
        reject = None if at[1] is None else "loop" if at in way else "orphan"
        top = [k for k in way if titles[k] != "Group"][-1:]
        want[key] = (reject, None if reject or not top else top[0][1])
    climb = activity.climbed(spark.createDataFrame(rows, SECTION).repartition(4))
    got = {(r.build_key, r.section_id): (r.reject, None if r.reject else r.wrapper_id) for r in climb.collect()}
    assert got == want
    assert {r for r, _ in want.values()} == {None, "orphan", "loop"}
    assert activity.rejected_sections(climb).count() == sum(r is not None for r, _ in want.values())


def test_documents_are_parsed_once_and_shredded_in_place(spark):
    """A filter on the reason used to parse each text again for every field it looks at,
    and items were moved to find the first of their key."""
    item = {"severity": "error", "category": "c", "occurrences": 1, "message": "m"}
    found = [{"fingerprint": k, "line": i, **item} for i, k in enumerate(["b", "a", "b", None, None])]
    compiled = [{"file": "f", "architecture": a, "seconds": s} for a, s in [(None, 1.0), ("", 2.0), ("arm64", 3.0)]]
    texts = [document("a", diagnostics=found, files=compiled)]
    rows = documents.shred(documents.accepted_documents(parsed(spark, texts)), distinct=True)
    first = rows["build_diagnostics"]
    assert sorted((r.fingerprint or "", r.line) for r in first.collect()) == [("", 3), ("a", 1), ("b", 0)]
    files = [(r.architecture, r.seconds) for r in rows["build_files"].collect()]
    assert sorted(files) == [("", 1.0), ("arm64", 3.0)]
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1 and "Exchange" not in plan
    twice = documents.shred(documents.accepted_documents(parsed(spark, texts * 2)))
    assert twice["build_diagnostics"].count() == 3


def test_only_documents_of_a_repeated_key_are_moved(spark, tmp_path):
    """All documents of a batch used to be moved, and stored once more, to find the first
    of each key."""
    texts = [document("a", project="late"), document("a", project="early"), document("b"), "{"]
    times = "array(timestamp'2024-03-02', timestamp'2024-03-01', timestamp'2024-03-01', timestamp'2024-03-01')"
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "value string, i int").select(
        "value", F.expr(f"{times}[i]").alias("received_at"), F.lit("s").alias("source")
    )
    begun = len(runtime._made)
    ingest = Ingest(spark, str(tmp_path / "h"))
    ingest.store_documents(rows, 0, "r")
    made = {p.rsplit("/", 1)[-1].split("-")[0]: p for p in runtime._made[begun:]}
    assert spark.read.parquet(made["documents"]).count() == 1
    parsed_texts = [r.value for r in spark.read.parquet(made["parsed"]).collect()]
    assert sorted(t for t in parsed_texts if t) == ["{"]
    builds = {(r.build_key, r.project) for r in ingest.store.read("builds").collect()}
    assert builds == {("a", "early"), ("b", "App")}
    assert ingest.store.read("build_targets").count() == 2
    assert [r.value for r in ingest.rejects().collect()] == ["{"]
