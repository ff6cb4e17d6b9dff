"""Ordered operators, percentiles, graphs and rankings against brute force."""

import collections
import itertools
import random
from collections import deque
from statistics import quantiles

import pytest
from pyspark.sql import functions as F

from kilnworks import runtime
from kilnworks.operators import activity, caps, graph, history, intel, regressions, retention
from kilnworks.operators import percentiles
from kilnworks.operators.ordered import carry_last, line_chunk, number_rows, top_per_key
from kilnworks.operators.percentiles import exact_percentiles
from kilnworks.plans.registry import Tables
from kilnworks.runtime import written

SF = "/root/testdata/sf0.001"


def skewed(seed=1, n=3000):
    """A third of all rows belong to one key."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(40)}"
        rows.append((key, i, rng.choice([None, None, f"v{i}"]), rng.randrange(50) / 4))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(
        skewed(), "key string, at bigint, value string, seconds double"
    ).repartition(7)


def test_carry_last_equals_a_sequential_loop(frame):
    for inclusive, chunk in itertools.product((False, True), (64, 10_000)):
        got = carry_last(
            frame, ["key"], ["at"], F.col("value"), "last", line_chunk("at", chunk), inclusive
        )
        state, want = {}, {}
        for key, at, value, _ in skewed():
            before = state.get(key)
            if value is not None:
                state[key] = value
            want[at] = state.get(key) if inclusive else before
        assert {r["at"]: r["last"] for r in got.collect()} == want


def test_number_rows_equals_a_sequential_count(frame):
    got = number_rows(frame, ["key"], [F.asc("at")], "n", line_chunk("at", 100))
    seen, want = {}, {}
    for key, at, _, _ in skewed():
        seen[key] = seen.get(key, 0) + 1
        want[at] = seen[key]
    assert {r["at"]: r["n"] for r in got.collect()} == want


def test_top_per_key_keeps_the_first_rows(frame):
    got = top_per_key(frame, ["key"], [F.desc("seconds"), F.asc("at")], 5, "place")
    want = set()
    for key, rows in itertools.groupby(sorted(skewed(), key=lambda r: r[0]), lambda r: r[0]):
        best = sorted(rows, key=lambda r: (-r[3], r[1]))[:5]
        want |= {(key, r[1], i + 1) for i, r in enumerate(best)}
    assert {(r["key"], r["at"], r["place"]) for r in got.collect()} == want


def interpolated(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


def test_exact_percentiles(spark, frame):
    got = exact_percentiles(frame, ["key"], "seconds", {"p50": 0.5, "p95": 0.95, "p0": 0.0})
    groups = {}
    for key, _, _, seconds in skewed():
        groups.setdefault(key, []).append(seconds)
    for row in got.collect():
        values = groups.pop(row["key"])
        assert row["n"] == len(values)
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p0", 0.0)):
            assert abs(row[name] - interpolated(values, p)) < 1e-9
    assert not groups
    small = spark.createDataFrame([(1, -2.5), (1, 10.0), (1, 1.0), (2, 7.0)], "k int, v double")
    rows = {r["k"]: r for r in exact_percentiles(small, ["k"], "v", {"p": 0.95}).collect()}
    assert abs(rows[1]["p"] - 9.1) < 1e-9 and rows[2]["p"] == 7.0
    assert quantiles([1.0, 2.0, 10.0], n=20, method="inclusive")[-1] == pytest.approx(9.2)


@pytest.mark.parametrize("most", [20_000, 3])
def test_percentiles_of_close_values_are_refined(spark, monkeypatch, most):
    monkeypatch.setattr(percentiles, "RANKED_VALUES", most)
    monkeypatch.setattr(percentiles, "PARTS", 8)
    rng = random.Random(6)
    rows = [("close", 50 + rng.randrange(2000) / 20_000, 1 + rng.randrange(3)) for _ in range(3000)]
    rows += [("far", rng.choice([1e300, -1e300, 5e-324, 0.0, rng.random()]), 1) for _ in range(200)]
    rows += [("ties", 7.5, 40), ("ties", 7.5, 2), ("none", None, 5)]
    df = spark.createDataFrame(rows, "key string, v double, times int").repartition(5)
    wanted = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for weight in (None, "times"):
        groups = {}
        for key, value, times in rows:
            if value is not None:
                groups.setdefault(key, []).extend([value] * (times if weight else 1))
        got = {r["key"]: r for r in exact_percentiles(df, ["key"], "v", wanted, weight).collect()}
        assert got.keys() == groups.keys()
        for key, values in groups.items():
            assert got[key]["n"] == len(values)
            for name, p in wanted.items():
                assert got[key][name] == pytest.approx(interpolated(values, p), rel=1e-12, abs=1e-300)


# Graphs


def reachable(edges, start):
    seen, queue = set(), deque([start])
    while queue:
        for a, b in edges:
            if a == queue[0] and b not in seen:
                seen.add(b)
                queue.append(b)
        queue.popleft()
    return seen


def graph_frames(spark, graphs):
    nodes, edges = [], []
    for name, links in graphs.items():
        names = sorted({n for link in links for n in link})
        nodes += [(name, n, "P") for n in names]
        edges += [(name, a, "P", b, "P") for a, b in links]
    return (
        spark.createDataFrame(nodes, "graph string, name string, project string"),
        spark.createDataFrame(
            edges,
            "graph string, from_name string, from_project string, to_name string, "
            "to_project string",
        ),
    )


def random_graphs():
    rng = random.Random(4)
    return {
        f"g{g}": [
            (f"n{rng.randrange(12):02d}", f"n{rng.randrange(12):02d}") for _ in range(6 + 2 * g)
        ]
        for g in range(16)
    }


@pytest.mark.parametrize("bound", [graph.PAIRS_BOUND, 0])
def test_closure_and_cycles_equal_a_search(spark, monkeypatch, bound):
    monkeypatch.setattr(graph, "PAIRS_BOUND", bound)
    graphs = random_graphs()
    nodes, edges = graph_frames(spark, graphs)
    pairs = graph.edge_set(nodes, edges)
    reach = graph.closure(pairs)
    got = {(r.graph, r.src.name, r.dst.name) for r in reach.collect()}
    want = set()
    for name, links in graphs.items():
        proper = [(a, b) for a, b in links if a != b]
        for start in {a for a, _ in proper}:
            want |= {(name, start, end) for end in reachable(proper, start)}
    assert got == want
    members = {(r.graph, r.member, r.cycle) for r in graph.cycle_members(pairs).collect()}
    expected = set()
    for name, a, b in want:
        if a != b and (name, b, a) in want:
            group = {x for n, s, x in want if n == name and s == a and (name, x, a) in want} | {a}
            expected.add((name, f"P::{a}", f"P::{min(group)}"))
    assert members == expected


def test_cycles_of_small_graphs_are_found_in_place_of_large_ones_by_node(spark):
    nodes, edges = graph_frames(spark, random_graphs())
    pairs = graph.edge_set(nodes, edges)
    small, large, both = (
        sorted(map(tuple, graph.cycle_members(pairs, large=n).collect())) for n in (1000, 0, 15)
    )
    assert small == large == both != []


def test_stored_tables_are_not_broadcast_for_their_small_files(spark, monkeypatch):
    nodes, edges = graph_frames(spark, random_graphs())
    pairs = runtime.written_by(graph.edge_set(nodes, edges), "pairs", "graph")
    plans, store = [], graph.Numbered.store

    def stored(self, df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(self, df, label)

    monkeypatch.setattr(graph.Numbered, "store", stored)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        for large in (1000, 0):
            graph.shortest_chains(nodes, pairs, large)
            graph.cycle_members(pairs, large)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) > 10 and not any("Broadcast" in plan for plan in plans)


def test_long_chain_and_ring(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS_BOUND", 100_000)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(63)]
    ring = [(f"r{i:04d}", f"r{(i + 1) % 2000:04d}") for i in range(2000)]
    nodes, edges = graph_frames(spark, {"chain": chain, "ring": ring})
    pairs = graph.edge_set(nodes, edges)
    members = graph.cycle_members(pairs).groupBy("graph", "cycle").count().collect()
    assert [(r["graph"], r["cycle"], r["count"]) for r in members] == [
        ("ring", "P::r0000", 2000)
    ]
    reach = graph.closure(pairs.where("graph = 'chain'"))
    assert reach.count() == 64 * 63 // 2


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Scan parquet")


def test_deep_chains_take_few_rounds_and_scans(spark):
    def deep(n):
        # Two ways down to a chain with a side step at every 700th node, and a loop aside.
        links = [("top", "n0000"), ("other", "m"), ("m", "n0000")]
        links += [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(n)]
        links += [(f"n{i:04d}", f"n{i + 3:04d}") for i in range(0, n - 3, 700)]
        links += [("x", "y"), ("y", "z"), ("z", "x"), ("z", "below")]
        nodes, edges = graph_frames(spark, {"deep": links})
        return links, graph.shortest_chains(nodes, graph.edge_set(nodes, edges))

    links, chains = deep(2000)
    assert scans(chains) == scans(deep(40)[1]) <= 4
    assert {r.target.name: [n.name for n in r.path] for r in chains.collect()} == {
        t: path for t in {n for link in links for n in link} if (path := nearest_chain_down(links, t))
    }


def nearest_chain_down(links, target, found={}):
    """All chains of a graph by one search from its roots, kept for the next call."""
    if found.get("links") is not links:
        below, into = collections.defaultdict(set), {b for _, b in links}
        for a, b in links:
            below[a].add(b)
        level = {n: (n,) for link in links for n in link if n not in into}
        paths = {}
        while level:
            paths |= level
            following = {}
            for node, path in level.items():
                for child in below[node] - set(paths):
                    following[child] = min(following.get(child, (*path, child)), (*path, child), key=lambda p: p[0])
            level = following
        found.clear()
        found.update(links=links, paths=paths)
    path = found["paths"].get(target)
    return list(path) if path and len(path) > 1 else None


def nearest_chain(links, target):
    """Level by level, keeping the smallest path read from the target."""
    proper = {(a, b) for a, b in links if a != b}
    above = {}
    for a, b in proper:
        above.setdefault(b, set()).add(a)
    seen, level = {target}, {target: (target,)}
    while level:
        following = {}
        for node, path in level.items():
            for parent in above.get(node, ()):
                if parent not in seen:
                    candidate = path + (parent,)
                    following[parent] = min(candidate, following.get(parent, candidate))
        seen |= set(following)
        found = sorted(n for n in following if n not in above)
        if found:
            return list(reversed(following[found[0]]))
        level = following
    return None


def test_shortest_chains(spark):
    graphs = random_graphs()
    graphs["nearest"] = [("X", "dest"), ("A", "X"), ("Y", "dest")]
    graphs["tie"] = [("Root", "M1"), ("Root", "M2"), ("M1", "Core"), ("M2", "Core")]
    nodes, edges = graph_frames(spark, graphs)
    pairs = graph.edge_set(nodes, edges)
    got = {
        (r.graph, r.target.name): [n.name for n in r.path]
        for r in graph.shortest_chains(nodes, pairs).collect()
    }
    want = {}
    for name, links in graphs.items():
        for target in {n for link in links for n in link}:
            path = nearest_chain(links, target)
            if path:
                want[name, target] = path
    assert got == want
    assert got["nearest", "dest"] == ["Y", "dest"]
    assert got["tie", "Core"] == ["Root", "M1", "Core"]


def test_same_name_in_two_projects(spark):
    nodes = spark.createDataFrame(
        [("g", "Core", "A"), ("g", "Core", "B"), ("g", "App", "A")],
        "graph string, name string, project string",
    )
    edges = spark.createDataFrame(
        [("g", "App", "A", "Core", "A"), ("g", "App", "A", "Gone", "A"), ("g", "App", "A", "App", "A")],
        "graph string, from_name string, from_project string, to_name string, to_project string",
    )
    pairs = graph.edge_set(nodes, edges)
    assert pairs.count() == 1
    assert [r.to_name for r in graph.dangling_edges(nodes, edges).collect()] == ["Gone"]
    assert [r.name for r in graph.self_dependencies(edges).collect()] == ["App"]
    answers = {
        r.name: (r.verdict, r.answer)
        for r in graph.why_built(nodes, pairs, graph.shortest_chains(nodes, pairs)).collect()
    }
    assert answers == {"App": ("root", None), "Core": ("ambiguous", "A, B")}


# History


def builds_frame(spark, rows):
    ddl = (
        "build_key string, project string, total_seconds double, received_at timestamp, "
        "category string, xcode_version string, platform string, architecture string, "
        "status string, day date"
    )
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    full = []
    for i, row in enumerate(rows):
        base = {
            "build_key": f"b{i}",
            "project": "App",
            "total_seconds": 10.0,
            "hours": i,
            "category": "clean",
            "xcode_version": "16",
            "platform": None,
            "architecture": "arm64",
            "status": "succeeded",
        } | row
        at = start + timedelta(hours=base.pop("hours"))
        full.append(
            (
                base["build_key"],
                base["project"],
                base["total_seconds"],
                at,
                base["category"],
                base["xcode_version"],
                base["platform"],
                base["architecture"],
                base["status"],
                at.date(),
            )
        )
    return spark.createDataFrame(full, ddl)


def targets_frame(spark, rows):
    return spark.createDataFrame(
        [(b, n, s, c) for b, n, s, c in rows],
        "build_key string, name string, seconds double, fetched_from_cache boolean",
    )


def test_history_floor_and_empty_scope(spark):
    three = history.duration_percentiles(builds_frame(spark, [{}] * 3), 50).first()
    six = history.duration_percentiles(builds_frame(spark, [{}] * 6), 50).first()
    none = history.duration_percentiles(builds_frame(spark, [{}] * 3), 50, "Other").first()
    assert (three.builds, three.enough_history) == (3, False)
    assert (six.builds, six.enough_history) == (6, True)
    assert (none.builds, none.p50, none.avg_seconds) == (0, None, None)


def test_window_includes_its_last_day(spark):
    builds = builds_frame(spark, [{"hours": 0}, {"hours": 24 * 7}])
    as_of = F.lit("2024-01-08").cast("date")
    assert history.in_days(builds, 7, as_of).count() == 2
    assert history.in_days(builds, 6, as_of).count() == 1


def test_two_window_regression(spark):
    seconds = [20.0, 20.0, 80.0, 80.0]
    builds = builds_frame(spark, [{"total_seconds": s} for s in seconds])
    days = builds.select("build_key", "day")
    rows = targets_frame(
        spark,
        [(f"b{i}", "Core", s / 2, False) for i, s in enumerate(seconds)]
        + [(f"b{i}", "Flat", 50.0, False) for i in range(4)],
    ).join(days, "build_key")
    found = regressions.target_regressions(builds, rows, 2, 10).collect()
    assert [(r.name, r.current_seconds, r.previous_seconds) for r in found] == [
        ("Core", 40.0, 10.0)
    ]


def test_baseline_rules(spark):
    builds = builds_frame(
        spark,
        [
            {"hours": 0},
            {"hours": 1},
            {"hours": 1, "build_key": "twin"},
            {"hours": 2, "xcode_version": None, "build_key": "moved"},
            {"hours": 3, "category": "incremental", "build_key": "other"},
        ],
    )
    pairs = {
        r.build_key: (r.baseline_build_key, r.category_changed, r.environment_changed)
        for r in regressions.baseline_comparisons(builds).collect()
    }
    # Builds of one instant share the baseline before them, the smaller key wins.
    assert pairs == {
        "b1": ("b0", False, False),
        "twin": ("b0", False, False),
        "moved": ("b1", False, True),
        "other": ("moved", True, True),
    }
    days = builds.select("build_key", "day")
    rows = targets_frame(
        spark,
        [
            ("b0", "ten", 10.0, False), ("b1", "ten", 12.0, False),
            ("b0", "tiny", 0.2, False), ("b1", "tiny", 0.4, False),
            ("b0", "big", 100.0, False), ("b1", "big", 100.6, False),
            ("b0", "edge", 5.0, False), ("b1", "edge", 5.5, False),
            ("b0", "flip", 5.0, True), ("b1", "flip", 9.0, False),
            ("moved", "ten", 20.0, False), ("other", "ten", 90.0, False),
        ],
    ).join(days, "build_key")
    found = {
        (r.build_key, r.name): r.confidence
        for r in regressions.baseline_regressions(builds, rows).collect()
    }
    assert found == {("b1", "ten"): "high", ("b1", "edge"): "high", ("moved", "ten"): "low"}


def test_retention_keeps_the_newest_build(spark):
    builds = builds_frame(
        spark,
        [
            {"hours": 0},
            {"hours": 1, "project": "Old", "build_key": "last-of-old"},
            {"hours": 30},
            {"hours": 24 * 100},
        ],
    )
    now = F.lit("2024-04-11 00:00:00").cast("timestamp")
    doomed = {r.build_key for r in retention.prunable_builds(builds, 30, now).collect()}
    assert doomed == {"b0", "b2"}
    days = [str(r.day) for r in retention.droppable_days(builds, 30, now).collect()]
    assert days == ["2024-01-02"]


def test_attempts_and_test_cap(spark):
    rows = [("b", "S", "t1", "failed", 1), ("b", "S", "t2", "passed", 2), ("b", "S", "t1", "passed", 3)]
    tests = spark.createDataFrame(
        rows, "build_key string, suite string, name string, status string, position bigint"
    )
    numbered = {
        (r.name, r.status): r.attempt for r in caps.attempt_numbers(tests).collect()
    }
    assert numbered == {("t1", "failed"): 1, ("t2", "passed"): 1, ("t1", "passed"): 2}
    kept = sorted((r.place, r.position) for r in caps.keep_tests(tests, limit=2).collect())
    assert kept == [(1, 1), (2, 3)]
    explicit = tests.withColumn("given", F.when(F.col("position") == 1, F.lit(7)))
    again = {r.position: r.attempt for r in caps.attempt_numbers(explicit, explicit="given").collect()}
    assert again == {1: 7, 2: 1, 3: 2}


# Intelligence


def intel_inputs(spark):
    changed = spark.createDataFrame(
        [("b", 0, "Sources/Core/Thing.swift"), ("b", 1, "README.md")],
        "build_key string, position bigint, path string",
    )
    files = spark.createDataFrame(
        [
            ("b", "/r/Sources/Core/Thing.swift", "swiftCompilation", "arm64", "Core", 9.0),
            ("b", "/r/Other/Thing.swift", "swiftCompilation", "arm64", "Other", 99.0),
        ],
        "build_key string, file string, step_type string, architecture string, "
        "target string, seconds double",
    )
    tests = spark.createDataFrame(
        [("b", "CoreTests", "t", "failed"), ("b", "Tests", "u", "failed")],
        "build_key string, suite string, name string, status string",
    )
    diagnostics = spark.createDataFrame(
        [], "build_key string, fingerprint string, file string, target string"
    )
    return changed, files, tests, diagnostics


@pytest.mark.parametrize(
    "confidence, caveat, suspended, expected",
    [
        ("high", None, False, 65),
        ("high", None, True, 40),
        ("high", "environment_shifted", False, 45),
        ("high", "environment_shifted", True, None),
    ],
)
def test_evidence_confidence(spark, confidence, caveat, suspended, expected):
    changed, files, tests, diagnostics = intel_inputs(spark)
    nodes, edges = graph_frames(spark, {"b": [("App", "Core")]})
    dependents = intel.named_dependents(graph.closure(graph.edge_set(nodes, edges)))
    matches = intel.file_matches(changed, files)
    found = {r.changed_file: (r.match_kind, r.owning_target) for r in matches.collect()}
    assert found == {
        "Sources/Core/Thing.swift": ("suffix", "Core"),
        "README.md": ("none", None),
    }
    regression = spark.createDataFrame(
        [("b", "target", "Core", confidence, [caveat] if caveat else [])],
        "build_key string, metric_kind string, name string, confidence string, "
        "caveats array<string>",
    )
    metadata = spark.createDataFrame(
        [("b", "build.was_suspended", "true" if suspended else "false")],
        "build_key string, key string, value string",
    )
    links = intel.evidence_links(
        matches,
        intel.impact_downstream(matches, dependents),
        regression,
        diagnostics,
        changed,
        tests,
    )
    # 25 for the suffix match, 25 for the regression, 15 for the suite; the bare
    # suite "Tests" matches nothing.
    rows = intel.evidence_chains(links, intel.counter_evidence(metadata, regression)).collect()
    kept = [(r.subject, r.confidence) for r in rows]
    assert kept == ([("Core", expected)] if expected else [])


def test_bottleneck_scores(spark):
    nodes, edges = graph_frames(spark, {"b": [("App", "Core"), ("Kit", "Core")]})
    pairs = graph.edge_set(nodes, edges)
    targets = spark.createDataFrame(
        [("b", "Core", 40.0), ("b", "Core", 2.0), ("b", "App", 0.5)],
        "build_key string, name string, seconds double",
    )
    dependents = intel.named_dependents(graph.closure(pairs))
    rows = intel.bottlenecks(targets, pairs, dependents, 5).collect()
    assert [(r.target, r.score, r.fan_in, r.blocked_downstream) for r in rows] == [
        ("Core", 126.0, 2, 2)
    ]


def test_change_relation(spark):
    builds = spark.createDataFrame([(k,) for k in "abcd"], "build_key string")
    changed = spark.createDataFrame(
        [("b", "x/A.swift"), ("c", "Package.swift"), ("d", "Package.resolved")],
        "build_key string, path string",
    )
    diagnostics = spark.createDataFrame(
        [("b", "/ci/x/A.swift")], "build_key string, file string"
    )
    failed = spark.createDataFrame([("d",)], "build_key string")
    none = spark.createDataFrame([], "build_key string")
    rows = {
        r.build_key: (r.likely_related, r.confidence, len(r.evidence))
        for r in intel.change_relation(builds, changed, diagnostics, failed, none).collect()
    }
    assert rows == {
        "a": ("no", 0, 1),
        "b": ("yes", 60, 1),
        "c": ("no", 20, 1),
        "d": ("uncertain", 30, 2),
    }


def test_of_symbols_of_one_place_the_least_is_named(spark):
    schema = "build_key string, file string, line int, column_number int, symbol string, milliseconds double, ord long"
    rows = [("b", "F.swift", 3, 1, symbol, 2.5, 7) for symbol in ("h", None, "f", "g")]
    for some in (rows, rows[::-1]):
        got = activity.swift_site_totals(spark.createDataFrame(some, schema).coalesce(1)).first()
        assert (got.symbol, got.occurrences, got.milliseconds) == ("f", 4, 10.0)


def test_sections_move_once_and_large_builds_climb_alone(spark):
    sections = Tables(spark, SF).sections
    rows, _ = written(sections.where("cast(build_key as long) < 40"), "sections")
    wanted = sorted(map(str, activity.owned(activity.walked(rows)).collect()))
    moved = []
    for large in (10**6, 12):
        got, stored = activity.owned_sections(rows, large)
        assert sorted(map(str, got.select(*activity.owned(activity.walked(rows)).columns).collect())) == wanted
        assert stored.count() == rows.count()
        by_build = got.groupBy("build_key").count()
        moved.append(by_build._jdf.queryExecution().executedPlan().toString().count("Exchange"))
    # Rows of a build lie together, so counting them moves none.
    assert wanted and moved[0] == 0
    assert rows.groupBy("build_key").count().where("count > 12").count() > 0


@pytest.mark.parametrize("large", [12, graph.LARGE_GRAPH])
def test_small_graphs_are_worked_on_in_place(spark, monkeypatch, large):
    plans = []

    def stored(df, label, key, placed=False):
        if placed:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return runtime.written_by(df, label, key, placed)

    monkeypatch.setattr(graph, "written_by", stored)
    graphs = random_graphs()
    nodes, edges = graph_frames(spark, graphs)
    pairs, _ = runtime.written(graph.edge_set(nodes, edges), "pairs")
    got = {(r.graph, r.src.name, r.dst.name) for r in graph.closure(pairs, large).collect()}
    proper = {name: [(a, b) for a, b in links if a != b] for name, links in graphs.items()}
    assert got == {
        (name, a, b) for name, links in proper.items() for a in {a for a, _ in links} for b in reachable(links, a)
    }
    chains = {
        (r.graph, r.target.name): [n.name for n in r.path]
        for r in graph.shortest_chains(nodes, pairs, large).collect()
    }
    targets = [(name, n) for name, links in graphs.items() for n in {n for link in links for n in link}]
    assert chains == {
        (name, n): path for name, n in targets if (path := nearest_chain(graphs[name], n))
    }
    assert plans and not any("Exchange hashpartitioning" in plan for plan in plans)
