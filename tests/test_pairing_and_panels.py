"""Paired logs in every case of presence, refreshed panels, long manifests."""

import itertools
import json
import random

import pytest

from kilnworks.operators import ordered, pairing
from kilnworks.sources import manifests
from kilnworks.streaming.ingest import Ingest, document_stream
from kilnworks.streaming.panels import PercentilePanel


def test_every_case_of_presence(spark):
    flags = ["text", "activity", "text_read", "read", "text_timings", "timings", "text_diagnostics", "diagnostics"]
    cases = {f"b{n}": dict(zip(flags, c)) for n, c in enumerate(itertools.product([0, 1], repeat=8))}

    def rows(flag, schema, *values):
        found = [(key, *values) for key, case in cases.items() if case[flag]]
        return spark.createDataFrame(found, f"build_key string{schema}")

    text = pairing.Side(
        rows("text", ""), rows("text_read", ", m string", "t"), rows("text_timings", ", s string", "t"),
        rows("text_diagnostics", ", d string, extra int", "t", 1),
    )
    activity = pairing.Side(
        rows("activity", ""), rows("read", ", m string", "a"), rows("timings", ", s string", "a"),
        rows("diagnostics", ", d string", "a"),
    )
    result = pairing.paired(text, activity)
    got = {r.build_key: (r.metrics_from, r.timings_from, r.diagnostics_from) for r in pairing.pairing_summary(result).collect()}
    want = {}
    for key, c in cases.items():
        read = c["activity"] and c["read"]
        metrics = "activity" if read else "text" if c["text"] and c["text_read"] and not c["activity"] else None
        timings = "activity" if read and c["timings"] else "text" if metrics and c["text"] and c["text_timings"] else None
        diagnostics = "text" if c["text"] and c["text_diagnostics"] else "activity" if read and c["diagnostics"] else None
        if metrics or timings or diagnostics:
            want[key] = (metrics, timings, diagnostics)
    assert got == want
    for part, column in ((result.metrics, "m"), (result.timings, "s"), (result.diagnostics, "d")):
        assert all(row[column] == row.origin[0] for row in part.collect())


def test_a_panel_equals_its_rebuild_whatever_is_repeated(spark, tmp_path):
    rng = random.Random(2)
    texts = []
    for i in range(200):
        seconds = rng.choice([1.5, 2.0, rng.random() * 100])
        target = {"name": "T", "seconds": 1.0, "category": "clean", "fetched_from_cache": False, "compiled_count": 1}
        build = {"wire_version": 2, "build_key": f"b{i:03d}", "project": f"p{i % 3}", "category": "clean"}
        build |= {"total_seconds": seconds, "started_at": 86400.0 * (i % 4), "compiled_count": 1, "attribution": "identified"}
        build |= {"cache_hit_rate": None, "error_count": 0, "warning_count": 0, "status": "succeeded", "targets": [target]}
        texts.append(json.dumps(build | {k: [] for k in ("phases", "files", "swift_timings", "steps", "diagnostics", "tests")}))
    ingest = Ingest(spark, str(tmp_path / "history"))
    panel = PercentilePanel(ingest, "durations", "project", "total_seconds", {"p50": 0.5, "p95": 0.95})
    for name, part in (("first", texts[:150]), ("second", texts)):
        source = str(tmp_path / name)
        spark.createDataFrame([(t,) for t in part], "value string").write.text(source)
        ingest.run(document_stream(spark, source), panel.store_documents, name, once=True).awaitTermination()
        keyed = lambda frame: sorted(map(tuple, frame.select("day", "project", "n", "p50", "p95").collect()))
        assert keyed(panel.read()) == keyed(panel.rebuilt())
    last = ingest.changes().select("run", "batch").distinct().collect()
    for row in last:
        panel.refresh(row["batch"], row["run"])
    assert keyed(panel.read()) == keyed(panel.rebuilt())
    assert sum(r["n"] for r in panel.read().collect()) == 200


@pytest.mark.parametrize("size", [3, 7, 65_536])
def test_manifests_in_chunks_equal_one_pass(spark, monkeypatch, size):
    monkeypatch.setattr(manifests, "line_chunk", lambda: ordered.line_chunk(size=size))
    rng = random.Random(size)
    texts = {}
    for name in ("m", "n"):
        lines = []
        for i in range(150):
            key = rng.choice([manifests.BOUNDARY, "fileName", "domainType", "primaryObservable", "auxiliaryObservable", "totalNumberOfTestFailures", "other"])
            lines.append(f"  <key>{key}</key>")
            if "Observable" not in key and rng.random() < 0.9:
                lines.append(f"<integer>{i}</integer>" if "Failures" in key else f"<string>{key[0]}{i}</string>")
        texts[name] = lines
    rows = [(name, i, line) for name, lines in texts.items() for i, line in enumerate(lines)]
    got = manifests.manifest_entries(spark.createDataFrame(rows, "manifest_id string, line_no bigint, line string").repartition(4))
    want = []
    for name, lines in texts.items():
        entry, observable, key = {}, None, None
        for line in map(str.strip, lines):
            if line.startswith("<key>"):
                key = line[5:-6]
                observable = key if "Observable" in key else observable
                continue
            if key:
                value = line.split(">")[1].split("<")[0]
                if key == manifests.BOUNDARY and entry.get("stop") == "fileName":
                    want.append((name, entry))
                    entry = {}
                if key in (manifests.BOUNDARY, "fileName"):
                    entry["stop"] = key
                if key != "totalNumberOfTestFailures":
                    entry[key] = value
                elif observable == "primaryObservable":
                    entry[key] = int(value)
            key = None
        want.append((name, entry))
    named = [
        (name, e["fileName"], e.get(manifests.BOUNDARY), e.get("totalNumberOfTestFailures"), e.get("domainType"))
        for name, e in want
        if "fileName" in e
    ]
    columns = ["manifest_id", "file_name", "activity_log_id", "test_failures", "domain_type"]
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(named, key=str)
