"""Golden rows for the column expressions."""

from pyspark.sql import functions as F

from kilnworks.functions import activity as A
from kilnworks.functions import diagnostics as D
from kilnworks.functions import loglines as L
from kilnworks.functions import paths, redaction, tags
from kilnworks.functions import tests as X


def evaluate(spark, values, expression, ddl="value string"):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {ddl}")
    out = df.select("i", expression.alias("out")).orderBy("i").collect()
    return [r["out"] for r in out]


def col():
    return F.col("value")


def test_diagnostic_lines(spark):
    lines = [
        "/a/File.swift:12:5: warning: variable 'x' was never used",
        "ld: error: undefined symbol",
        "/a/b.m:1:2: fatal error: 'x.h' file not found",
        "note: only a note",
        "nothing here",
        "/a/File.swift:99999999999:5: error: far",
        "/a/F.swift:１２:5: warning: fullwidth",
    ]
    out = evaluate(spark, lines, D.parse(col()))
    assert [o and (o.severity, o.file, o.line, o.message) for o in out] == [
        ("warning", "/a/File.swift", 12, "variable 'x' was never used"),
        ("error", None, None, "undefined symbol"),
        ("fatal", "/a/b.m", 1, "'x.h' file not found"),
        ("note", None, None, "only a note"),
        None,
        ("error", "/a/File.swift", None, "far"),
        ("warning", "/a/F.swift", None, "fullwidth"),
    ]


def test_normalised_messages(spark):
    out = evaluate(
        spark,
        ["At 0xDEADBEEF  and\t0123456789abcdef0 in 12345", "Short 123 stays", "No Break"],
        D.normalize(col()),
    )
    assert out == ["at <id> and <id> in <id>", "short 123 stays", "no break"]


def test_categories_keep_their_order(spark):
    out = evaluate(
        spark,
        [
            "main actor-isolated property in a Sendable closure",
            "type does not conform to Sendable; is deprecated",
            "sending risks data races in Swift 6",
            "ld: undefined symbols",
            "XCTAssertEqual failed",
            "'old' was deprecated in iOS 9",
            "something else",
        ],
        D.classify(col()),
    )
    assert out == [
        "swift_actor_isolation",
        "swift_sendable",
        "swift_concurrency",
        "linker",
        "x_c_test",
        "deprecation",
        "unknown",
    ]


def test_test_results(spark):
    lines = [
        "Test Case '-[CoreTests testThing]' passed (0.123 seconds).",
        "Test case 'FlakyTests.testThing()' failed on 'Clone 1 of iPhone - App (1)' (0.004 seconds)",
        "Test 'adds two' passed (0.1 seconds)",
        "Test Case 'partial",
    ]
    registry = X.GrammarRegistry()
    out = evaluate(spark, lines, registry.parse_any(col()))
    assert [o and (o.suite, o.test, o.status, o.seconds, o.fingerprint) for o in out] == [
        ("CoreTests", "testThing", "passed", 0.123, None),
        ("FlakyTests", "testThing()", "failed", 0.004, "XCTEST:FlakyTests:testthing()"),
        ("SwiftTesting", "adds two", "passed", 0.1, None),
        None,
    ]


def test_registered_grammar_is_tried_first(spark):
    registry = X.GrammarRegistry()
    registry.register(
        X.Grammar(
            "tap",
            lambda line: F.when(
                F.startswith(line, F.lit("ok ")),
                F.struct(
                    F.lit("tap").alias("suite"),
                    F.substr(line, F.lit(4)).alias("test"),
                    F.lit("passed").alias("status"),
                    F.lit(None).cast("double").alias("seconds"),
                    F.lit(None).cast("string").alias("fingerprint"),
                ),
            ),
        ),
        first=True,
    )
    assert registry.names() == ["tap", "xctest", "swift-testing"]
    lines = ["ok one", "Test 'x' failed (1 second)", "no"]
    assert evaluate(spark, lines, registry.claimed_by(col())) == ["tap", "swift-testing", None]
    assert evaluate(spark, lines, registry.parse_any(col())["test"]) == ["one", "x", None]


def test_timing_package_and_timing_report_lines(spark):
    out = evaluate(
        spark,
        ["Compile (App) | 3.5 seconds", "link | 1 SECOND", "zero | 0 seconds", "x | y seconds"],
        L.timing(col()),
    )
    assert [o and (o.phase, o.target, o.seconds) for o in out] == [
        ("Compile", "App", 3.5),
        ("link", None, 1.0),
        None,
        None,
    ]
    out = evaluate(
        spark,
        [
            "Resolved package: swift-argument-parser",
            "+ Firebase https://github.com/firebase/sdk.git 12.17.0",
            "kit: https://x.org/kit @ 1.2",
            "plain words",
        ],
        L.package(col()),
    )
    assert [o and (o.name, o.source, o.version) for o in out] == [
        ("swift-argument-parser", None, None),
        ("Firebase", "https://github.com/firebase/sdk.git", "12.17.0"),
        ("kit", "https://x.org/kit", "1.2"),
        None,
    ]
    out = evaluate(
        spark,
        [
            "/p/F.swift:6:25: warning: expression took 3ms to type-check (limit: 1ms)",
            "/p/F.swift:85:18: warning: instance method 'resolve(error:)' took 4ms to type-check",
        ],
        L.swift_timing_line(col()),
    )
    assert [(o.kind, o.line, o.symbol, o.milliseconds) for o in out] == [
        ("type_check", 6, None, 3.0),
        ("function_body", 85, "resolve(error:)", 4.0),
    ]


def test_redaction(spark):
    out = evaluate(
        spark,
        [
            "Authorization: Bearer abc.def",
            "api_key=12345 and password: 'a b'",
            "tokenizer stays",
            "/Users/alice/Code and /home/bob",
        ],
        redaction.redact_text(col()),
    )
    assert out == [
        "<redacted>",
        "<redacted> and <redacted>",
        "tokenizer stays",
        "<home>/Code and <home>",
    ]
    pseudonym = evaluate(
        spark, ["by Abc@Example.com now", "none", None], redaction.redact_emails(col())
    )
    assert pseudonym == ["by user-b5ecf327a47bb782 now", "none", None]


def test_paths(spark):
    pairs = [
        ("/r/Sources/Core/Thing.swift", "Sources/Core/Thing.swift", True),
        ("a.swift", "xa.swift", False),
        ("Vendor/Thing.swift", "Thing.swift", True),
        ("a\\b.swift", "a/b.swift", True),
        ("", "a.swift", False),
    ]
    out = evaluate(
        spark,
        [(a, b) for a, b, _ in pairs],
        paths.same_file(F.col("a"), F.col("b")),
        "a string, b string",
    )
    assert out == [want for _, _, want in pairs]
    out = evaluate(
        spark,
        [
            "/x/A.swift:12: failed and b/B.swift:2",
            "in A.swift:0 here",
            "no location",
        ],
        paths.location_in(col()),
    )
    assert [o and (o.file, o.line) for o in out] == [("/x/A.swift", 12), ("A.swift", None), None]
    out = evaluate(
        spark,
        ["/dd/My-App-abc123/Logs/Build/x", "/dd/App-AB/Logs/x", "plain"],
        paths.project_of_log(col()),
    )
    assert out == ["My-App", "App-AB", "plain"]


def test_activity_columns(spark):
    rows = [
        ("CompileSwift normal arm64 /a/F.swift (in target 'My App' from project 'P')", "Compile"),
        ("", "Ld App (x86_64)"),
        ("PhaseScriptExecution Run", "Copy Foo.h (bridging)"),
    ]
    ddl = "signature string, title string"
    s, t = F.col("signature"), F.col("title")
    assert evaluate(spark, rows, A.step_type(s, t), ddl) == [
        "swiftCompilation",
        "linker",
        "scriptExecution",
    ]
    assert evaluate(spark, rows, A.step_architecture(s, t), ddl) == ["arm64", "x86_64", None]
    assert evaluate(spark, rows, A.step_target(s, t), ddl) == ["My App", None, None]
    assert evaluate(spark, rows, A.step_file(F.lit(None), s), ddl) == ["/a/F.swift", None, None]
    words = ["Build succeeded", "Cleanup failed.", "Build (Cancelled)", "unclear"]
    assert evaluate(spark, words, A.verdict(col())) == ["succeeded", "failed", "cancelled", None]


def test_partition_days(spark):
    today = F.lit("2020-02-02").cast("date")
    values = [0.0, 1.7e9, -1.0, float("nan"), float("inf"), None, 1e9 + 0.9]
    out = evaluate(spark, values, A.day_of(col(), today), "value double")
    assert [str(o) for o in out] == [
        "1970-01-01",
        "2023-11-14",
        "2020-02-02",
        "2020-02-02",
        "2020-02-02",
        "2020-02-02",
        "2001-09-09",
    ]


def test_tags(spark):
    out = evaluate(
        spark,
        ["team = core ", "novalue", "=x", "k=", "a b=c", "k" * 65 + "=v"],
        tags.parse_tag(col()),
    )
    assert out[0].key == "tag.team" and out[0].value == "core"
    assert [o.reason for o in out[1:]] == [
        "no equals sign",
        "empty key",
        "empty value",
        "key has other characters",
        "key too long",
    ]
    out = evaluate(
        spark,
        ['{"a":"1"}', "[1]", "{", '{"a":1}', '{"a b":"1"}'],
        tags.user_entries(col()),
    )
    assert out[0].entries == {"user.a": "1"} and out[0].reason is None
    assert [o.reason for o in out[1:]] == [
        "not an object",
        "not JSON",
        "value is not a string",
        "key has other characters",
    ]
