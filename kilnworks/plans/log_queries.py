"""Registered queries over text logs and over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import diagnostics as D
from ..functions import loglines as L
from ..functions import paths, redaction, tags
from ..functions import tests as X
from ..operators import logs
from ..runtime import scratch_path, written
from ..sources import text_logs
from .registry import Registry, Tables, longs, rounded
from .store_queries import collected_metadata


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def contains_any(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def part(column: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({column}, {quoted(pattern)}, {group}), '')"


def category_sql(message: str) -> str:
    cases = " ".join(
        f"when {contains_any(f'lower({message})', words)} then {quoted(name)}"
        for name, words in D.CATEGORY_RULES
    )
    return f"case {cases} else 'unknown' end"


def normalize_sql(message: str) -> str:
    masked = f"regexp_replace({message}, {quoted(D.VOLATILE)}, '<id>', 'g')"
    return f"lower(trim(regexp_replace({masked}, '\\s+', ' ', 'g')))"


LINES = """lines as (select log_id, line_no, trim(line, ' ' || chr(9) || chr(13)) as line
    from v_lines where trim(line, ' ' || chr(9) || chr(13)) <> '')"""

IS_DIAGNOSTIC = f"""({contains_any('line', ('warning:', 'error:', 'fatal error:'))}
    and (regexp_matches(line, {quoted(D.LOCATED)}) or regexp_matches(line, {quoted(D.BARE)})))"""
IS_ASSERTION = contains_any("lower(line)", ("xctassert", "assertion failed"))
CRASH_TYPE = """case when contains(lower(line), 'unexpectedly found nil') then 'unexpected_nil'
    when contains(lower(line), 'fatal error:') then 'fatal_error'
    when contains(lower(line), 'signal sig') or contains(lower(line), 'received signal')
      or contains(lower(line), 'exc_crash') then 'signal' end"""

ROUTED = f"""{LINES},
  graphed as (select *,
      case when regexp_matches(line, {quoted(L.DECLARED_TARGETS)}) then 'graph_declared'
        when starts_with(line, 'Target ''') and regexp_matches(line, {quoted(L.TARGET)})
          then 'graph_target'
        when regexp_matches(line, {quoted(L.DEPENDENCY)}) then 'graph_dependency' end as g
    from lines),
  opened as (select *, min(case when g = 'graph_target' then line_no end)
      over (partition by log_id) as opens from graphed),
  routed as (select log_id, line_no, line, case
      when g in ('graph_declared', 'graph_target') then g
      when g = 'graph_dependency' and opens < line_no then g
      when {IS_DIAGNOSTIC} then 'diagnostic'
      when {IS_ASSERTION} then 'assertion'
      when contains(line, 'Test Case') and contains(line, ' started')
        and regexp_matches(line, {quoted(X.STARTED)}) then 'started'
      when (contains(line, 'Test Case') or contains(line, 'Test case '''))
        and (contains(line, ' passed ') or contains(line, ' failed '))
        and (regexp_matches(line, {quoted(X.BRACKETED)})
          or regexp_matches(line, {quoted(X.DOTTED)})) then 'xctest'
      when (starts_with(line, 'Test ''') or starts_with(line, 'Test case '''))
        and regexp_matches(line, {quoted(X.SWIFT_TESTING)}) then 'swift_testing'
      when contains(line, 'Restarting after unexpected exit') then 'restart'
      when {contains_any('line', ('Fatal error:', 'Unexpectedly found nil', 'signal SIG',
                                  'EXC_CRASH'))} and {CRASH_TYPE} is not null then 'crash'
      when contains(line, 'elapsed') and regexp_matches(line, {quoted(X.ELAPSED)})
        then 'elapsed' end as kind
    from opened)"""

DIAGNOSTICS = f"""{ROUTED},
  located as (select *, regexp_matches(line, {quoted(D.LOCATED)}) as has_place
    from routed where kind = 'diagnostic'),
  parts as (select log_id, line_no,
      case when has_place then {part('line', D.LOCATED, 1)} end as file,
      case when has_place then try_cast({part('line', D.LOCATED, 2)} as bigint) end as line,
      case when has_place then try_cast({part('line', D.LOCATED, 3)} as bigint) end as "column",
      replace(case when has_place then {part('line', D.LOCATED, 4)}
        else {part('line', D.BARE, 1)} end, 'fatal error', 'fatal') as severity,
      case when has_place then regexp_extract(line, {quoted(D.LOCATED)}, 5)
        else trim(regexp_extract(line, {quoted(D.BARE)}, 2)) end as message
    from located),
  diagnostics as (select *, {category_sql('message')} as category,
      {category_sql('message')} || ':' || severity || ':' || coalesce(file, '') || ':'
        || {normalize_sql('message')} as fingerprint from parts),
  unique_ as (select log_id, fingerprint, severity, category, count(*) as occurrences,
      min_by(file, line_no) as file, min_by(line, line_no) as line,
      min_by(message, line_no) as message, min(line_no) as first_seen
    from diagnostics group by 1, 2, 3, 4)"""


def _form(pattern: str, group: int) -> str:
    return part("line", pattern, group)


TESTS = f"""{ROUTED},
  results as (select *,
      case when kind = 'swift_testing' then 'SwiftTesting'
        when kind = 'xctest' then trim(coalesce({_form(X.BRACKETED, 1)}, {_form(X.DOTTED, 1)}))
      end as suite,
      case when kind = 'swift_testing' then trim({_form(X.SWIFT_TESTING, 1)})
        when kind = 'xctest' then trim(coalesce({_form(X.BRACKETED, 2)}, {_form(X.DOTTED, 2)}))
      end as name,
      case when kind = 'swift_testing' then {_form(X.SWIFT_TESTING, 2)}
        when kind = 'xctest' then coalesce({_form(X.BRACKETED, 3)}, {_form(X.DOTTED, 3)})
      end as status,
      try_cast(case when kind = 'swift_testing' then {_form(X.SWIFT_TESTING, 3)}
        when kind = 'xctest' then coalesce({_form(X.BRACKETED, 4)}, {_form(X.DOTTED, 4)})
      end as double) as seconds,
      case when kind in ('assertion', 'diagnostic') and {IS_ASSERTION} then line end as note
    from routed),
  stated as (select *, case when note is not null then 'a' || note
      when kind = 'started' or (kind = 'xctest' and status = 'failed') then 'c' end as state
    from results),
  pended as (select *, last_value(state ignore nulls) over (partition by log_id
      order by line_no rows between unbounded preceding and 1 preceding) as before_
    from stated),
  messaged as (select *, case when kind = 'xctest' and status = 'failed'
      and starts_with(before_, 'a') then substr(before_, 2) end as message from pended),
  tests as (select log_id, line_no, kind = 'xctest' as xctest, suite, name, status, seconds,
      message, case when message is not null then 'XCTEST_ASSERT:' || {normalize_sql(
          "case when contains(message, ': XCTAssert') "
          "then substr(message, strpos(message, ': XCTAssert') + 11) else message end")}
        when status = 'failed' and kind = 'xctest'
          then 'XCTEST:' || suite || ':' || lower(name)
        when status = 'failed' then 'SWIFT_TEST:' || lower(name) end as fingerprint
    from messaged where status is not null),
  crashes as (select *, {CRASH_TYPE} as crash_type,
      last_value(case when kind = 'started' then {_form(X.STARTED, 1)} || ':'
        || trim({_form(X.STARTED, 2)}) end ignore nulls) over (partition by log_id
        order by line_no rows between unbounded preceding and 1 preceding) as test
    from routed qualify kind = 'crash' or (kind = 'diagnostic' and {CRASH_TYPE} is not null)),
  clusters as (select log_id, fingerprint, count(*) as members,
      coalesce(min_by(message, line_no), 'Test assertion failed') as message
    from tests where xctest and status = 'failed' group by 1, 2)"""

TIMING = f"""{LINES},
  swift as (select *, regexp_matches(line, {quoted(L.SWIFT_TIMING_LINE)}) as is_swift from lines),
  timed as (select log_id, line_no, is_swift, trim({part('line', L.TIMING, 1)}) as phase,
      nullif(trim({part('line', L.TIMING, 2)}), '') as target,
      try_cast({part('line', L.TIMING, 3)} as double) as seconds
    from swift where regexp_matches(line, {quoted(L.TIMING)})),
  timings as (select * from timed where seconds > 0 and phase <> '')"""

IS_METADATA = contains_any("line", L.METADATA_MARKERS)
METADATA = f"""{LINES},
  marked as (select * from lines where {IS_METADATA}),
  fields as (""" + " union all ".join(
    f"""select log_id, line_no, '{name}' as field, {'trim(' if name == 'platform' else 'trim('}
        {part('line', pattern, 1)}{')' if name == 'platform' else ", '" + chr(34) + "')"} as value
        from marked where regexp_matches(line, {quoted(pattern)})"""
    for name, pattern in L.METADATA_FIELDS
) + f"""),
  switches as (select log_id, line_no, case when contains(line, '{L.COVERAGE_OFF}') then 'false'
      else 'true' end as value from marked
    where contains(line, '{L.COVERAGE_ON}') or contains(line, '{L.COVERAGE_OFF}')),
  metadata as (select log_id, field, min_by(value, line_no) as value from fields group by 1, 2
    union all select log_id, 'code_coverage_enabled', max_by(value, line_no) from switches
      group by 1),
  hits as (select log_id, min(line_no) as line_no from fields group by log_id, field
    union select log_id, line_no from switches)"""


def _package(group: int) -> str:
    forms = (L.RESOLVED_PACKAGE, L.LISTED_PACKAGE, L.COLON_PACKAGE)
    cases = " ".join(
        f"when regexp_matches(line, {quoted(f)}) then {part('line', f, group)}" for f in forms
    )
    return f"case {cases} end"


LOOKS_PACKAGE = f"""(starts_with(line, 'Resolved package:') or starts_with(line, '+')
    or {contains_any('line', (': https://', ': /'))})"""
IS_PACKAGE = f"({LOOKS_PACKAGE} and {_package(1)} is not null)"
PACKAGES = f"""{LINES}, packages as (select log_id, line_no, {_package(1)} as name,
      {_package(2)} as source, {_package(3)} as version from lines where {IS_PACKAGE})"""

KEYWORD_PHASE = (
    "case "
    + " ".join(
        f"when {contains_any('line', words)} then '{name}'" for name, words in L.PHASE_RULES
    )
    + " end"
)

TIMELINE = METADATA + f""",
  {ROUTED[len(LINES) + 1 :]},
  marks as (
    select log_id, line_no, 0 as place, 'build_timing' as phase from lines
      where contains(line, 'Build Timing Summary') or (regexp_matches(line, {quoted(L.TIMING)})
        and try_cast({part('line', L.TIMING, 3)} as double) > 0)
    union all select log_id, line_no, 1, {KEYWORD_PHASE} from lines
      where {KEYWORD_PHASE} is not null
    union all select log_id, line_no, 2, 'build_metadata' from hits
    union all select log_id, line_no, 3, 'package_resolution' from lines where {IS_PACKAGE}
    union all select log_id, line_no, 4, case kind when 'restart' then 'test_restart'
        when 'crash' then 'crash' when 'diagnostic' then 'crash' else 'dependency_graph' end
      from routed where kind in ('graph_declared', 'graph_target', 'graph_dependency', 'restart',
        'crash') or (kind = 'diagnostic' and contains(line, 'fatal error:'))),
  ordered as (select *, lag(phase) over (partition by log_id order by line_no, place) as before_
    from marks)"""

EDGES = f"""{ROUTED},
  nodes as (select distinct log_id, {part('line', L.TARGET, 1)} as name,
      {part('line', L.TARGET, 2)} as project from routed where kind = 'graph_target'),
  held as (select *,
      last_value(case when kind = 'graph_target' then {part('line', L.TARGET, 1)} end
        ignore nulls) over w as from_name,
      last_value(case when kind = 'graph_target' then {part('line', L.TARGET, 2)} end
        ignore nulls) over w as from_project
    from routed where kind in ('graph_target', 'graph_dependency')
    window w as (partition by log_id order by line_no
      rows between unbounded preceding and 1 preceding)),
  ends as (select log_id, from_name, from_project, {part('line', L.DEPENDENCY, 1)} as to_name,
      coalesce({part('line', L.DEPENDENCY, 2)}, from_project) as to_project
    from held where kind = 'graph_dependency'),
  edges as (select distinct * from ends
    where not (from_name = to_name and from_project = to_project))"""

SUMMARY = f"""{TESTS},
  {DIAGNOSTICS[len(ROUTED) + 1 :]},
  counted as (select log_id,
      cast(coalesce(sum(occurrences) filter (where severity = 'warning'), 0) as bigint)
        as raw_warnings,
      cast(coalesce(sum(occurrences) filter (where severity in ('error', 'fatal')), 0) as bigint)
        as raw_errors,
      count(*) filter (where severity = 'warning') as unique_warnings,
      count(*) filter (where severity in ('error', 'fatal')) as unique_errors
    from unique_ group by log_id),
  tested as (select log_id, count(*) as total, count(*) filter (where status = 'passed')
      as passed, count(*) filter (where status = 'failed') as failed from tests group by 1),
  crashed as (select log_id, count(*) as crashed, count(*) filter (where kind = 'crash') as fatal
    from crashes group by 1),
  restarted as (select log_id, count(*) as restarted from routed where kind = 'restart'
    group by 1),
  summary as (select l.log_id, coalesce(raw_warnings, 0) as raw_warnings,
      coalesce(raw_errors, 0) as raw_errors, coalesce(unique_warnings, 0) as unique_warnings,
      coalesce(unique_errors, 0) as unique_errors, coalesce(total, 0) as total,
      coalesce(passed, 0) as passed, coalesce(failed, 0) as failed,
      coalesce(crashed, 0) as crashed, coalesce(fatal, 0) as fatal,
      coalesce(restarted, 0) as restarted
    from (select distinct log_id from lines) l
    left join counted using (log_id) left join tested using (log_id)
    left join crashed using (log_id) left join restarted using (log_id))"""


def lines_of(t: Tables):
    return written(text_logs.content_lines(t.lines), "log-lines")[0]


def ingest(t: Tables):
    return logs.ingested(text_logs.content_lines(t.lines))


def events_of(t: Tables):
    return ingest(t)[1]


def unique_of(t: Tables):
    return logs.deduplicated(logs.log_diagnostics(events_of(t)))


def summarised(lines, events):
    unique = logs.deduplicated(logs.log_diagnostics(events))
    tests = logs.test_summary(events, logs.log_tests(events), logs.log_crashes(events))
    return logs.log_summary(lines, unique, tests)


def summary_of(t: Tables):
    return summarised(*ingest(t))


def issue_of(t: Tables):
    lines, events = ingest(t)
    unique = logs.deduplicated(logs.log_diagnostics(events))
    return logs.primary_issue(
        lines,
        logs.failure_clusters(logs.log_tests(events)),
        logs.log_crashes(events),
        unique,
        logs.swift6_blockers(unique),
        logs.log_graph_edges(events),
    ).withColumn("next_steps", F.array_join("next_steps", "|"))


def scanned_files(t: Tables):
    """Lines as they are read from files, one a log, that the view's lines are written to."""
    path = scratch_path(t.spark, "text-logs")
    ordered = t.lines.repartition("log_id").sortWithinPartitions("log_id", "line_no")
    ordered.select("log_id", "line").write.partitionBy("log_id").text(path)
    name = F.regexp_extract("log_id", r"log_id=([^/]+)/", 1)
    return text_logs.read_text_logs(t.spark, path).withColumn("log_id", name).select(
        "log_id", "line_no", "line"
    )


def register(r: Registry) -> None:
    def add(name, run, prefix, sql):
        r.add(name, run, "v_lines", f"with {prefix} {sql}")

    add(
        "log_lines",
        lambda t: lines_of(t),
        LINES,
        "select log_id, line_no, line from lines",
    )
    numbered = "(select log_id, line, row_number() over (partition by log_id order by line_no) as line_no from v_lines)"
    add(
        "text_log_scan",
        scanned_files,
        LINES.replace("v_lines", numbered),
        "select log_id, line_no, line from lines",
    )
    add(
        "log_routing",
        lambda t: events_of(t).select("log_id", "line_no", "kind"),
        ROUTED,
        "select log_id, line_no, kind from routed",
    )
    add(
        "log_diagnostics",
        lambda t: logs.log_diagnostics(events_of(t)),
        DIAGNOSTICS,
        "select * from diagnostics",
    )
    add(
        "log_unique_diagnostics",
        lambda t: unique_of(t).drop("column"),
        DIAGNOSTICS,
        "select * from unique_",
    )
    add(
        "log_diagnostic_counts",
        lambda t: logs.diagnostic_counts(unique_of(t)),
        SUMMARY,
        "select * from counted",
    )
    blockers = "'swift_concurrency', 'swift_sendable', 'swift_actor_isolation'"
    add(
        "swift6_blockers",
        lambda t: logs.swift6_blockers(unique_of(t)),
        DIAGNOSTICS,
        f"""select log_id, category, count(*) as blockers from unique_
            where category in ({blockers}) group by 1, 2""",
    )
    add("log_tests", lambda t: logs.log_tests(events_of(t)), TESTS, "select * from tests")
    add(
        "log_crashes",
        lambda t: logs.log_crashes(events_of(t)),
        TESTS,
        """select log_id, line_no, test, crash_type, line as message, kind = 'crash'
           as fails_build from crashes""",
    )
    add(
        "failure_clusters",
        lambda t: logs.failure_clusters(logs.log_tests(events_of(t))).drop(
            "category", "first_line"
        ),
        TESTS,
        "select * from clusters",
    )
    add(
        "failure_cluster_members",
        lambda t: logs.cluster_members(logs.log_tests(events_of(t))),
        TESTS,
        """select log_id, fingerprint, line_no, suite || ':' || name as test from tests
           where xctest and status = 'failed'""",
    )
    add(
        "log_test_summary",
        lambda t: summary_of(t).select(
            "log_id", "total", "passed", "failed", "crashed", "restarted"
        ),
        SUMMARY,
        "select log_id, total, passed, failed, crashed, restarted from summary",
    )
    add(
        "log_summary",
        lambda t: summary_of(t),
        SUMMARY,
        """select *, case when raw_errors > 0 or failed > 0 or fatal > 0 then 'failed'
             else 'passed' end as status from summary""",
    )
    add(
        "slowest_log_tests",
        lambda t: longs(
            logs.slowest_tests(logs.log_tests(events_of(t)), C.SLOWEST_TESTS), "position"
        ).select("log_id", "position", "suite", "name", "seconds"),
        TESTS,
        """select log_id, position, suite, name, seconds from (select *, row_number() over (
             partition by log_id order by seconds desc nulls last, line_no) as position
             from tests) where position <= 20""",
    )
    for policy, rule in (
        ("errors", "raw_errors > 0"),
        ("warnings", "raw_warnings > 0"),
        ("failures", "failed > 0 or crashed > 0"),
        ("any", "raw_errors > 0 or failed > 0 or crashed > 0"),
    ):
        add(
            f"ci_gate_{policy}",
            lambda t, policy=policy: logs.gate_violations(summary_of(t), policy),
            SUMMARY,
            f"select log_id, '{policy}' as policy from summary where {rule}",
        )
    add(
        "phase_seconds",
        lambda t: rounded(logs.phase_seconds(logs.log_timings(lines_of(t))), "seconds"),
        TIMING,
        "select log_id, phase, round(sum(seconds), 4) as seconds from timings group by 1, 2",
    )
    add(
        "target_seconds",
        lambda t: rounded(logs.target_seconds(logs.log_timings(lines_of(t))), "seconds"),
        TIMING,
        """select log_id, target, round(sum(seconds), 4) as seconds from timings
           where target is not null group by 1, 2""",
    )
    add(
        "slowest_timing_targets",
        lambda t: longs(
            logs.slowest_timing_targets(logs.log_timings(lines_of(t)), C.SLOWEST_TIMING_TARGETS), "position"
        ),
        TIMING,
        """select log_id, target, seconds, position from (select *, row_number() over (
             partition by log_id order by seconds desc, target) as position from (
               select log_id, target, sum(seconds) as seconds from timings
               where target is not null group by 1, 2)) where position <= 10""",
    )
    add(
        "text_log_metrics",
        lambda t: rounded(logs.text_metrics(lines_of(t)), "total_seconds"),
        TIMING,
        """select l.log_id, round(sum(seconds), 4) as total_seconds,
             count(seconds) as phases, count(target) as targets
           from (select distinct log_id from lines) l left join timings t
             on t.log_id = l.log_id and not is_swift group by l.log_id""",
    )
    add(
        "log_swift_timings",
        lambda t: logs.log_swift_timings(lines_of(t)),
        TIMING,
        f"""select log_id, line_no, case when {part('line', L.SWIFT_TIMING_LINE, 5)} is null
               then 'type_check' else 'function_body' end as kind,
             {part('line', L.SWIFT_TIMING_LINE, 1)} as file,
             cast({part('line', L.SWIFT_TIMING_LINE, 2)} as bigint) as line,
             cast({part('line', L.SWIFT_TIMING_LINE, 3)} as bigint) as column_number,
             {part('line', L.SWIFT_TIMING_LINE, 5)} as symbol,
             cast({part('line', L.SWIFT_TIMING_LINE, 6)} as double) as milliseconds
           from swift where is_swift""",
    )
    add(
        "first_elapsed",
        lambda t: logs.first_elapsed(events_of(t)),
        ROUTED,
        f"""select log_id, min_by(cast({part('line', X.ELAPSED)} as double), line_no) as seconds
            from routed where kind = 'elapsed' group by log_id""",
    )
    add(
        "log_packages",
        lambda t: logs.log_packages(lines_of(t)),
        PACKAGES,
        """select log_id, name, version, source from packages qualify row_number() over (
             partition by log_id, name, version order by line_no) = 1""",
    )
    add("log_metadata", lambda t: logs.log_metadata(lines_of(t)), METADATA, "select * from metadata")
    add(
        "log_timeline",
        lambda t: longs(logs.timeline(*ingest(t)), "place"),
        TIMELINE,
        """select o.log_id, o.line_no, cast(place as bigint) as place, phase, line as message
           from ordered o join lines l on l.log_id = o.log_id and l.line_no = o.line_no
           where before_ is distinct from phase""",
    )
    add(
        "log_graph_nodes",
        lambda t: logs.log_graph_nodes(events_of(t)),
        EDGES,
        "select * from nodes",
    )
    add(
        "log_graph_edges",
        lambda t: logs.log_graph_edges(events_of(t)),
        EDGES,
        "select * from edges",
    )
    add(
        "declared_target_counts",
        lambda t: logs.declared_counts(events_of(t)),
        ROUTED,
        f"""select log_id, max_by(cast({part('line', L.DECLARED_TARGETS)} as bigint), line_no)
            as declared_count from routed where kind = 'graph_declared' group by log_id""",
    )
    add(
        "primary_issue",
        lambda t: issue_of(t),
        f"""{SUMMARY}, {EDGES[len(ROUTED) + 1 :]},
          c as (select log_id, min_by(message, fingerprint) as m from clusters group by 1),
          x as (select log_id, min_by(line, line_no) as m from crashes group by 1),
          e as (select log_id, min_by(message, fingerprint) as m from unique_
            where severity in ('error', 'fatal') group by 1),
          s as (select distinct log_id, true as b from unique_ where category in ({blockers})),
          h as (select distinct log_id, true as b from edges)""",
        """select s0.log_id, coalesce(c.m, x.m, e.m) as primary_issue, concat_ws('|',
             case when x.m is not null
               then 'Inspect the XCTest crash context and restart boundary.' end,
             case when s.b
               then 'Review Swift 6 concurrency blockers by category and target.' end,
             case when h.b
               then 'Review high fan-in targets as rebuild-impact candidates.' end)
             as next_steps
           from summary s0 left join c using (log_id) left join x using (log_id)
           left join e using (log_id) left join s using (log_id) left join h using (log_id)""",
    )
    _texts(r)


def _texts(r: Registry) -> None:
    """Redaction, locations and paths over whole texts."""
    bearer = f"regexp_replace(text, {quoted(redaction.BEARER)}, '<redacted>', 'g')"
    secret = f"regexp_replace({bearer}, {quoted(redaction.SECRET)}, '<redacted>', 'g')"
    scrubbed = f"regexp_replace({secret}, {quoted(redaction.HOME)}, '<home>', 'g')"
    r.add(
        "redacted_texts",
        lambda t: t.base("documents").select(
            "doc_id", redaction.redact_text(F.col("text")).alias("text")
        ),
        "documents",
        f"select doc_id, {scrubbed} as text from documents",
    )
    r.add(
        "redacted_paths",
        lambda t: t.lines.select(
            "log_id", "line_no", paths.redact_path(F.col("line"), "/Users/ci/").alias("path")
        ),
        "v_lines",
        f"""with folded as (select log_id, line_no, replace(line, '\\', '/') as p from v_lines)
            select log_id, line_no, case when starts_with(p, '/Users/ci')
              then '<repo>' || substr(p, 10)
              else regexp_replace(p, {quoted(redaction.HOME)}, '<home>', 'g') end as path
            from folded""",
    )
    fnv = """'user-' || lpad(lower(to_hex(cast(list_reduce(list_prepend(
        14695981039346656037::hugeint,
        list_transform(range(1, cast(length(a) as bigint) + 1),
          lambda i: cast(ascii(substr(lower(a), i, 1)) as hugeint))),
        lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint)
        as ubigint))), 16, '0')"""
    def woven(column: str, table: str, *kept: str) -> str:
        """Common tables whose last, ``woven``, has pseudonyms in place of addresses."""
        ids = ", ".join(kept)
        return f"""found as (select {ids}, {column} as text,
              regexp_extract_all({column}, {quoted(redaction.EMAIL)}) as e,
              string_split_regex({column}, {quoted(redaction.EMAIL)}) as pieces from {table}),
            names as (select *, list_transform(e, lambda a: {fnv}) as n from found),
            woven as (select {ids}, array_to_string(list_transform(range(1, len(pieces) + 1),
              lambda k: pieces[k] || coalesce(n[k], '')), '') as text from names)"""

    r.add(
        "pseudonymised_texts",
        lambda t: t.base("documents").select(
            "doc_id", redaction.redact_emails(F.col("text")).alias("text")
        ),
        "documents",
        f"with {woven('text', 'documents', 'doc_id')} select doc_id, text from woven",
    )
    r.add(
        "redacted_values",
        lambda t: t.base("conversations").select(
            "conv_id", "turn", redaction.redact_value(F.col("text")).alias("text")
        ),
        "conversations",
        f"""with {woven('text', 'conversations', 'conv_id', 'turn')}
            select conv_id, turn, {scrubbed} as text from woven""",
    )
    r.add(
        "pseudonymised_metadata",
        lambda t: collected_metadata(t)[0],
        "v_builds",
        f"""with said as (select build_key, build_user || '@example.com wrote this' as value
              from v_builds where build_user is not null),
            {woven('value', 'said', 'build_key')}
            select build_key, 'git.author' as key, text as value from woven
            union all select build_key, 'build.dir', '<home>/w <redacted>' from v_builds""",
    )
    r.add(
        "message_locations",
        lambda t: lines_of(t)
        .withColumn("_l", paths.location_in(F.col("line")))
        .where(F.col("_l").isNotNull())
        .select(
            "log_id",
            "line_no",
            F.col("_l.file").alias("file"),
            F.col("_l.line").alias("line"),
        ),
        "v_lines",
        f"""with {LINES}, located as (select *, strpos(line, '.swift:') as p from lines
              where contains(line, '.swift:'))
            select log_id, line_no, regexp_extract(substr(line, 1, p + 5), '(\\S*)$', 1) as file,
              case when cast({part('substr(line, p + 7)', '^([0-9]+)')} as bigint) > 0
                then cast({part('substr(line, p + 7)', '^([0-9]+)')} as bigint) end as line
            from located""",
    )
    r.add(
        "log_projects",
        lambda t: t.base("pages").select(
            "page_id",
            paths.project_of_log(
                F.regexp_replace(F.col("url"), "/(fr|en|de|zh|es)/", "/Logs/")
            ).alias("project"),
        ),
        "pages",
        f"""with d as (select page_id, regexp_extract(string_split(
              regexp_replace(url, '/(fr|en|de|zh|es)/', '/Logs/', 'g'), '/Logs/')[1],
              '([^/]*)$', 1) as dir from pages)
            select page_id, coalesce({part('dir', '^(.+)-[a-z0-9]{3,}$')}, dir) as project
            from d""",
    )
    argument = "event_type || case when user_id % 3 = 0 then '' else '=' end || case when "
    argument += "user_id % 5 = 0 then ' ' when user_id % 7 = 0 then ' a b ' else props end"
    r.add(
        "metadata_tags",
        lambda t: t.base("events")
        .select("event_id", tags.parse_tag(F.expr(argument)).alias("_t"))
        .select("event_id", "_t.*"),
        "events",
        f"""with a as (select event_id, {argument} as arg from events),
            s as (select event_id, arg, trim(substr(arg, 1, strpos(arg, '=') - 1)) as k,
              trim(substr(arg, strpos(arg, '=') + 1)) as v from a),
            v as (select *, case when not contains(arg, '=') then 'no equals sign'
              when k = '' then 'empty key' when v = '' then 'empty value'
              when strlen(k) > 64 then 'key too long' when strlen(v) > 256 then 'value too long'
              when not regexp_matches(k, '^[A-Za-z0-9_-]+$') then 'key has other characters'
              end as reason from s)
            select event_id, case when reason is null then 'tag.' || k end as key,
              case when reason is null then v end as value, reason from v""",
    )
    r.add(
        "user_metadata_entries",
        lambda t: t.base("events")
        .select("event_id", tags.user_entries(F.col("props")).alias("_u"))
        .select("event_id", "_u.reason", F.size("_u.entries").alias("entries")),
    )
    r.add(
        "user_text_entries",
        lambda t: t.base("events")
        .select(
            "event_id",
            tags.user_entries(
                F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("props").alias("p")))
            ).alias("_u"),
        )
        .select(
            "event_id",
            F.element_at("_u.entries", "user.kind").alias("kind"),
            F.element_at("_u.entries", "user.p").alias("p"),
        ),
        "events",
        "select event_id, event_type as kind, props as p from events",
    )
    registry = X.GrammarRegistry()
    r.add(
        "test_grammars",
        lambda t: lines_of(t)
        .select(
            "log_id",
            "line_no",
            registry.claimed_by(F.col("line")).alias("grammar"),
            registry.parse_any(F.col("line"))["status"].alias("status"),
        )
        .where(F.col("grammar").isNotNull()),
        "v_lines",
        f"""with {LINES}, m as (select *, regexp_matches(line, {quoted(X.BRACKETED)}) as b,
              regexp_matches(line, {quoted(X.DOTTED)}) as d,
              regexp_matches(line, {quoted(X.SWIFT_TESTING)}) as s from lines)
            select log_id, line_no, case when b or d then 'xctest' else 'swift-testing' end
              as grammar, case when b then {_form(X.BRACKETED, 3)}
                when d then {_form(X.DOTTED, 3)} else {_form(X.SWIFT_TESTING, 2)} end as status
            from m where b or d or s""",
    )
