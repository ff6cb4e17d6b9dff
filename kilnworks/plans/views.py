"""Stand-in views: the telemetry tables derived from the benchmark tables.

One SQL text defines each view for Spark and for the checking engine. The few
spellings that differ are written as ``@name(...)`` and rendered per engine.
All rows of the base tables take part; moduli only choose attribute values.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..runtime import configure, spread

# engine-specific spellings: epoch seconds as double, text split into lines
_SPELLINGS = {
    "spark": {
        "epoch": lambda x: f"cast(unix_micros(cast({x} as timestamp)) / 1000000.0 as double)",
        "at": lambda x: f"cast({x} as timestamp)",
        "numbered_lines": lambda _: (
            "(select doc_id, pos, line from documents "
            "lateral view posexplode(split(text, chr(10))) e as pos, line)"
        ),
    },
    "duckdb": {
        "epoch": lambda x: f"cast(epoch({x}) as double)",
        "at": lambda x: f"({x})",
        "numbered_lines": lambda _: (
            "(select doc_id, generate_subscripts(l, 1) - 1 as pos, unnest(l) as line "
            "from (select doc_id, string_split(text, chr(10)) as l from documents))"
        ),
    },
}

# name -> (views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}
BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Tables whose rows go through many text patterns.
TEXTS = ("documents",)


def _define(name: str, reads: str, sql: str) -> None:
    VIEWS[name] = (tuple(reads.split()), sql)


_define(
    "v_builds",
    "orders",
    """
    select cast(o_orderkey as string) as build_key,
           cast(o_orderdate as date) as day,
           o_orderpriority as project,
           case when o_orderkey % 4 = 0 then 'clean' when o_orderkey % 17 = 3 then 'noop'
                else 'incremental' end as category,
           o_totalprice / 1000 as total_seconds,
           cast(o_custkey % 200 as int) as compiled_count,
           case when o_custkey % 5 <> 0 then (o_custkey % 101) / 100 end as cache_hit_rate,
           case when o_orderkey % 7 <> 0
                then @epoch(o_orderdate) + (o_orderkey % 86400) + 0.5 * (o_orderkey % 2)
           end as started_at,
           case when o_custkey % 11 <> 0 then 'm' || cast(o_custkey % 50 as string) end
               as machine_id,
           case when o_custkey % 13 <> 0 then '16.' || cast(o_orderkey % 3 as string) end
               as xcode_version,
           case when o_custkey % 4 = 0 then 'macOS' when o_custkey % 4 <> 3 then 'iOS' end
               as platform,
           case when o_custkey % 9 = 0 then 'x86_64' else 'arm64' end as architecture,
           @at(o_orderdate + interval '1' second * (o_orderkey % 86400)) as received_at,
           cast(case when o_orderstatus = 'F' then 1 + o_custkey % 3 else 0 end as int)
               as error_count,
           cast(o_custkey % 9 as int) as warning_count,
           case when o_orderstatus = 'F' then 'failed' when o_orderstatus = 'O' then 'succeeded'
                else 'pending_tests' end as status,
           case when o_custkey % 6 <> 0 then 'Scheme' || cast(o_custkey % 12 as string) end
               as scheme,
           cast(o_custkey % 40 as int) as replayed_steps,
           case when o_custkey % 3 <> 0 then 'user' || cast(o_custkey % 70 as string) end
               as build_user,
           case when o_custkey % 3 = 1 then 'host' || cast(o_custkey % 90 as string) end
               as build_host
    from orders
    """,
)
_define(
    "v_items",
    "lineitem orders",
    """
    select cast(l_orderkey as string) as build_key, cast(o_orderdate as date) as day,
           @epoch(o_orderdate) + (o_orderkey % 86400) as order_epoch, lineitem.*
    from lineitem join orders on l_orderkey = o_orderkey
    """,
)
_define(
    "v_targets",
    "v_items",
    """
    select day, build_key, 'T' || cast(l_partkey % 100 as string) as name,
           max(l_quantity) as seconds,
           case when max(l_quantity) > 40 then 'clean' else 'incremental' end as category,
           bool_and(l_returnflag = 'R') as fetched_from_cache,
           cast(count(*) as int) as compiled_count
    from v_items group by day, build_key, l_partkey % 100
    """,
)
_define(
    "v_phases",
    "v_items",
    """
    select day, build_key, l_linestatus || l_returnflag as name, sum(l_quantity) / 4 as seconds
    from v_items group by day, build_key, l_linestatus, l_returnflag
    """,
)
_define(
    "v_files",
    "v_items",
    """
    select day, build_key,
           '/src/M' || cast(l_partkey % 20 as string) || '/F' || cast(l_partkey as string)
               || '.swift' as file,
           case when l_suppkey % 3 = 0 then 'arm64' when l_suppkey % 3 = 1 then 'x86_64'
                else '' end as architecture,
           max(l_extendedprice) / 10000 as seconds,
           'T' || cast(l_partkey % 100 as string) as target,
           case when l_partkey % 4 = 0 then 'cCompilation' else 'swiftCompilation' end
               as step_type,
           cast(count(*) as int) as occurrences
    from v_items group by day, build_key, l_partkey, l_suppkey % 3
    """,
)
_define(
    "v_swift",
    "v_items",
    """
    select day, build_key,
           case when (l_partkey + l_linenumber) % 3 = 0 then 'function_body'
                else 'type_check' end as kind,
           '/src/M' || cast(l_partkey % 20 as string) || '/F' || cast(l_partkey as string)
               || '.swift' as file,
           cast(l_linenumber * 40 as int) as line,
           cast(l_linenumber as int) as column_number,
           case when (l_partkey + l_linenumber) % 3 = 0
                then 'f' || cast(l_partkey as string) end as symbol,
           max(l_extendedprice) / 100 as milliseconds,
           'T' || cast(l_partkey % 100 as string) as target
    from v_items group by day, build_key, l_partkey, l_linenumber
    """,
)
_define(
    "v_diagnostics",
    "v_items",
    """
    select day, build_key,
           'unknown:' || (case when l_suppkey % 4 = 0 then 'error' when l_suppkey % 9 = 1
               then 'fatal' else 'warning' end) || ':/src/M'
               || cast(l_suppkey % 20 as string) || '/F' || cast(l_suppkey as string)
               || '.swift:message ' || cast(l_suppkey as string) as fingerprint,
           case when l_suppkey % 4 = 0 then 'error' when l_suppkey % 9 = 1 then 'fatal'
                else 'warning' end as severity,
           case when l_suppkey % 5 = 0 then 'deprecation' else 'unknown' end as category,
           cast(count(*) as int) as occurrences,
           'message ' || cast(l_suppkey as string) as message,
           '/src/M' || cast(l_suppkey % 20 as string) || '/F' || cast(l_suppkey as string)
               || '.swift' as file,
           cast(min(l_linenumber) as int) as line,
           case when l_suppkey % 3 <> 0 then 'T' || cast(l_suppkey % 100 as string) end
               as target
    from v_items group by day, build_key, l_suppkey
    """,
)
_define(
    "v_results",
    "events orders",
    """
    select cast(o_orderdate as date) as day, cast(o_orderkey as string) as build_key,
           'S' || cast(user_id % 2 as string) || 'Tests' as suite,
           't' || cast(user_id % 3 as string) as name,
           case when event_type = 'error' then 'failed' when event_type = 'signup'
                then 'started' else 'passed' end as status,
           value as seconds,
           case when event_type = 'error' and event_id % 3 <> 0 then props end as message,
           event_id as position
    from events join orders on o_orderkey = cast(floor(event_id / 8) as bigint) * 12
    """,
)
_define(
    "v_tests",
    "v_results",
    """
    select day, build_key, suite, name, status, seconds, message, position,
           cast(row_number() over (partition by build_key, suite, name order by position)
                as int) as attempt
    from v_results
    """,
)
_define(
    "v_metadata",
    "events orders",
    """
    select cast(o_orderdate as date) as day, cast(o_orderkey as string) as build_key,
           case when event_type = 'click' then 'git.branch'
                when event_type = 'view' then 'git.commit'
                when event_type = 'signup' then 'git.dirty'
                when event_type = 'purchase' then 'build.was_suspended'
                else 'ci.provider' end as key,
           max(case when event_type = 'purchase'
                    then (case when user_id % 2 = 0 then 'true' else 'false' end)
                    else props end) as value
    from events join orders on o_orderkey = cast(floor(event_id / 3) as bigint) * 4
    group by o_orderdate, o_orderkey, event_type
    """,
)
_define(
    "v_steps_raw",
    "v_items part",
    """
    select day, build_key,
           cast(l_linenumber as bigint) * 1000000000 + l_partkey * 10000 + l_suppkey as position,
           'T' || cast(l_partkey % 100 as string) as target,
           case when l_partkey % 50 = 0
                then 'Sign T' || cast(l_partkey % 100 as string) || 'Tests.xctest'
                when p_size % 7 = 0 then 'Run script ' || p_name
                else 'Compile ' || p_name || '.swift (arm64)' end as title,
           case when l_partkey % 50 = 0 then 'codeSign' when p_size % 7 = 0
                then 'scriptExecution' else 'swiftCompilation' end as step_type,
           case when l_partkey % 50 <> 0 then '/src/F' || cast(l_partkey as string) || '.swift'
           end as file,
           case when l_suppkey % 3 = 0 then 'arm64' when l_suppkey % 3 = 1 then 'x86_64' end
               as architecture,
           l_quantity as seconds,
           order_epoch as build_started,
           case when l_partkey % 29 <> 0
                then order_epoch + l_linenumber * 4 - 12 + l_suppkey % 4 * 0.5 end
               as started_at,
           l_returnflag = 'R' as fetched_from_cache
    from v_items join part on l_partkey = p_partkey
    """,
)
_define(
    "v_steps",
    "v_steps_raw",
    """
    select *, coalesce(started_at >= build_started - 1.0, true) as executed,
           started_at + seconds as ended_at
    from v_steps_raw
    """,
)
# Build graphs: eight neighbouring orders form one graph over 60 target names.
_define(
    "v_edges",
    "lineitem",
    """
    select distinct cast(cast(floor(l_orderkey / 8) as bigint) as string) as graph,
           'T' || cast((l_suppkey * 7 + l_linenumber) % 60 as string) as from_name,
           'P' || cast((l_suppkey * 7 + l_linenumber) % 2 as string) as from_project,
           'T' || cast(l_partkey % 60 as string) as to_name,
           'P' || cast(l_partkey % 2 as string) as to_project
    from lineitem
    """,
)
_define(
    "v_nodes",
    "v_edges",
    """
    select graph, from_name as name, from_project as project from v_edges
    union
    select graph, to_name as name, to_project as project from v_edges
    where to_name <> 'T7'
    """,
)

# Text logs: eight documents form one log; every document line becomes one log line,
# most of them in a shape a build log uses, with the document's own words inside.
_define(
    "v_log_source",
    "documents",
    """
    select cast(cast(floor(doc_id / 8) as bigint) as string) as log_id,
           (doc_id % 8) * 100000 + pos + 1 as line_no,
           (doc_id * 5 + pos) % 27 as shape, pos + doc_id % 13 as n, doc_id, line,
           chr(39) as q
    from @numbered_lines()
    """,
)
_define(
    "v_lines",
    "v_log_source",
    """
    select log_id, line_no, case
      when shape = 0 then 'xcodebuild -workspace App.xcworkspace -scheme S'
        || cast(doc_id % 5 as string) || ' -testPlan All -destination ' || q
        || 'platform=iOS Simulator,name=iPhone 15' || q || ' -enableCodeCoverage '
        || case when n % 2 = 0 then 'YES' else 'NO' end
      when shape = 1 then 'Xcode 16.' || cast(doc_id % 4 as string)
      when shape = 2 then '+ Pkg' || cast(n % 7 as string) || ' https://example.com/pkg'
        || cast(n % 7 as string) || '.git ' || cast(1 + n % 3 as string) || '.2.0'
      when shape = 3 then 'note: Target dependency graph (' || cast(3 + n % 5 as string)
        || ' targets)'
      when shape = 4 then 'Target ' || q || 'T' || cast(n % 9 as string) || q
        || ' in project ' || q || 'P' || cast(doc_id % 2 as string) || q
      when shape = 5 then '    -> Explicit dependency on target ' || q || 'T'
        || cast((n * 5 + 1) % 9 as string) || q
        || case when n % 2 = 0 then ' in project ' || q || 'P0' || q else '' end
      when shape = 6 then '/Users/ci/src/M' || cast(n % 4 as string) || '/F'
        || cast(n % 13 as string) || '.swift:' || cast(n + 1 as string) || ':'
        || cast(1 + n % 7 as string) || ': warning: ' || line
      when shape = 7 then '/Users/ci/src/F' || cast(n % 5 as string)
        || '.swift:9:2: warning: ' || q || 'oldAPI()' || q || ' is deprecated: use v'
        || cast(1000 + n % 3 as string)
      when shape = 8 then '/Users/ci/src/F' || cast(n % 5 as string)
        || '.swift:42:3: error: cannot find ' || q || 'V' || cast(n % 3 as string) || q
        || ' in scope 0x00ff' || cast(n as string)
      when shape = 9 then 'Test Case ' || q || '-[Suite' || cast(n % 3 as string) || ' test'
        || cast(n % 4 as string) || ']' || q || ' started.'
      when shape = 10 then '/Users/ci/T.swift:' || cast(n as string)
        || ': error: -[Suite test] : XCTAssertEqual failed: value '
        || cast(n % 3 as string) || ' is not equal'
      when shape = 11 then 'Test Case ' || q || '-[Suite' || cast(n % 3 as string) || ' test'
        || cast(n % 4 as string) || ']' || q || ' failed (0.' || cast(100 + n as string)
        || ' seconds).'
      when shape = 12 then 'Test Case ' || q || '-[Suite' || cast(n % 3 as string) || ' test'
        || cast(n % 4 as string) || ']' || q || ' passed (1.' || cast(100 + n as string)
        || ' seconds).'
      when shape = 13 then 'Test case ' || q || 'Flaky' || cast(n % 3 as string)
        || '.testThing()' || q || ' passed on ' || q || 'Clone 1 of iPhone' || q
        || ' (0.5 seconds)'
      when shape = 14 then 'Test ' || q || 'round trip ' || cast(n % 3 as string) || q
        || ' failed (2.5 seconds)'
      when shape = 15 then 'Fatal error: Unexpectedly found nil while unwrapping'
      when shape = 16 then 'Restarting after unexpected exit, crash, or test timeout'
      when shape = 17 then 'Compile Swift (T' || cast(n % 4 as string) || ') | '
        || cast(1 + n % 5 as string) || '.25 seconds'
      when shape = 18 then 'IDETestOperationsObserverDebug: ' || cast(n as string)
        || '.5 elapsed'
      when shape = 19 then '/Users/ci/src/F' || cast(n % 9 as string) || '.swift:'
        || cast(6 + n as string) || ':25: warning: expression took '
        || cast(100 + n * 7 as string) || 'ms to type-check (limit: 1ms)'
      when shape = 20 then '/Users/ci/src/F' || cast(n % 9 as string) || '.swift:'
        || cast(5 + n as string) || ':18: warning: instance method ' || q || 'resolve'
        || cast(n % 3 as string) || '(error:)' || q || ' took '
        || cast(100 + n * 9 as string) || 'ms to type-check (limit: 1ms)'
      when shape = 21 then 'SwiftCompile normal arm64 /src/F' || cast(n as string) || '.swift'
      when shape = 22 then 'Ld /tmp/App normal arm64'
      when shape = 23 then 'Resolved package: kit' || cast(n % 4 as string) || ': /src/kit @ 1.'
        || cast(n % 2 as string) || '.0'
      when shape = 24 then 'clang: error: linker command failed with exit code '
        || cast(n % 2 as string)
      when shape = 25 then '/Users/ci/src/C.swift:' || cast(n + 1 as string)
        || ':4: warning: sending value risks causing data races; this is an error in the '
        || 'Swift 6 language mode'
      else line end as line
    from v_log_source
    """,
)

# Units: eight neighbouring orders seen as one build with a change, files and a graph.
_define(
    "v_units",
    "lineitem",
    """
    select cast(cast(floor(l_orderkey / 8) as bigint) as string) as build_key,
           'M' || cast(l_partkey % 20 as string) || '/F' || cast(l_partkey as string)
               || '.swift' as short_path,
           'T' || cast(l_partkey % 60 as string) as part_target, lineitem.*
    from lineitem
    """,
)
_define(
    "v_unit_builds",
    "v_units",
    """
    select build_key, case when max(l_quantity) < 45 then 'noop' else 'incremental' end
        as category from v_units group by build_key
    """,
)
_define(
    "v_unit_files",
    "v_units",
    """
    select build_key, '/src/' || short_path as file, 'swiftCompilation' as step_type,
           case when l_suppkey % 2 = 0 then 'arm64' else 'x86_64' end as architecture,
           part_target as target, max(l_extendedprice) / 1000 as seconds
    from v_units group by build_key, short_path, l_suppkey % 2, part_target
    """,
)
_define(
    "v_unit_changes",
    "v_units",
    """
    select build_key, path, min(place) as position from (
      select build_key, l_partkey * 10 + l_suppkey % 4 as place,
             case when l_suppkey % 4 = 0 then '/src/' || short_path
                  when l_suppkey % 4 = 1 then short_path
                  when l_suppkey % 4 = 2 then 'F' || cast(l_partkey as string) || '.swift'
                  when l_partkey % 10 = 0 then 'App/Package.swift'
                  else 'docs/N' || cast(l_partkey as string) || '.md' end as path
      from v_units)
    group by build_key, path
    """,
)
_define(
    "v_unit_regressions",
    "v_units",
    """
    select build_key, 'target' as metric_kind, part_target as name,
           case when max(l_quantity) > 25 then 'high' when max(l_quantity) > 12 then 'medium'
                else 'low' end as confidence,
           case when max(l_discount) > 0.09 then 'environment_shifted' else 'none' end as caveat
    from v_units where l_returnflag = 'R' group by build_key, part_target
    """,
)
_define(
    "v_unit_tests",
    "v_units",
    """
    select build_key, part_target || 'Tests' as suite, 't' || cast(l_linenumber as string)
             as name,
           case when l_returnflag = 'A' then 'failed' else 'passed' end as status
    from v_units
    """,
)
_define(
    "v_unit_diagnostics",
    "v_units",
    """
    select build_key, 'd' || cast(l_partkey as string) || ':' || cast(l_suppkey as string)
             as fingerprint,
           case when l_linestatus = 'O' then '/src/' || short_path
                when l_returnflag = 'R' then 'build/G' || cast(l_partkey as string) || '.swift'
           end as file,
           cast(min(l_linenumber) as bigint) as line,
           case when l_suppkey % 3 = 0 then part_target end as target
    from v_units
    group by build_key, short_path, l_partkey, l_suppkey, l_linestatus, l_returnflag, part_target
    """,
)
_define(
    "v_unit_metadata",
    "events",
    """
    select cast(cast(floor(event_id / 6) as bigint) as string) as build_key,
           'build.was_suspended' as key,
           max(case when event_type = 'purchase' and user_id % 2 = 0 then 'true'
                    else 'false' end) as value
    from events group by floor(event_id / 6)
    """,
)
_define(
    "v_unit_targets",
    "v_units",
    """
    select build_key, part_target as name, l_suppkey % 2 as project,
           max(l_quantity) / 10 as seconds
    from v_units group by build_key, part_target, l_suppkey % 2
    """,
)
_define(
    "v_unit_swift",
    "v_units",
    """
    select build_key, case when l_suppkey % 3 = 0 then 'function_body' else 'type_check' end
             as kind,
           'F' || cast(l_partkey % 8 as string) || '.swift' as file,
           cast(l_quantity * 9 as int) as line, cast(l_linenumber as int) as column_number,
           case when l_suppkey % 3 = 0 then 'f' || cast(l_partkey as string) end as symbol,
           max(l_extendedprice) / 400 as milliseconds,
           case when l_partkey % 11 <> 0 then part_target end as target,
           max(l_orderkey * 1000 + l_suppkey % 1000) as ord
    from v_units
    group by build_key, l_suppkey % 3, l_partkey, l_quantity, l_linenumber, part_target
    """,
)
_define(
    "v_blame",
    "v_unit_diagnostics",
    """
    select 'src' || substr(file, 5) as file, line, 'author' || cast(line as string) as author,
           count(*) as commits
    from v_unit_diagnostics where file like '/src/%' and line <> 3 group by file, line
    """,
)
# Activity sections: a root per order, its preparation, target wrappers for most
# orders and flat tagged steps for the others, one step per line, some nested.
_define(
    "v_section_items",
    "v_items",
    """
    select build_key, l_orderkey % 5 = 0 as flat, l_suppkey % 3 as wrapper,
           cast(l_linenumber as bigint) * 10000000000 + l_partkey * 10000 + l_suppkey as ord,
           's' || cast(l_linenumber as string) || '-' || cast(l_partkey as string) || '-'
               || cast(l_suppkey as string) as step_id,
           order_epoch - 978307200 as root_start,
           order_epoch - 978307200 + l_linenumber * 4 - 9 + (l_suppkey % 4) * 0.5 as start_,
           l_quantity as seconds, l_partkey % 6 as shape, l_partkey, l_suppkey, l_linenumber,
           l_returnflag = 'R' as cached, chr(39) as q
    from v_items
    """,
)
_define(
    "v_sections",
    "v_section_items orders",
    """
    select cast(o_orderkey as string) as build_key, 'r' as section_id,
           cast(null as string) as parent_id, cast(0 as bigint) as ord, 'Build App' as title,
           '' as signature, '' as subtitle,
           @epoch(o_orderdate) + (o_orderkey % 86400) - 978307200 as time_started,
           @epoch(o_orderdate) + (o_orderkey % 86400) - 978307200 + o_totalprice / 1000
             as time_stopped,
           false as was_fetched_from_cache,
           case when o_orderstatus = 'F' then 'Cleanup failed.' when o_orderstatus = 'O'
                then 'Build succeeded' else 'Still running' end as localized_result_string,
           '' as document_url
    from orders
    union all
    select cast(o_orderkey as string), 'p', 'r', cast(1 as bigint),
           case when o_custkey % 8 = 0 then 'Prepare clean' else 'Prepare build' end, '',
           case when o_custkey % 3 = 0 then 'Scheme S' || cast(o_custkey % 9 as string)
                     || ' | Destination iPhone'
                when o_custkey % 3 = 1 then 'Workspace W | Scheme S1 | Destination Mac'
                else '' end,
           @epoch(o_orderdate) + (o_orderkey % 86400) - 978307200,
           @epoch(o_orderdate) + (o_orderkey % 86400) - 978307200 + o_custkey % 5,
           false, '', ''
    from orders
    union all
    select build_key, 'w' || cast(wrapper as string), 'r', (wrapper + 1) * 100,
           case when wrapper = 0 then 'Build target Core'
                else 'Lib' || cast(wrapper as string) || ' (project App)' end, '', '',
           min(start_), max(start_ + seconds), false, '', ''
    from v_section_items where not flat group by build_key, wrapper
    union all
    select build_key, step_id, case when flat then 'r' else 'w' || cast(wrapper as string) end,
           ord,
           case shape when 0 then 'Compile F.swift (arm64)' when 1 then 'Ld App (x86_64)'
             when 2 then 'Run custom script' when 3 then 'CodeSign App.xctest'
             when 4 then 'Copy Foo.h (bridging)' else 'CompileC m.o' end,
           case shape when 0 then 'CompileSwift normal arm64 /src/F'
                 || cast(l_partkey % 50 as string) || '.swift'
             when 1 then 'Ld /tmp/App normal x86_64' when 2 then 'PhaseScriptExecution run'
             when 3 then '' when 4 then 'Copy /src/Foo.h armv7'
             else 'CompileC normal i386 /src/C' || cast(l_partkey % 7 as string) || '.m' end
             || case when shape = 3 or l_partkey % 10 = 7 then ''
                  else ' (in target ' || q || 'Unit ' || cast(l_suppkey % 4 as string) || q
                    || ' from project ' || q || 'App' || q || ')' end,
           '', start_, case when l_partkey % 31 = 0 then null else start_ + seconds end, cached,
           '', case when l_partkey % 9 = 0
                 then 'file:///src/D' || cast(l_partkey % 40 as string) || '.swift' else '' end
    from v_section_items
    union all
    select build_key, 'n' || step_id, step_id, ord + 1, 'SwiftEmitModule',
           case when shape = 2 then 'SwiftEmitModule (in target ' || q || 'Nested' || q || ')'
                else 'SwiftEmitModule normal' end,
           '', start_, start_ + 0.5, not cached, '', ''
    from v_section_items where l_linenumber < 3
    """,
)
_define(
    "v_messages",
    "v_section_items",
    """
    select build_key, case when l_suppkey % 5 = 0 and not flat
                           then 'w' || cast(wrapper as string) else step_id end as section_id,
           ord as message_no,
           case when l_partkey % 2 = 0 then 'instance method ' || q || 'f'
                  || cast(l_partkey % 6 as string) || q || ' took '
                  || cast(l_partkey as string) || 'ms to type-check'
                when l_partkey % 3 = 0 then 'expression took ' || cast(l_partkey as string)
                  || 'ms to type-check'
                else 'value ' || cast(1000 + l_partkey as string) || ' is deprecated in 9' end
             as title,
           l_suppkey % 4 as severity,
           case when l_partkey % 7 <> 0
                then 'file:///src/D' || cast(l_partkey % 40 as string) || '.swift' end
             as document_url,
           case when l_partkey % 7 <> 0 then l_partkey % 300 end as line,
           case when l_partkey % 7 <> 0 then l_partkey % 40 end as column_number
    from v_section_items
    """,
)


def _render(sql: str, engine: str) -> str:
    spellings = _SPELLINGS[engine]

    def call(text: str) -> str:
        match = re.search(r"@(\w+)\(", text)
        if not match:
            return text
        depth, end = 1, match.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        inner = call(text[match.end() : end - 1])
        return text[: match.start()] + spellings[match.group(1)](inner) + call(text[end:])

    return call(sql)


def _needed(names, kept=()) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in BASE or name in kept or name in order:
            return
        for read in VIEWS[name][0]:
            visit(read)
        order.append(name)

    for name in names:
        visit(name)
    return order


def _bases(names, kept=()) -> set[str]:
    return {r for n in _needed(names, kept) for r in VIEWS[n][0] if r in BASE} | {
        n for n in names if n in BASE
    }


def with_views(names: str, body: str) -> str:
    """Checking-engine SQL: the views as common tables, then the body."""
    parts = [f"{n} as ({_render(VIEWS[n][1], 'duckdb')})" for n in _needed(names.split())]
    body = body.strip()
    if not parts:
        return body
    head = "with recursive " + ",\n".join(parts)
    if body.lower().startswith("with "):
        rest = body[5:]
        rest = rest[len("recursive ") :] if rest.lower().startswith("recursive ") else rest
        return f"{head},\n{rest}"
    return f"{head}\n{body}"


def table(
    spark: SparkSession, sf_dir: str, name: str, kept: dict[str, DataFrame] | None = None
) -> DataFrame:
    """A base table or a stand-in view as a DataFrame; ``kept`` views are read as stored."""
    configure(spark)
    kept = kept or {}
    for base in _bases([name], kept):
        rows = spark.read.parquet(f"{sf_dir}/{base}.parquet")
        (spread(rows) if base in TEXTS else rows).createOrReplaceTempView(base)
    for view, rows in kept.items():
        rows.createOrReplaceTempView(view)
    if name in BASE or name in kept:
        return spark.table(name)
    parts = [f"{n} as ({_render(VIEWS[n][1], 'spark')})" for n in _needed([name], kept)]
    head = f"with {', '.join(parts)} " if parts else ""
    return spark.sql(f"{head}select * from {name}")
