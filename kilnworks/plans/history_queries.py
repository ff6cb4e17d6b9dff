"""Registered queries over the stored history."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import caps, history, regressions, retention, verdict
from ..sources import store
from .registry import Registry, day_text, longs, rounded

LAST = 2000
PAIR = 500
TOP = 20
PROJECT = "2-HIGH"
AS_OF = "1998-12-01"
DAYS = 400
KEEP_DAYS = 900
NOW = "2001-01-01 00:00:00"

RECENT = f"""recent as (select * from v_builds order by received_at desc, build_key
    limit {LAST})"""
RECENT_IN = f"""recent as (select * from v_builds where project = '{PROJECT}'
    order by received_at desc, build_key limit {LAST})"""
RECORDED = (
    "cast(round(coalesce(started_at, cast(epoch(received_at) as double))) as bigint)"
)


def as_of():
    return F.lit(AS_OF).cast("date")


def now():
    return F.lit(NOW).cast("timestamp")


def register(r: Registry) -> None:
    _scopes(r)
    _aggregates(r)
    _details(r)
    _comparisons(r)
    _retention(r)
    _numbering(r)


def _scopes(r: Registry) -> None:
    r.add(
        "builds_in_project",
        lambda t: history.in_project(t.builds, PROJECT).select("build_key", "project"),
        "v_builds",
        f"select build_key, project from v_builds where project = '{PROJECT}'",
    )
    r.add(
        "builds_in_day_window",
        lambda t: day_text(
            history.in_days(t.builds, DAYS, as_of()).select("build_key", "day")
        ),
        "v_builds",
        f"""select build_key, cast(day as varchar) as day from v_builds
            where day >= cast('{AS_OF}' as date) - {DAYS}""",
    )
    r.add(
        "build_lookup",
        lambda t: history.find_builds(t.builds, t.results).select(
            "build_key", "project", "status"
        ),
        "v_builds v_results",
        """select build_key, project, status from v_builds
           where build_key in (select build_key from v_results)""",
    )
    r.add(
        "build_search",
        lambda t: history.search_builds(t.builds, "SCHEME7", True).select(
            "build_key", "project", "scheme", "status"
        ),
        "v_builds",
        """select build_key, project, scheme, status from v_builds
           where contains(lower(coalesce(status, '')), 'fail')
             and contains(lower(build_key || ' ' || coalesce(project, '') || ' '
                 || coalesce(scheme, '') || ' ' || coalesce(status, '')), 'scheme7')""",
    )
    tier = "case when total_seconds < 150 then 'anonymous' when total_seconds < 300 then "
    tier += "'pseudonymous' else 'identified' end"
    r.add(
        "attribution_masking",
        lambda t: history.masked(t.builds, F.expr(tier)).select(
            "build_key", "machine_id", "build_user", "build_host"
        ),
        "v_builds",
        f"""select build_key,
              case when {tier} <> 'anonymous' then machine_id end as machine_id,
              case when {tier} = 'identified' then build_user end as build_user,
              case when {tier} = 'identified' then build_host end as build_host
            from v_builds""",
    )
    r.add(
        "duration_trend",
        lambda t: history.duration_trend(t.builds, LAST),
        "v_builds",
        f"""with {RECENT} select build_key, {RECORDED} as recorded_at, project, category,
              total_seconds, cache_hit_rate from recent""",
    )
    r.add(
        "build_list",
        lambda t: longs(
            history.build_list(t.builds, t.tests, LAST),
            "total_tests",
            "failed_tests",
        ),
        "v_builds v_tests",
        f"""with {RECENT}, final as (
              select build_key, suite, name, max_by(status, attempt) as s
              from v_tests group by build_key, suite, name),
            counts as (select build_key, count(*) as total,
              count(*) filter (where s = 'failed') as failed from final group by build_key)
            select b.build_key, {RECORDED} as recorded_at, project, category, total_seconds,
              cache_hit_rate, status, error_count, warning_count, scheme,
              coalesce(total, 0) as total_tests, coalesce(failed, 0) as failed_tests
            from recent b left join counts c on c.build_key = b.build_key""",
    )
    r.add(
        "fleet_build_list",
        lambda t: day_text(history.fleet_build_list(t.builds, LAST)),
        "v_builds",
        f"""with {RECENT} select build_key, cast(day as varchar) as day, project, category,
              total_seconds, cache_hit_rate, machine_id, xcode_version, platform, architecture,
              coalesce(started_at, cast(epoch(received_at) as double)) as recorded_at,
              error_count, warning_count, status from recent""",
    )


def _percentiles(value="total_seconds"):
    return f"""round(percentile_cont(0.5) within group (order by {value}), 8) as p50,
        round(percentile_cont(0.95) within group (order by {value}), 8) as p95"""


def _aggregates(r: Registry) -> None:
    r.add(
        "projects",
        lambda t: history.projects(t.builds),
        "v_builds",
        "select project, count(*) as builds from v_builds group by project",
    )
    r.add(
        "project_day_stats",
        lambda t: day_text(
            rounded(history.project_day_stats(t.builds, DAYS, as_of()), "p50", "p95", digits=8)
        ),
        "v_builds",
        f"""select project, cast(day as varchar) as day, count(*) as builds,
              count(distinct machine_id) as machines, {_percentiles()}
            from v_builds where day >= cast('{AS_OF}' as date) - {DAYS}
            group by project, day""",
    )
    summary = f"""count(*) as builds, {_percentiles()},
        min(total_seconds) as min_seconds, max(total_seconds) as max_seconds,
        round(avg(total_seconds), 4) as avg_seconds, count(*) >= 5 as enough_history"""
    r.add(
        "duration_percentiles",
        lambda t: rounded(
            rounded(history.duration_percentiles(t.builds, LAST), "p50", "p95", digits=8),
            "avg_seconds",
        ),
        "v_builds",
        f"with {RECENT} select {summary} from recent",
    )
    r.add(
        "fleet_percentiles",
        lambda t: rounded(history.fleet_percentiles(t.builds, LAST, PROJECT), "p50", "p95", digits=8),
        "v_builds",
        f"""with {RECENT_IN} select count(*) as builds, count(*) >= 5 as enough_history,
              {_percentiles()} from recent""",
    )
    r.add(
        "daily_percentiles",
        lambda t: day_text(
            rounded(history.daily_percentiles(t.builds, DAYS, as_of()), "p50", "p95", digits=8)
        ),
        "v_builds",
        f"""select cast(day as varchar) as day, count(*) as builds, {_percentiles()}
            from v_builds where day >= cast('{AS_OF}' as date) - {DAYS} group by day""",
    )
    r.add(
        "last_active_days",
        lambda t: day_text(
            rounded(history.last_active_days(t.builds, 60, PROJECT), "p50", "p95", digits=8)
        ),
        "v_builds",
        f"""select cast(day as varchar) as day, count(*) as builds, {_percentiles()}
            from v_builds where project = '{PROJECT}' group by v_builds.day
            order by v_builds.day desc limit 60""",
    )
    ranked = """count(*) as observations, round(avg(seconds), 4) as avg_seconds,
        max(seconds) as max_seconds"""
    ranked_order = f"order by avg(seconds) desc, name limit {TOP}"
    r.add(
        "target_trend",
        lambda t: rounded(history.target_trend(t.builds, t.targets, LAST, TOP), "avg_seconds"),
        "v_builds v_targets",
        f"""with {RECENT} select name, {ranked},
              count(*) filter (where fetched_from_cache) as cached_builds
            from v_targets t join recent r on r.build_key = t.build_key
            group by name {ranked_order}""",
    )
    for name, child, run in (
        ("phase_trend", "phases", history.phase_trend),
        ("ranked_targets", "targets", history.ranked_targets),
        ("ranked_phases", "phases", history.ranked_phases),
    ):
        r.add(
            name,
            lambda t, child=child, run=run: rounded(
                run(t.builds, getattr(t, child), LAST, TOP, PROJECT),
                "avg_seconds",
                "max_seconds",
            ),
            f"v_builds v_{child}",
            f"""with {RECENT_IN} select name, count(*) as observations,
                  round(avg(seconds), 4) as avg_seconds, round(max(seconds), 4) as max_seconds
                from v_{child} t join recent r on r.build_key = t.build_key
                group by name {ranked_order}""",
        )
    r.add(
        "slowest_targets",
        lambda t: rounded(
            history.slowest_targets(t.targets, DAYS, as_of(), TOP), "avg_seconds"
        ),
        "v_targets",
        f"""select name, {ranked} from v_targets
            where day >= cast('{AS_OF}' as date) - {DAYS} group by name {ranked_order}""",
    )
    r.add(
        "slowest_files",
        lambda t: rounded(history.slowest_files(t.builds, t.files, LAST, TOP), "avg_seconds"),
        "v_builds v_files",
        f"""with {RECENT} select file, max(target) as target, {ranked},
              cast(sum(occurrences) as bigint) as compilations
            from v_files t join recent r on r.build_key = t.build_key
            group by file order by avg(seconds) desc, file limit {TOP}""",
    )
    r.add(
        "slowest_swift_sites",
        lambda t: rounded(
            history.slowest_swift_sites(t.builds, t.swift, LAST, TOP), "avg_milliseconds"
        ),
        "v_builds v_swift",
        f"""with {RECENT} select file, line, kind, max(symbol) as symbol,
              count(*) as observations, round(avg(milliseconds), 4) as avg_milliseconds,
              max(milliseconds) as max_milliseconds, max(target) as target
            from v_swift t join recent r on r.build_key = t.build_key
            group by file, line, kind
            order by avg(milliseconds) desc, file, line, kind limit {TOP}""",
    )
    r.add(
        "diagnostic_trend",
        lambda t: history.diagnostic_trend(t.builds, t.diagnostics, LAST),
        "v_builds v_diagnostics",
        f"""with {RECENT} select r.build_key, {RECORDED} as recorded_at,
              cast(coalesce(sum(occurrences) filter (where severity = 'warning'), 0) as bigint)
                as warnings,
              cast(coalesce(sum(occurrences) filter (where severity in ('error', 'fatal')), 0)
                as bigint) as errors,
              count(d.fingerprint) as unique_diagnostics
            from recent r left join v_diagnostics d on d.build_key = r.build_key
            group by r.build_key, r.started_at, r.received_at""",
    )
    r.add(
        "diagnostic_clusters",
        lambda t: history.diagnostic_clusters(t.builds, t.diagnostics, LAST, TOP),
        "v_builds v_diagnostics",
        f"""with {RECENT} select fingerprint, max(severity) as severity,
              max(d.category) as category, max(message) as message, max(file) as file,
              count(distinct d.build_key) as builds,
              cast(sum(occurrences) as bigint) as occurrences
            from v_diagnostics d join recent r on r.build_key = d.build_key
            group by fingerprint
            order by builds desc, occurrences desc, fingerprint limit {TOP}""",
    )
    flaky = f"""per_build as (
          select t.suite, t.name, t.build_key, count(*) as runs,
            count(*) filter (where t.status = 'failed') as failed,
            count(*) filter (where t.status = 'passed') as passed, avg(seconds) as avg_seconds
          from v_tests t join recent r on r.build_key = t.build_key group by 1, 2, 3),
        flaky as (
          select suite, name, cast(sum(runs) as bigint) as runs,
            cast(sum(failed) as bigint) as failed, cast(sum(passed) as bigint) as passed,
            round(avg(avg_seconds), 4) as avg_seconds,
            count(*) filter (where failed > 0 and passed > 0) as retried_builds
          from per_build group by suite, name having sum(failed) > 0)"""
    r.add(
        "flaky_tests",
        lambda t: rounded(history.flaky_tests(t.builds, t.tests, LAST, TOP), "avg_seconds"),
        "v_builds v_tests",
        f"""with {RECENT}, {flaky} select *, passed > 0 as flaky from flaky
            order by retried_builds desc, failed desc, suite, name limit {TOP}""",
    )
    r.add(
        "overview",
        lambda t: rounded(
            history.overview(
                history.recent_builds(t.builds, 100),
                history.duration_trend(t.builds, LAST),
                history.failing_tests(t.builds, t.tests, LAST),
            ),
            "avg_seconds",
        ),
        "v_builds v_tests",
        f"""with {RECENT}, {flaky}, shown as (select * from v_builds
              order by received_at desc, build_key limit 100)
            select (select count(*) from shown) as builds,
              (select round(avg(total_seconds), 4) from recent) as avg_seconds,
              (select count(status) > 0 from shown) as knows_status,
              (select count(*) from shown where contains(status, 'fail')) as failed_builds,
              (select count(*) from shown where status = 'pending_tests') as pending_builds,
              (select count(*) from flaky where passed > 0) as flaky_tests,
              (select count(*) from flaky where retried_builds > 0) as retried_tests""",
    )
    r.add(
        "environment_mix",
        lambda t: rounded(history.environment_mix(t.builds, LAST), "avg_seconds"),
        "v_builds",
        f"""with {RECENT} select coalesce(xcode_version, 'unknown') as xcode_version,
              coalesce(platform, 'unknown') as platform,
              coalesce(architecture, 'unknown') as architecture, count(*) as builds,
              count(distinct machine_id) as machines,
              round(avg(total_seconds), 4) as avg_seconds
            from recent group by 1, 2, 3""",
    )
    r.add(
        "people",
        lambda t: rounded(history.people(t.builds, LAST), "avg_seconds"),
        "v_builds",
        f"""with recent as (select * from v_builds where build_user is not null
              order by received_at desc, build_key limit {LAST})
            select build_user as user, count(*) as builds,
              count(distinct coalesce(build_host, machine_id)) as machines,
              round(avg(total_seconds), 4) as avg_seconds,
              count(*) filter (where status = 'failed') as failed
            from recent group by build_user""",
    )
    r.add(
        "git_context",
        lambda t: history.git_context(t.builds, t.metadata, LAST),
        "v_builds v_metadata",
        f"""with {RECENT} select r.build_key, {RECORDED} as recorded_at, total_seconds,
              category, max(value) filter (where key = 'git.branch') as branch,
              max(value) filter (where key = 'git.commit') as commit,
              max(value) filter (where key = 'git.dirty') as dirty
            from recent r left join v_metadata m on m.build_key = r.build_key
            group by r.build_key, started_at, received_at, total_seconds, category""",
    )
    r.add(
        "test_totals",
        lambda t: rounded(
            history.test_totals(t.tests).select("build_key", "total", "failed", "seconds"),
            "seconds",
        ),
        "v_tests",
        """with final as (select build_key, suite, name, max_by(status, attempt) as s,
              sum(seconds) as secs from v_tests group by 1, 2, 3)
           select build_key, count(*) as total, count(*) filter (where s = 'failed') as failed,
             round(sum(secs), 4) as seconds from final group by build_key""",
    )
    r.add(
        "final_attempts",
        lambda t: history.final_attempts(t.tests).drop("day"),
        "v_tests",
        """select build_key, suite, name, status from v_tests
           qualify row_number() over (partition by build_key, suite, name
             order by attempt desc) = 1""",
    )
    r.add(
        "step_totals",
        lambda t: rounded(history.step_totals(t.steps).drop("day"), "executed_seconds"),
        "v_steps",
        """select build_key, count(*) as total, count(*) filter (where executed) as executed,
             round(coalesce(sum(seconds) filter (where executed), 0.0), 4) as executed_seconds
           from v_steps group by build_key""",
    )
    r.add(
        "test_rollup",
        lambda t: rounded(history.test_rollup(t.tests).drop("day"), "seconds"),
        "v_tests",
        """select build_key, suite, name, max_by(status, attempt) as status,
             round(sum(seconds), 4) as seconds,
             max_by(message, attempt) filter (where message is not null) as message,
             count(*) as attempts, bool_or(status = 'failed') as any_failed
           from v_tests group by 1, 2, 3""",
    )


def _details(r: Registry) -> None:
    def add(name, view, run, columns, order, limit):
        r.add(
            name,
            lambda t: longs(run(getattr(t, view), limit), "position").select(
                "build_key", "position", *columns
            ),
            f"v_{view}",
            f"""select build_key, position, {', '.join(columns)} from (
                  select *, row_number() over (partition by build_key order by {order})
                    as position from v_{view})
                where position <= {limit}""",
        )

    add(
        "detail_targets",
        "targets",
        history.detail_targets,
        ["name", "seconds", "category", "fetched_from_cache", "compiled_count"],
        "seconds desc, name",
        100,
    )
    add(
        "detail_phases", "phases", history.detail_phases, ["name"], "seconds desc, name", 50
    )
    add(
        "detail_files",
        "files",
        history.detail_files,
        ["file", "architecture", "target", "seconds", "occurrences", "step_type"],
        "seconds desc, file, architecture",
        50,
    )
    add(
        "detail_swift_timings",
        "swift",
        history.detail_swift_timings,
        ["file", "line", "symbol", "kind", "milliseconds", "target"],
        "milliseconds desc, kind, file, line, column_number",
        50,
    )
    add(
        "detail_diagnostics",
        "diagnostics",
        history.detail_diagnostics,
        ["fingerprint", "severity", "message", "occurrences"],
        "(severity = 'error') desc, occurrences desc, fingerprint",
        50,
    )
    r.add(
        "detail_tests",
        lambda t: rounded(
            longs(history.detail_tests(t.tests, C.DETAIL_TESTS), "position").drop("day", "any_failed"), "seconds"
        ),
        "v_tests",
        """with rollup_ as (select build_key, suite, name, max_by(status, attempt) as status,
             sum(seconds) as seconds,
             max_by(message, attempt) filter (where message is not null) as message,
             count(*) as attempts, bool_or(status = 'failed') as bad
           from v_tests group by 1, 2, 3)
           select build_key, suite, name, status, round(seconds, 4) as seconds, message,
             attempts, position from (select *, row_number() over (partition by build_key
               order by bad desc, seconds desc nulls last, suite, name) as position
             from rollup_) where position <= 50""",
    )
    r.add(
        "detail_steps",
        lambda t: longs(
            history.detail_steps(
                caps.step_ordinals(t.steps.withColumnRenamed("position", "source"), "source"),
                C.DETAIL_STEPS,
            ),
            "ordinal",
            "position",
        ).select("build_key", "ordinal", "position", "title", "executed"),
        "v_steps",
        """select build_key, o - 1 as ordinal, o as position, title, executed from (
             select *, row_number() over (partition by build_key
               order by started_at nulls last, position) as o from v_steps) where o <= 500""",
    )
    r.add(
        "detail_header",
        lambda t: history.detail_header(t.builds).select(
            "build_key",
            "recorded_at",
            "compiled_count",
            "replayed_steps",
            "build_user",
            "build_host",
        ),
        "v_builds",
        f"""select build_key, {RECORDED} as recorded_at, compiled_count, replayed_steps,
              build_user, build_host from v_builds""",
    )
    r.add(
        "detail_metadata",
        lambda t: t.metadata.orderBy("build_key", "key").select("build_key", "key", "value"),
        "v_metadata",
        "select build_key, key, value from v_metadata",
    )
    r.add(
        "fleet_detail_targets",
        lambda t: history.detail_children(
            t.targets, history.in_project(t.builds, PROJECT)
        ).drop("day"),
        "v_builds v_targets",
        f"""select t.build_key, name, seconds, t.category, fetched_from_cache, t.compiled_count
            from v_targets t join v_builds b on b.build_key = t.build_key
            where project = '{PROJECT}'""",
    )


BASELINE = """moments as (
      select project, received_at, min_by(build_key, build_key) as newest
      from v_builds group by project, received_at),
    linked as (
      select project, received_at, lag(newest) over (partition by project
        order by received_at) as baseline_key from moments),
    pairs as (
      select c.build_key, c.project, b.build_key as baseline_build_key,
        b.total_seconds as previous_seconds, c.total_seconds as current_seconds,
        b.category as previous_category, c.category as current_category,
        b.category <> c.category as category_changed,
        coalesce(b.xcode_version, '') <> coalesce(c.xcode_version, '')
          or coalesce(b.platform, '') <> coalesce(c.platform, '')
          or coalesce(b.architecture, '') <> coalesce(c.architecture, '')
          as environment_changed
      from v_builds c join linked l
        on l.project = c.project and l.received_at = c.received_at
      join v_builds b on b.build_key = l.baseline_key)"""

REGRESSIONS = BASELINE + """, regressed as (
      select p.build_key, baseline_build_key, project, c.name,
        b.seconds as previous_seconds, c.seconds as current_seconds,
        c.seconds - b.seconds as delta_seconds,
        (c.seconds - b.seconds) / b.seconds * 100.0 as delta_percent,
        case when environment_changed then 'low' else 'high' end as confidence,
        case when environment_changed then 'environment_shifted' else '' end as caveats
      from pairs p join v_targets c on c.build_key = p.build_key
      join v_targets b on b.build_key = p.baseline_build_key and b.name = c.name
      where not category_changed and c.seconds > b.seconds
        and c.fetched_from_cache = b.fetched_from_cache
        and c.seconds - b.seconds >= 0.5 and b.seconds > 0
        and (c.seconds - b.seconds) / b.seconds * 100.0 >= 10.0)"""


def _comparisons(r: Registry) -> None:
    r.add(
        "target_regressions",
        lambda t: rounded(
            regressions.target_regressions(t.builds, t.targets, PAIR, 50),
            "current_seconds",
            "previous_seconds",
            "delta_seconds",
            "delta_percent",
        ),
        "v_builds v_targets",
        f"""with ranked as (select build_key, row_number() over (order by received_at desc,
              build_key) as rank from v_builds),
            means as (select name, avg(seconds) filter (where rank <= {PAIR}) as now_,
              avg(seconds) filter (where rank > {PAIR}) as before_, count(*) as observations
              from v_targets t join ranked r on r.build_key = t.build_key
              where rank <= {2 * PAIR} group by name)
            select name, round(now_, 4) as current_seconds,
              round(before_, 4) as previous_seconds, observations,
              round(now_ - before_, 4) as delta_seconds,
              round((now_ - before_) / before_ * 100.0, 4) as delta_percent,
              'trend' as confidence
            from means where before_ > 0.5 and now_ - before_ >= 0.5
              and (now_ - before_) / before_ * 100.0 >= 10.0
            order by now_ - before_ desc, name limit 50""",
    )
    r.add(
        "previous_builds",
        lambda t: regressions.previous_builds(t.builds).select(
            "build_key", F.col("baseline.build_key").alias("baseline_build_key")
        ),
        "v_builds",
        f"with {BASELINE} select build_key, baseline_build_key from pairs",
    )
    r.add(
        "baseline_comparisons",
        lambda t: regressions.baseline_comparisons(t.builds).drop("day", "baseline_day"),
        "v_builds",
        f"with {BASELINE} select * from pairs",
    )
    r.add(
        "slower_targets",
        lambda t: regressions.slower_targets(
            regressions.baseline_comparisons(t.builds), t.targets
        ).select(
            "build_key",
            "baseline_build_key",
            "name",
            "previous_target_seconds",
            "current_target_seconds",
        ),
        "v_builds v_targets",
        f"""with {BASELINE} select p.build_key, baseline_build_key, c.name,
              b.seconds as previous_target_seconds, c.seconds as current_target_seconds
            from pairs p join v_targets c on c.build_key = p.build_key
            join v_targets b on b.build_key = p.baseline_build_key and b.name = c.name
            where c.seconds > b.seconds and c.fetched_from_cache = b.fetched_from_cache""",
    )
    r.add(
        "baseline_regressions",
        lambda t: rounded(
            regressions.baseline_regressions(t.builds, t.targets)
            .withColumn("caveats", F.array_join("caveats", ","))
            .drop("day", "reason", "metric_kind"),
            "delta_percent",
        ),
        "v_builds v_targets",
        f"""with {REGRESSIONS} select * replace (round(delta_percent, 4) as delta_percent)
            from regressed""",
    )


NEWEST = """newest as (select project, day, build_key from v_builds
    qualify row_number() over (partition by project order by received_at desc, build_key) = 1)"""


def _retention(r: Registry) -> None:
    r.add(
        "newest_of_project",
        lambda t: day_text(retention.newest_of_project(t.builds)),
        "v_builds",
        f"with {NEWEST} select project, cast(day as varchar) as day, build_key from newest",
    )
    doomed = f"""doomed as (select day, build_key from v_builds
        where received_at < timestamp '{NOW}' - interval '{KEEP_DAYS}' day
          and build_key not in (select build_key from newest))"""
    r.add(
        "prunable_builds",
        lambda t: day_text(
            retention.prunable_builds(t.builds, KEEP_DAYS, now()).select("day", "build_key")
        ),
        "v_builds",
        f"with {NEWEST}, {doomed} select cast(day as varchar) as day, build_key from doomed",
    )
    r.add(
        "droppable_days",
        lambda t: day_text(retention.droppable_days(t.builds, KEEP_DAYS, now())),
        "v_builds",
        f"""with {NEWEST} select cast(b.day as varchar) as day
            from v_builds b left join newest n on n.build_key = b.build_key
            group by b.day
            having bool_and(received_at < timestamp '{NOW}' - interval '{KEEP_DAYS}' day)
               and not bool_or(n.build_key is not null)""",
    )
    r.add(
        "retention_kept_targets",
        lambda t: store.kept_rows(
            t.targets, retention.prunable_builds(t.builds, KEEP_DAYS, now())
        ).select("build_key", "name"),
        "v_builds v_targets",
        f"""with {NEWEST}, {doomed} select build_key, name from v_targets
            where build_key not in (select build_key from doomed)""",
    )
    r.add(
        "stored_status",
        lambda t: verdict.stored_status(t.builds, t.tests, t.steps).select(
            "build_key", "status"
        ),
        "v_builds v_tests v_steps",
        """with outcome as (select build_key, bool_or(status = 'failed') as bad,
             count(*) as results from v_tests group by build_key),
           bundle as (select distinct build_key from v_steps where contains(title, '.xctest'))
           select b.build_key, case when bad then 'failed'
             when b.status = 'pending_tests' and results > 0 then 'succeeded'
             when b.status = 'succeeded' and results is null and x.build_key is not null
               then 'pending_tests' else b.status end as status
           from v_builds b left join outcome o on o.build_key = b.build_key
           left join bundle x on x.build_key = b.build_key""",
    )
    r.add(
        "test_bundle_builds",
        lambda t: verdict.produces_test_bundle(t.steps).select("build_key"),
        "v_steps",
        "select distinct build_key from v_steps where contains(title, '.xctest')",
    )


def _numbering(r: Registry) -> None:
    r.add(
        "attempt_numbers",
        lambda t: longs(caps.attempt_numbers(t.results), "attempt").select(
            "build_key", "suite", "name", "position", "attempt"
        ),
        "v_results",
        """select build_key, suite, name, position, row_number() over (
             partition by build_key, suite, name order by position) as attempt
           from v_results""",
    )
    r.add(
        "step_ordinals",
        lambda t: longs(caps.step_ordinals(t.steps_raw), "ordinal").select(
            "build_key", "position", "ordinal"
        ),
        "v_steps_raw",
        """select build_key, position, row_number() over (partition by build_key
             order by started_at nulls last, position) - 1 as ordinal from v_steps_raw""",
    )
    r.add(
        "capped_targets",
        lambda t: caps.keep_targets(t.targets, 3).select("build_key", "name", "seconds"),
        "v_targets",
        """select build_key, name, seconds from v_targets qualify row_number() over (
             partition by build_key order by seconds desc, name, category) <= 3""",
    )
    r.add(
        "capped_files",
        lambda t: caps.keep_files(t.files, C.MAX_FILES).select("build_key", "file", "architecture"),
        "v_files",
        """with kept as (select *, row_number() over (partition by build_key
             order by seconds desc, file, step_type, architecture) as n from v_files)
           select distinct build_key, file, architecture from kept where n <= 500""",
    )
    r.add(
        "capped_phases",
        lambda t: rounded(
            caps.keep_phases(t.phases, C.MAX_PHASES).select("build_key", "name", "seconds"), "seconds"
        ),
        "v_phases",
        """select build_key, name, round(seconds, 4) as seconds from v_phases
           qualify row_number() over (partition by build_key order by seconds desc, name) <= 64""",
    )
    r.add(
        "capped_swift_timings",
        lambda t: caps.keep_swift_timings(t.swift, C.MAX_SWIFT_TIMINGS).select(
            "build_key", "kind", "file", "line", "milliseconds"
        ),
        "v_swift",
        """select build_key, kind, file, line, milliseconds from v_swift
           qualify row_number() over (partition by build_key
             order by milliseconds desc, kind, file, line, column_number) <= 500""",
    )
    r.add(
        "capped_tests",
        lambda t: longs(caps.keep_tests(t.results, limit=5), "place").select(
            "build_key", "position", "place"
        ),
        "v_results",
        """with marked as (select *,
             bool_or(status <> 'passed') over (partition by build_key, suite, name) as bad,
             min(position) over (partition by build_key, suite, name) as first_
           from v_results), placed as (select *, row_number() over (partition by build_key
             order by bad desc, first_, position) as place from marked)
           select build_key, position, place from placed where place <= 5""",
    )
    r.add(
        "capped_diagnostics",
        lambda t: caps.keep_diagnostics(t.diagnostics, 3).select("build_key", "fingerprint"),
        "v_diagnostics",
        """select build_key, fingerprint from v_diagnostics qualify row_number() over (
             partition by build_key order by fingerprint) <= 3""",
    )
    r.add(
        "truncation_notes",
        lambda t: caps.truncation_notes(t.targets, "targets", 5).unionByName(
            caps.step_truncation_notes(t.steps, 1)
        ),
        "v_targets v_steps",
        """with over_ as (select build_key, target, greatest(count(*) - 1, 0) as n
             from v_steps group by 1, 2)
           select build_key, 'targets' as list, 'kept the slowest 5 of '
             || cast(count(*) as varchar) || ' targets (use --detail full for all)' as note
           from v_targets group by build_key having count(*) > 5
           union all
           select build_key, 'steps', 'kept the slowest 1 steps per target; '
             || cast(cast(sum(n) as bigint) as varchar)
             || ' slower-to-report steps omitted (use --detail full for all)'
           from over_ group by build_key having sum(n) > 0""",
    )
    r.add(
        "standard_detail_steps",
        lambda t: caps.standard_detail(
            t.steps, 1, [F.desc("seconds"), F.asc("position")], ["build_key", "target"]
        ).select("build_key", "target", "position"),
        "v_steps",
        """select build_key, target, position from v_steps qualify row_number() over (
             partition by build_key, target order by seconds desc, position) <= 1""",
    )
