"""Registered queries over activity sections."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import activity as A
from ..functions import loglines as L
from ..operators import activity, caps, pairing
from ..runtime import written
from .log_queries import category_sql, normalize_sql, part, quoted
from .registry import Registry, Tables, longs, rounded

VIEWS = "v_sections v_messages"
# What sections and messages read of the items.
ITEM_COLUMNS = (
    "build_key", "order_epoch", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    "l_quantity", "l_returnflag",
)
STEP_TYPE = (
    "case "
    + " ".join(
        f"when starts_with(s_or_t, '{p}') or starts_with(title, '{p}') then '{k}'"
        for p, k in A.STEP_RULES
    )
    + " else 'other' end"
)
KNOWN = ", ".join(f"'{a}'" for a in C.KNOWN_ARCHITECTURES)

WALK = f"""flagged as (select *,
      coalesce({part('title', A.WRAPPER_TITLE, 1)}, {part('title', A.WRAPPER_TITLE, 2)}) as wraps,
      coalesce({part('signature', A.STEP_TARGET, 1)}, {part('title', A.STEP_TARGET, 1)}) as tag
    from v_sections),
  walk as (
    select build_key, section_id, cast(null as varchar) as wrapper_id,
      cast(null as varchar) as wrapper_name, cast(null as varchar) as tagged_id,
      cast(null as varchar) as tagged_name from flagged where parent_id is null
    union all
    select f.build_key, f.section_id,
      coalesce(w.wrapper_id, case when f.wraps is not null then f.section_id end),
      coalesce(w.wrapper_name, f.wraps),
      coalesce(w.tagged_id, case when f.tag is not null then f.section_id end),
      coalesce(w.tagged_name, f.tag)
    from walk w join flagged f on f.build_key = w.build_key and f.parent_id = w.section_id),
  nested as (select distinct build_key from walk where wrapper_id is not null),
  owned as (select s.*, w.* exclude (build_key, section_id), n.build_key is not null as wrapped,
      case when n.build_key is not null then w.wrapper_id else w.tagged_name end as target_id,
      case when n.build_key is not null then w.wrapper_name else w.tagged_name end as target,
      case when s.parent_id is null then 'root'
        when n.build_key is not null and w.wrapper_id = s.section_id then 'target'
        when n.build_key is not null and w.wrapper_id is not null then 'step'
        when n.build_key is null and w.tagged_id is not null then 'step'
        else 'phase' end as role
    from v_sections s join walk w on w.build_key = s.build_key and w.section_id = s.section_id
    left join nested n on n.build_key = s.build_key)"""

STEPS = f"""{WALK},
  begun as (select build_key, time_started as begun from v_sections where parent_id is null),
  shaped as (select *, case when signature = '' then title else signature end as s_or_t,
      string_split_regex(trim(signature), '\\s+') as words,
      rtrim(rtrim(regexp_extract(title, '([^(]*)$', 1)), ')') as tail
    from owned where role = 'step'),
  typed as (select o.*, {STEP_TYPE} as step_type,
      coalesce(case when document_url <> '' then replace(document_url, 'file://', '') end,
        list_filter(words, lambda w: starts_with(w, '/') and contains(w, '.'))[1]) as file,
      coalesce(case when contains(title, '(') and tail in ({KNOWN}) then tail end,
        list_filter(words, lambda w: w in ({KNOWN}))[1]) as architecture,
      case when time_stopped >= time_started then time_stopped - time_started else 0.0 end
        as seconds,
      time_started + 978307200 as started_at,
      coalesce(time_started >= begun - 1.0, true) as executed
    from shaped o join begun b on b.build_key = o.build_key),
  steps as (select *, was_fetched_from_cache as fetched_from_cache, 'step:' || step_type || ':'
      || target || ':' || coalesce(architecture, '-') || ':' || coalesce(file, signature)
      as fingerprint from typed)"""

RESULTS = f"""{STEPS},
  spans as (
    select build_key, target_id, target, case when time_stopped >= time_started
        then time_stopped - time_started else 0.0 end as seconds
      from owned where role = 'target'
    union all
    select build_key, target_id, target,
      case when max(time_stopped) >= min(time_started)
        then max(time_stopped) - min(time_started) else 0.0 end
      from owned where not wrapped and tagged_id = section_id group by 1, 2, 3),
  counts as (select build_key, target_id,
      count(*) filter (where executed and step_type not in ('other', 'scriptExecution',
        'copySwiftLibs')) as relevant,
      count(*) filter (where executed and step_type not in ('other', 'scriptExecution',
        'copySwiftLibs') and not fetched_from_cache) as compiled,
      count(*) filter (where executed) as ran,
      coalesce(bool_and(fetched_from_cache) filter (where executed), false) as cached,
      count(*) filter (where executed and fetched_from_cache) as hits
    from steps group by 1, 2),
  targets as (select s.build_key, s.target_id, s.target as name, seconds,
      case when coalesce(relevant, 0) = 0 or compiled = 0 then 'noop'
        when compiled = relevant then 'clean' else 'incremental' end as category,
      coalesce(compiled, 0) as compiled_count, coalesce(cached, false) as fetched_from_cache,
      coalesce(ran, 0) as ran, coalesce(hits, 0) as hits
    from spans s left join counts c on c.build_key = s.build_key and c.target_id = s.target_id),
  facts as (select build_key, time_started + 978307200 as started_at,
      case when time_stopped >= time_started then time_stopped - time_started end
        as total_seconds,
      case when contains(lower(localized_result_string), 'succeeded') then 'succeeded'
        when contains(lower(localized_result_string), 'failed') then 'failed' end as status
    from v_sections where parent_id is null),
  rolled as (select build_key, count(*) as n, count(*) filter (where category = 'noop') as idle,
      count(*) filter (where category = 'clean') as fresh,
      cast(sum(compiled_count) as bigint) as compiled_count,
      cast(sum(ran) as bigint) as ran, cast(sum(hits) as bigint) as hits
    from targets group by 1),
  builds as (select f.build_key, f.status, started_at, total_seconds,
      case when n is null then 'unknown' when idle = n then 'noop' when fresh > n // 2
        then 'clean' else 'incremental' end as category,
      coalesce(compiled_count, 0) as compiled_count,
      case when ran > 0 then round(hits / ran, 8) end as cache_hit_rate,
      case when coalesce(ran, 0) = 0 then 'unknown' when hits = ran then 'warm'
        when hits > 0 then 'partial' else 'cold' end as cache_status
    from facts f left join rolled r on r.build_key = f.build_key),
  phases as (select build_key, title as name,
      sum(time_stopped - time_started) as seconds,
      min(time_started + 978307200) as started_at, max(time_stopped + 978307200) as ended_at
    from owned where (role = 'phase' or (not wrapped and parent_id is not null))
      and time_stopped - time_started > 0 and title <> '' group by 1, 2),
  files as (select build_key, file, step_type, architecture, max(seconds) as seconds,
      count(*) as occurrences, first(target order by seconds desc, ord) as target
    from steps where file is not null and seconds > 0 group by 1, 2, 3, 4),
  notes as (select m.build_key, o.ord, message_no, m.title as message, m.severity,
      replace(m.document_url, 'file://', '') as file, m.line, m.column_number as "column",
      o.target
    from v_messages m join owned o on o.build_key = m.build_key
      and o.section_id = m.section_id and o.role = 'step' where m.severity >= 1)"""


class Model:
    """The sections with their owners, stored if they are read ``again``, and what is
    derived from them."""

    def __init__(self, t: Tables, again: bool = True):
        t.place(ITEM_COLUMNS)
        self.owned, self.sections = activity.owned_sections(t.sections, again=again)
        self.facts = activity.build_facts(self.sections)

    @cached_property
    def steps(self):
        return activity.steps(self.owned, self.facts)

    def targets(self):
        return activity.target_results(self.steps, activity.target_spans(self.owned))


def broken_sections(t: Tables):
    """Wrappers of some builds that hang below nothing, or below themselves."""
    t.place(ITEM_COLUMNS)
    key = F.col("build_key").cast("bigint")
    wrapper = F.startswith("section_id", F.lit("w"))
    parent = (
        F.when(wrapper & (key % 11 == 3), F.col("section_id"))
        .when(wrapper & (key % 7 == 2), "gone")
        .otherwise(F.col("parent_id"))
    )
    return t.sections.withColumn("parent_id", parent)


def log_sides(t: Tables) -> tuple[pairing.Side, pairing.Side]:
    """Builds with a text log, an activity log or both, some unreadable, some without
    timings or diagnostics: every combination occurs."""
    k = F.col("build_key").cast("bigint")
    text, activity_log, read = k % 3 != 0, k % 3 != 1, k % 5 != 2
    metrics = t.builds.select("build_key", "total_seconds")
    timings = t.swift.select("build_key", "file", "line", "milliseconds")
    diagnostics = t.diagnostics.select("build_key", "fingerprint")
    others = t.results.select("build_key", F.col("name").alias("fingerprint"))
    keys = t.builds.select("build_key")
    return (
        pairing.Side(
            keys.where(text), metrics.where(text), timings.where(text & (k % 7 != 3)),
            diagnostics.where(text & (k % 4 != 1)),
        ),
        pairing.Side(
            keys.where(activity_log), metrics.where(activity_log & read),
            timings.where(activity_log & read & (k % 2 == 0)), others.where(activity_log & read),
        ),
    )


def owned_of(t: Tables):
    return Model(t, again=False).owned


def steps_of(t: Tables):
    return Model(t, again=False).steps


def targets_of(t: Tables):
    return Model(t).targets()


def builds_of(t: Tables):
    model = Model(t)
    return activity.build_results(model.facts, model.targets())


def usable_of(t: Tables):
    model = Model(t)
    targets = model.targets()
    warnings = t.messages.select("build_key", F.col("title").alias("warning"))
    return activity.usable_builds(
        activity.build_results(model.facts, targets),
        targets,
        activity.phases(model.owned),
        activity.files(model.steps),
        activity.swift_timings(model.owned, t.messages),
        warnings,
    )


def ruled_builds(t: Tables):
    """Builds of every kind that the rules tell apart: with nothing but set-up phases of
    each name, partly decoded for each reason, measured, timed or none of these."""
    k = F.col("build_key").cast("bigint")
    builds = t.builds.select(
        "build_key",
        F.when(k % 6 != 1, F.col("total_seconds")).alias("total_seconds"),
        F.when(F.col("compiled_count") % 3 == 0, 0).otherwise(F.col("compiled_count")).alias("compiled_count"),
    )
    keys = t.builds.select("build_key")

    def one_of(values: tuple[str, ...], of) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (of % len(values) + 1).cast("int"))

    setup = keys.where(k % 4 != 3).select("build_key", F.concat(one_of(C.SETUP_PHASES, k), F.lit(" (x)")).alias("name"))
    work = keys.where(k % 4 == 2).select("build_key", F.lit("Compile").alias("name"))
    told = F.when(k % 13 < 6, F.concat(F.lit("log: "), one_of(C.PARTIAL_DECODE_MARKERS, k))).otherwise("slow")
    return activity.usable_builds(
        builds,
        keys.where(k % 5 == 0),
        setup.unionByName(work),
        keys.where(k % 7 == 0),
        keys.where(k % 11 == 0),
        keys.select("build_key", told.alias("warning")),
    )


def register(r: Registry) -> None:
    def add(name, run, prefix, sql):
        r.add(name, run, VIEWS, f"with {prefix} {sql}")

    add(
        "section_walk",
        lambda t: owned_of(t).select("build_key", "section_id", "role", "target_id", "target"),
        WALK,
        "select build_key, section_id, role, target_id, target from owned",
    )
    # Of every seventh build the wrappers hang below a section that is not there, and of
    # every eleventh the first wrapper and its steps' parents form a circle.
    r.add(
        "rejected_sections",
        lambda t: activity.rejected_sections(activity.climbed_by_build(broken_sections(t))),
        "v_sections",
        """with s as (select *, cast(build_key as bigint) as k from v_sections),
             tops as (select build_key, section_id, case when k % 11 = 3 then 'loop' else 'orphan' end as reject
               from s where section_id like 'w%' and (k % 11 = 3 or k % 7 = 2)),
             below as (select s.build_key, s.section_id, t.reject from s join tops t
               on t.build_key = s.build_key and s.parent_id = t.section_id),
             nested as (select s.build_key, s.section_id, b.reject from s join below b
               on b.build_key = s.build_key and s.parent_id = b.section_id)
           select * from tops union all select * from below union all select * from nested""",
    )
    add(
        "activity_steps",
        lambda t: steps_of(t).select(
            "build_key",
            "section_id",
            "step_type",
            "file",
            "architecture",
            "seconds",
            "started_at",
            "executed",
            "fingerprint",
        ),
        STEPS,
        """select build_key, section_id, step_type, file, architecture, seconds, started_at,
             executed, fingerprint from steps""",
    )
    add(
        "replayed_steps",
        lambda t: activity.replayed_steps(steps_of(t)),
        STEPS,
        """select build_key, count(*) filter (where not executed) as replayed_steps
           from steps group by build_key""",
    )
    add(
        "activity_targets",
        lambda t: targets_of(t).select(
            "build_key",
            "target_id",
            "name",
            "seconds",
            "category",
            "compiled_count",
            "fetched_from_cache",
        ),
        RESULTS,
        """select build_key, target_id, name, seconds, category, compiled_count,
             fetched_from_cache from targets""",
    )
    add(
        "activity_builds",
        lambda t: rounded(builds_of(t), "cache_hit_rate", digits=8).select(
            "build_key",
            "status",
            "started_at",
            "total_seconds",
            "category",
            "compiled_count",
            "cache_hit_rate",
            "cache_status",
        ),
        RESULTS,
        "select * from builds",
    )
    add(
        "build_schemes",
        lambda t: activity.build_facts(t.sections).select("build_key", "scheme", "platform"),
        f"""sub as (select * from v_sections where contains(subtitle, 'Scheme ')
              and parent_id = 'r')""",
        """select s.build_key, regexp_extract(sub.subtitle, 'Scheme ([^|]*[^| ])', 1) as scheme,
             regexp_extract(sub.subtitle, 'Destination ([^|]*[^| ])', 1) as platform
           from v_sections s left join sub on sub.build_key = s.build_key
           where s.parent_id is null""",
    )
    add(
        "activity_phases",
        lambda t: activity.phases(owned_of(t)),
        RESULTS,
        "select * from phases",
    )
    add(
        "activity_files",
        lambda t: activity.files(steps_of(t)),
        RESULTS,
        "select * from files",
    )
    add(
        "build_architectures",
        lambda t: activity.architectures(activity.files(steps_of(t))),
        RESULTS,
        """select build_key, count(distinct architecture) as count,
             array_to_string(list_sort(list(distinct architecture)), ', ') as names
           from files where architecture <> '' group by 1
           having count(distinct architecture) >= 2""",
    )
    add(
        "activity_message_totals",
        lambda t: activity.message_totals(activity.step_messages(owned_of(t), t.messages)),
        RESULTS,
        """select build_key, count(*) filter (where severity >= 2) as error_count,
             count(*) filter (where severity = 1) as warning_count from notes group by 1""",
    )
    add(
        "activity_messages",
        lambda t: activity.step_messages(owned_of(t), t.messages),
        RESULTS,
        """select * replace (case when severity >= 2 then 'error' else 'warning' end as severity)
           from notes""",
    )
    word = "case when severity >= 2 then 'error' else 'warning' end"
    add(
        "activity_diagnostics",
        lambda t: activity.activity_diagnostics(
            activity.step_messages(owned_of(t), t.messages)
        ).select("build_key", "fingerprint", "occurrences", "message", "target"),
        f"""{RESULTS}, marked as (select *, {category_sql('message')} || ':' || {word} || ':'
              || coalesce(file, '') || ':' || {normalize_sql('message')} as fingerprint
            from notes)""",
        """select build_key, fingerprint, count(*) as occurrences,
             first(message order by ord, message_no) as message,
             first(target order by ord, message_no) as target from marked group by 1, 2""",
    )
    timing = quoted(L.SWIFT_TIMING_MESSAGE)
    add(
        "activity_swift_timings",
        lambda t: activity.swift_timings(owned_of(t), t.messages),
        f"""{WALK}, read_ as (
              select build_key, section_id, case when role = 'step' and wrapped then target end
                as target from owned where parent_id is not null
              union all select build_key, section_id, target from owned
                where role = 'step' and not wrapped)""",
        f"""select m.build_key, m.section_id, message_no,
              case when {part('title', L.SWIFT_TIMING_MESSAGE, 2)} is null then 'type_check'
                else 'function_body' end as kind,
              replace(coalesce(document_url, ''), 'file://', '') as file,
              coalesce(line, 0) as line, coalesce(column_number, 0) as column_number,
              {part('title', L.SWIFT_TIMING_MESSAGE, 2)} as symbol,
              cast({part('title', L.SWIFT_TIMING_MESSAGE, 3)} as double) as milliseconds,
              target
            from v_messages m join read_ o on o.build_key = m.build_key
              and o.section_id = m.section_id where regexp_matches(title, {timing})""",
    )
    add(
        "usable_builds",
        lambda t: usable_of(t),
        f"""{RESULTS}, n as (select b.build_key, total_seconds, compiled_count,
              (select count(*) from targets x where x.build_key = b.build_key) as t,
              (select count(*) from files x where x.build_key = b.build_key) as f,
              (select count(*) from v_messages x join owned o on o.build_key = x.build_key
                and o.section_id = x.section_id where x.build_key = b.build_key
                and contains(x.title, 'ms to type-check')) as s,
              (select count(*) from phases x where x.build_key = b.build_key) as p,
              coalesce((select bool_and(starts_with(name, 'Prepare clean')) from phases x
                where x.build_key = b.build_key), false) as setup
            from builds b), g as (select *, t = 0 and f = 0 and compiled_count = 0 and p > 0
              and setup as setup_only from n)""",
        """select build_key, setup_only, false as decoded_partially,
             f > 0 or s > 0 or (not setup_only and total_seconds is not null
               and (t > 0 or p > 0)) as usable from g""",
    )
    r.add(
        "usable_build_rules",
        ruled_builds,
        "v_builds",
        """with b as (select build_key, cast(build_key as bigint) as k, total_seconds, received_at,
               case when compiled_count % 3 = 0 then 0 else compiled_count end as compiled
             from v_builds),
           f as (select *, k % 5 = 0 as has_target, k % 7 = 0 as has_file, k % 11 = 0 as has_timing,
               k % 4 <> 3 as has_phases, k % 4 <> 2 as only_setup, k % 13 < 6 as cut from b),
           g as (select *, not has_target and not has_file and compiled = 0 as bare from f)
           select build_key, bare and has_phases and only_setup as setup_only, bare and cut as decoded_partially,
             has_file or has_timing or (not (bare and has_phases and only_setup) and not (bare and cut)
               and k % 6 <> 1 and (has_target or has_phases)) as usable from g""",
    )
    r.add(
        "swift_site_totals",
        lambda t: rounded(activity.swift_site_totals(t.unit_swift), "milliseconds", digits=8),
        "v_unit_swift",
        """select build_key, file, line, column_number,
             round(sum(milliseconds), 8) as milliseconds, count(*) as occurrences,
             first(symbol order by ord) filter (where symbol is not null) as symbol
           from v_unit_swift group by 1, 2, 3, 4""",
    )
    r.add(
        "paired_diagnostics",
        lambda t: activity.prefer(
            t.diagnostics.select("build_key", "fingerprint"),
            t.results.select("build_key", F.col("name").alias("fingerprint")),
        ),
        "v_diagnostics v_results",
        """select build_key, fingerprint from v_diagnostics union all
           select build_key, name from v_results
           where build_key not in (select build_key from v_diagnostics)""",
    )
    r.add(
        "paired_analyses",
        lambda t: pairing.pairing_summary(pairing.paired(*log_sides(t))),
        "v_builds v_swift v_diagnostics v_results",
        """with b as (select build_key, cast(build_key as bigint) as k from v_builds),
             t as (select build_key, count(*) as n from v_swift group by 1),
             d as (select build_key, count(*) as n from v_diagnostics group by 1),
             e as (select build_key, count(*) as n from v_results group by 1),
             f as (select b.build_key, k % 3 <> 1 as has_activity, k % 3 <> 1 and k % 5 <> 2 as read,
                 k % 3 <> 0 as has_text,
                 case when k % 3 <> 1 and k % 5 <> 2 and k % 2 = 0 then coalesce(t.n, 0) else 0 end as at_,
                 case when k % 3 <> 0 and k % 7 <> 3 then coalesce(t.n, 0) else 0 end as tt,
                 case when k % 3 <> 0 and k % 4 <> 1 then coalesce(d.n, 0) else 0 end as td,
                 case when k % 3 <> 1 and k % 5 <> 2 then coalesce(e.n, 0) else 0 end as ad
               from b left join t using (build_key) left join d using (build_key)
                 left join e using (build_key)),
             g as (select *, case when read then 'activity' when has_text and not has_activity
                 then 'text' end as m from f),
             h as (select build_key, m as metrics_from, case when m is null then 0 else 1 end as metrics,
                 case when at_ > 0 then 'activity' when m is not null and tt > 0 then 'text' end as timings_from,
                 case when at_ > 0 then at_ when m is not null then tt else 0 end as timings,
                 case when td > 0 then 'text' when ad > 0 then 'activity' end as diagnostics_from,
                 case when td > 0 then td else ad end as diagnostics from g)
           select * replace (cast(metrics as bigint) as metrics) from h
           where metrics > 0 or timings > 0 or diagnostics > 0""",
    )

    def order() -> list[Column]:
        return [F.desc("seconds"), F.asc("file"), F.asc("step_type"), F.asc_nulls_first("architecture")]

    r.add(
        "standard_detail_files",
        lambda t: longs(
            caps.standard_detail(activity.files(steps_of(t)), 2, order()), "occurrences"
        ).select("build_key", "file", "step_type", "architecture", "occurrences"),
        VIEWS,
        f"""with {RESULTS} select build_key, file, step_type, architecture, occurrences
            from files qualify row_number() over (partition by build_key
              order by seconds desc, file, step_type, architecture nulls first) <= 2""",
    )
