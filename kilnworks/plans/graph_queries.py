"""Registered queries over dependency graphs and build intelligence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import graph, intel
from ..runtime import joined_in_place, written, written_by
from .registry import Registry, Tables, longs, rounded

GRAPH_VIEWS = "v_nodes v_edges"
PAIRS = """named as (select distinct graph, name || chr(1) || project as id, name, project
    from v_nodes),
  raw as (select distinct graph, from_name || chr(1) || from_project as src,
      to_name || chr(1) || to_project as dst, from_name, to_name from v_edges),
  proper as (select * from raw where src <> dst),
  pairs as (select p.* from proper p
    join named a on a.graph = p.graph and a.id = p.src
    join named b on b.graph = p.graph and b.id = p.dst),
  tops as (select graph, id from named n where not exists (
    select 1 from pairs p where p.graph = n.graph and p.dst = n.id))"""
REACH = f"""{PAIRS},
  reach as (select graph, src, dst from pairs
    union select r.graph, r.src, p.dst from reach r
      join pairs p on p.graph = r.graph and p.src = r.dst)"""
CHAINS = f"""{PAIRS},
  upward as (select distinct graph, dst as target, dst as at_, [dst] as path from pairs
    union all select u.graph, u.target, p.src, list_append(path, p.src) from upward u
      join pairs p on p.graph = u.graph and p.dst = u.at_
      where not list_contains(path, p.src)),
  arrived as (select u.* from upward u join tops t on t.graph = u.graph and t.id = u.at_
    where len(path) > 1
    qualify row_number() over (partition by u.graph, target order by len(path), at_, path) = 1),
  chains as (select graph, target, array_to_string(list_transform(list_reverse(path),
      lambda n: replace(n, chr(1), '|')), ' > ') as path from arrived)"""


def shown(node: str) -> Column:
    return F.concat_ws("|", f"{node}.name", f"{node}.project")


def sql_shown(column: str) -> str:
    return f"replace({column}, chr(1), '|')"


def pairs_of(t: Tables):
    """Edges and nodes move once, to the place of their graph; the pairs lie there too."""
    t.keep("edges", "graph")
    t.keep("nodes", "graph")
    with joined_in_place(t.spark):
        return written_by(graph.edge_set(t.nodes, t.edges), "pairs", "graph", placed=True)


def chains_of(t: Tables):
    return graph.shortest_chains(t.nodes, pairs_of(t), placed=True)


def path_text(path: str) -> Column:
    return F.array_join(
        F.transform(path, lambda n: F.concat_ws("|", n["name"], n["project"])), " > "
    )


def register(r: Registry) -> None:
    def add(name, run, prefix, sql):
        r.add(name, run, GRAPH_VIEWS, f"with {prefix} {sql}")

    add(
        "graph_edge_set",
        lambda t: graph.edge_set(t.nodes, t.edges).select(
            "graph", shown("src").alias("src"), shown("dst").alias("dst")
        ),
        PAIRS,
        f"select graph, {sql_shown('src')} as src, {sql_shown('dst')} as dst from pairs",
    )
    add(
        "graph_self_dependencies",
        lambda t: graph.self_dependencies(t.edges),
        PAIRS,
        """select graph, split_part(src, chr(1), 1) as name, split_part(src, chr(1), 2)
           as project from raw where src = dst""",
    )
    add(
        "graph_dangling_edges",
        lambda t: graph.dangling_edges(t.nodes, t.edges).select("graph", "from_name", "to_name"),
        PAIRS,
        """select p.graph, from_name, to_name from proper p
           left join named a on a.graph = p.graph and a.id = p.src
           left join named b on b.graph = p.graph and b.id = p.dst
           where a.id is null or b.id is null""",
    )
    add(
        "graph_completeness",
        lambda t: graph.completeness(t.nodes, t.edges),
        PAIRS,
        """select g.graph, count(p.src) as dangling, count(p.src) = 0 as complete
           from (select distinct graph from named) g left join (
             select p.* from proper p
             left join named a on a.graph = p.graph and a.id = p.src
             left join named b on b.graph = p.graph and b.id = p.dst
             where a.id is null or b.id is null) p on p.graph = g.graph group by g.graph""",
    )
    add(
        "graph_direct",
        lambda t: graph.direct(graph.edge_set(t.nodes, t.edges)).select(
            "graph", shown("node").alias("node"), "relation", shown("other").alias("other")
        ),
        PAIRS,
        f"""select graph, {sql_shown('dst')} as node, 'dependent' as relation,
              {sql_shown('src')} as other from pairs union all
            select graph, {sql_shown('src')}, 'dependency', {sql_shown('dst')} from pairs""",
    )
    fans = """fans as (select graph, name, cast(sum(i) as bigint) as fan_in,
        cast(sum(o) as bigint) as fan_out from (
          select graph, to_name as name, 1 as i, 0 as o from proper union all
          select graph, from_name, 0, 1 from proper) group by 1, 2)"""
    add(
        "graph_fan_counts",
        lambda t: longs(graph.fan_counts(t.edges), "fan_in", "fan_out"),
        f"{PAIRS}, {fans}",
        "select * from fans",
    )
    add(
        "graph_hotspots",
        lambda t: longs(graph.hotspots(t.edges, C.GRAPH_HOTSPOTS), "position", "fan_in", "fan_out"),
        f"{PAIRS}, {fans}",
        """select * from (select *, row_number() over (partition by graph
             order by fan_in desc, name) as position from fans where fan_in > 0)
           where position <= 20""",
    )
    add(
        "graph_reverse_dependencies",
        lambda t: graph.reverse_dependencies(t.edges),
        PAIRS,
        "select distinct graph, to_name as name, from_name as dependent from proper",
    )
    add(
        "graph_roots",
        lambda t: graph.roots(t.nodes, graph.edge_set(t.nodes, t.edges)).select(
            "graph", shown("node").alias("node")
        ),
        PAIRS,
        f"select graph, {sql_shown('id')} as node from tops",
    )
    add(
        "graph_transitive",
        lambda t: graph.transitive(graph.closure(pairs_of(t), placed=True)).select(
            "graph", shown("node").alias("node"), "relation", shown("other").alias("other")
        ),
        REACH,
        f"""select graph, {sql_shown('dst')} as node, 'dependent' as relation,
              {sql_shown('src')} as other from reach where src <> dst union all
            select graph, {sql_shown('src')}, 'dependency', {sql_shown('dst')} from reach
            where src <> dst""",
    )
    add(
        "graph_cycles",
        lambda t: graph.cycle_members(pairs_of(t), placed=True),
        REACH,
        """select a.graph, split_part(a.src, chr(1), 2) || '::' || split_part(a.src, chr(1), 1)
             as member, least(min(split_part(a.dst, chr(1), 2) || '::'
               || split_part(a.dst, chr(1), 1)), split_part(a.src, chr(1), 2) || '::'
               || split_part(a.src, chr(1), 1)) as cycle
           from reach a join reach b on b.graph = a.graph and b.src = a.dst and b.dst = a.src
           where a.src <> a.dst group by a.graph, a.src""",
    )
    add(
        "graph_names",
        lambda t: graph.by_name(t.nodes),
        PAIRS,
        """select graph, name, count(*) as candidates,
             case when count(*) = 1 then min(project) end as project from named group by 1, 2""",
    )
    add(
        "graph_shortest_chains",
        lambda t: chains_of(t).select(
            "graph", shown("target").alias("target"), path_text("path").alias("path")
        ),
        CHAINS,
        f"select graph, {sql_shown('target')} as target, path from chains",
    )
    add(
        "graph_why_built",
        why_built_of,
        CHAINS,
        """select n.graph, n.name, case when count(*) > 1 then 'ambiguous'
             when min(c.path) is not null then 'path'
             when min(t.id) is not null then 'root' else 'no path' end as verdict,
             case when count(*) > 1
               then array_to_string(list_sort(list(n.project)), ', ')
               else regexp_replace(min(c.path), '\\|[^ ]*', '', 'g') end as answer
           from named n left join chains c on c.graph = n.graph
             and c.target = n.id
           left join tops t on t.graph = n.graph and t.id = n.id group by n.graph, n.name""",
    )
    declared = "select graph, count(*) + 1 as declared_count from v_nodes group by graph"
    add(
        "graph_summary",
        lambda t: graph.graph_summary(
            t.nodes,
            t.edges,
            t.nodes.groupBy("graph").agg((F.count(F.lit(1)) + 1).alias("declared_count")),
            C.GRAPH_HOTSPOTS,
        ),
        f"""{PAIRS}, {fans}, declared as ({declared}),
          hot as (select graph, string_agg(name, ', ' order by position) as hotspots from (
            select *, row_number() over (partition by graph order by fan_in desc, name)
              as position from fans where fan_in > 0) where position <= 20 group by graph)""",
        """select n.graph, n.targets, declared_count, coalesce(d.dependencies, 0)
             as dependencies, coalesce(hotspots, '') as hotspots
           from (select graph, count(*) as targets from named group by graph) n
           left join declared using (graph)
           left join (select graph, count(*) as dependencies from proper group by graph) d
             using (graph) left join hot using (graph)""",
    )
    _intel(r)


SAME = """(replace({a}, '\\', '/') = replace({b}, '\\', '/')
    or (length({b}) > 0 and ends_with({a}, '/' || {b}))
    or (length({a}) > 0 and ends_with({b}, '/' || {a})))"""


def same(a: str, b: str) -> str:
    return SAME.format(a=a, b=b)


MATCHES = f"""hits as (select c.build_key, position, path,
      case when file = path then 'exact' else 'suffix' end as kind, target,
      row_number() over (partition by c.build_key, position, path
        order by seconds desc, file, step_type, architecture) as n
    from v_unit_changes c join v_unit_files f on f.build_key = c.build_key
      and {same('f.file', 'c.path')}),
  matches as (select c.build_key, c.position, c.path as changed_file,
      coalesce(kind, 'none') as match_kind, target as owning_target
    from v_unit_changes c left join hits h on h.build_key = c.build_key
      and h.position = c.position and h.path = c.path and n = 1)"""
DEPENDENTS = f"""{REACH},
  dependents as (select distinct graph as build_key, split_part(dst, chr(1), 1) as target,
      split_part(src, chr(1), 1) as dependent from reach where src <> dst)"""
IMPACTS = f"""{DEPENDENTS}, {MATCHES},
  blocked as (select build_key, target, count(*) as n from dependents group by 1, 2),
  impacts as (select m.*, coalesce(b.n, 0) as downstream from matches m left join blocked b
    on b.build_key = m.build_key and b.target = m.owning_target)"""
RELATED = f"""related as (select d.* from v_unit_diagnostics d where file is not null and exists (
    select 1 from v_unit_changes c where c.build_key = d.build_key
      and {same('d.file', 'c.path')}))"""
LINKS = f"""{IMPACTS}, {RELATED},
  downstream_ as (select m.build_key, m.position, m.changed_file,
      d.dependent as downstream_target from matches m join dependents d
      on d.build_key = m.build_key and d.target = m.owning_target),
  places as (select build_key, owning_target as target, 0 as tier, position, '' as name
      from matches where owning_target is not null
    union all select build_key, downstream_target, 1, position, downstream_target
      from downstream_),
  suites as (select t.build_key, t.suite, p.target, row_number() over (partition by t.build_key,
      t.suite order by tier, position, p.name) as n, t.results
    from (select build_key, suite, count(*) as results from v_unit_tests
      where status = 'failed' group by 1, 2) t
    join places p on p.build_key = t.build_key
      and lower(p.target) = regexp_replace(lower(t.suite), 'tests$', '')),
  owners as (select r.build_key, r.fingerprint, m.owning_target, row_number() over (
      partition by r.build_key, r.fingerprint order by m.position, m.changed_file) as n
    from related r join matches m on m.build_key = r.build_key
      and {same('r.file', 'm.changed_file')} where r.target is null),
  links as (
    select build_key, owning_target as subject, 'changed_file' as kind,
      case match_kind when 'exact' then 30 else 25 end as weight, 1 as repeats
      from matches where owning_target is not null
    union all select build_key, name, 'regression', case confidence when 'high' then 25
      when 'medium' then 15 else 5 end, 1 from v_unit_regressions
    union all select r.build_key, coalesce(r.target, o.owning_target), 'diagnostic', 20, 1
      from related r left join owners o on o.build_key = r.build_key
        and o.fingerprint = r.fingerprint and o.n = 1
      where coalesce(r.target, o.owning_target) is not null
    union all select build_key, target, 'failing_suite', 15, results from suites where n = 1),
  counters as (select build_key, min(a) as a, min(b) as b from (
      select build_key, -25 as a, 0 as b from v_unit_metadata where value = 'true'
      union all select build_key, 0, -20 from v_unit_regressions
        where caveat = 'environment_shifted') group by 1),
  chains as (select l.build_key, subject, cast(sum(repeats) as bigint) as positive_links,
      cast(sum(weight * repeats) as bigint) + coalesce(min(a), 0) + coalesce(min(b), 0) as raw
    from links l left join counters c on c.build_key = l.build_key group by 1, 2),
  kept as (select build_key, subject, positive_links, least(100, greatest(0, raw))
      as confidence from chains where raw >= 25 and positive_links >= 2)"""
INTEL_VIEWS = (
    "v_nodes v_edges v_unit_changes v_unit_files v_unit_diagnostics v_unit_tests "
    "v_unit_regressions v_unit_metadata v_unit_targets v_unit_swift v_unit_builds"
)
TIMED = """timed as (select t.* from v_unit_swift t join v_unit_builds b
    on b.build_key = t.build_key where category <> 'noop'),
  slow as (select * from timed where milliseconds >= 150),
  outside as (select * from slow s where kind = 'function_body' or not exists (
    select 1 from slow b where b.kind = 'function_body' and b.build_key = s.build_key
      and b.file = s.file and s.line - b.line between 0 and 200)),
  sites as (select build_key, case when symbol is not null and kind = 'function_body'
      then 'large_function_body' else 'expression_hotspot' end as advice, file, line, target,
      milliseconds, cast(null as int) as percent
    from outside qualify row_number() over (partition by build_key
      order by milliseconds desc, file, line, column_number, kind) <= 5),
  per_file as (select build_key, coalesce(target, '') as target, file,
      sum(milliseconds) as ms from timed where file <> '' group by 1, 2, 3),
  shares as (select *, ms / sum(ms) over (partition by build_key, target) as share
    from per_file),
  filed as (select build_key, 'concentrated_file' as advice, file, 0 as line,
      nullif(target, '') as target, ms as milliseconds,
      cast(least(100, greatest(0, round(share * 100))) as int) as percent
    from shares where share >= 0.25 and ms >= 400),
  spent as (select build_key, name, sum(seconds) as seconds from v_unit_targets group by 1, 2),
  dominated as (select t.build_key, t.target, sum(milliseconds) as ms,
      max(seconds) as seconds from timed t left join spent s on s.build_key = t.build_key
      and s.name = t.target where t.target is not null group by 1, 2),
  targeted as (select build_key, 'target_dominated_by_type_checking' as advice, '' as file,
      0 as line, target, ms as milliseconds,
      cast(least(100, greatest(0, round(ms / (seconds * 1000) * 100))) as int) as percent
    from dominated where ms >= 1500 and ms / (seconds * 1000) >= 0.15),
  advised as (select * from sites union all select * from filed
    union all select * from targeted)"""


# Builds of more units are no work of one task.
LARGE_BUILD = 1_000_000


def gathered(t: Tables, run, label: str):
    """Stored rows of ``run``. Units move once, to the place of their build, and are worked
    on there; where a build has too many for one task, each step moves its rows instead."""
    sizes = t.units.groupBy("build_key").count().where(F.col("count") > LARGE_BUILD)
    if sizes.limit(1).count():
        return written(run(t), label)[0]
    # No view of units reads these two.
    t.kept["v_units"] = written_by(t.units.drop("l_tax", "l_shipdate"), "units", "build_key")
    with joined_in_place(t.spark):
        return written_by(run(t), label, "build_key", placed=True)


def matches_of(t: Tables):
    matches = intel.file_matches(t.unit_changes, t.unit_files)
    if "v_units" in t.kept:
        return written_by(matches, "matches", "build_key", placed=True)
    return written(matches, "matches")[0]


def dependents_of(t: Tables, pairs=None):
    pairs = pairs_of(t) if pairs is None else pairs
    reach = graph.closure(pairs, placed=True)
    with joined_in_place(t.spark):
        return written_by(intel.named_dependents(reach), "dependents", "build_key", placed=True)


def regressions_of(t: Tables):
    return t.unit_regressions.withColumn("caveats", F.array("caveat"))


def suites_of(t: Tables):
    matches, dependents = matches_of(t), dependents_of(t)
    downstream = intel.impact_downstream(matches, dependents)
    return intel.failing_suites(t.unit_tests, intel.candidates(matches, downstream))


def links_of(t: Tables, matches=None, dependents=None):
    matches = matches_of(t) if matches is None else matches
    dependents = dependents_of(t) if dependents is None else dependents
    return intel.evidence_links(
        matches,
        intel.impact_downstream(matches, dependents),
        regressions_of(t),
        t.unit_diagnostics,
        t.unit_changes,
        t.unit_tests,
    )


def evidence_of(t: Tables, links=None):
    links = links_of(t) if links is None else links
    return intel.evidence_chains(
        links, intel.counter_evidence(t.unit_metadata, regressions_of(t))
    )


def advice_of(t: Tables):
    return intel.advice(t.unit_swift, t.unit_targets, t.unit_builds, C.ADVICE_SITE_LIMIT)


def heavier(timings):
    """Timings of builds that spend much of their steps on type checking."""
    return timings.withColumn("milliseconds", F.col("milliseconds") * 8)


def bottlenecks_of(t: Tables, pairs=None, dependents=None):
    pairs = pairs_of(t) if pairs is None else pairs
    dependents = dependents_of(t, pairs) if dependents is None else dependents
    return intel.bottlenecks(t.unit_targets, pairs, dependents, C.BOTTLENECK_LIMIT)


BOTTLENECKS = f"""{DEPENDENTS},
  slow_targets as (select build_key, name as target, sum(seconds) as seconds
    from v_unit_targets group by 1, 2 having sum(seconds) >= 1.0),
  scored as (select s.*,
      (select count(distinct from_name) from pairs p where p.graph = s.build_key
        and p.to_name = s.target) as fan_in,
      (select count(*) from dependents d where d.build_key = s.build_key
        and d.target = s.target) as blocked_downstream from slow_targets s),
  bottlenecks as (select *, row_number() over (partition by build_key
      order by score desc, target) as position
    from (select *, seconds * (1.0 + blocked_downstream) as score from scored)
    qualify position <= 5)"""


def why_built_of(t: Tables):
    pairs = pairs_of(t)
    chains = graph.shortest_chains(t.nodes, pairs, placed=True)
    with joined_in_place(t.spark):
        answers = graph.why_built(t.nodes, pairs, chains)
        return written_by(answers, "why-built", "graph", placed=True)


def findings_of(t: Tables):
    """All results from one set of edges, one closure and one set of matches."""
    pairs, matches = pairs_of(t), matches_of(t)
    dependents = dependents_of(t, pairs)
    return intel.findings(
        intel.impacts(matches, dependents),
        bottlenecks_of(t, pairs, dependents),
        evidence_of(t, links_of(t, matches, dependents)),
        advice_of(t),
    )


def _intel(r: Registry) -> None:
    def add(name, run, prefix, sql, views=INTEL_VIEWS):
        r.add(name, run, views, f"with {prefix} {sql}")

    add(
        "changed_file_matches",
        lambda t: intel.file_matches(t.unit_changes, t.unit_files),
        MATCHES,
        "select * from matches",
    )
    add(
        "diagnostics_in_change",
        lambda t: intel.diagnostics_in_change(t.unit_diagnostics, t.unit_changes),
        RELATED,
        "select * from related",
    )
    add(
        "change_impacts",
        lambda t: intel.impacts(matches_of(t), dependents_of(t)),
        IMPACTS,
        "select * from impacts",
    )
    add(
        "impact_downstream",
        lambda t: intel.impact_downstream(matches_of(t), dependents_of(t)),
        LINKS,
        "select * from downstream_",
    )
    add(
        "named_dependents",
        lambda t: dependents_of(t),
        DEPENDENTS,
        "select * from dependents",
    )
    add(
        "bottlenecks",
        lambda t: rounded(longs(bottlenecks_of(t), "position"), "seconds", "score", digits=8),
        BOTTLENECKS,
        """select * replace (round(seconds, 8) as seconds, round(score, 8) as score)
           from bottlenecks""",
    )
    add(
        "failing_suites",
        lambda t: gathered(t, suites_of, "suites"),
        LINKS,
        "select build_key, suite, target, results from suites where n = 1",
    )
    add(
        "evidence_links",
        lambda t: longs(gathered(t, links_of, "links").drop("detail"), "weight"),
        LINKS,
        """select build_key, subject, kind, cast(weight as bigint) as weight,
             cast(repeats as bigint) as repeats from links""",
    )
    add(
        "evidence_chains",
        lambda t: longs(gathered(t, evidence_of, "evidence"), "confidence"),
        LINKS,
        """select build_key, subject, positive_links, cast(confidence as bigint) as confidence
           from kept""",
    )
    add(
        "counter_evidence",
        lambda t: intel.counter_evidence(t.unit_metadata, regressions_of(t)),
        LINKS,
        "select build_key, a as suspended, b as shifted from counters",
    )
    for name, run, table in (
        ("site_advice", lambda x: intel.site_advice(x, C.ADVICE_SITE_LIMIT), "sites"),
        ("file_advice", intel.file_advice, "filed"),
    ):
        add(
            name,
            lambda t, run=run: rounded(
                run(intel.advised_timings(t.unit_swift, t.unit_builds)),
                "milliseconds",
                digits=8,
            ),
            TIMED,
            f"""select * replace (round(milliseconds, 8) as milliseconds) from {table}""",
        )
    add(
        "target_advice",
        lambda t: rounded(
            intel.target_advice(
                intel.advised_timings(heavier(t.unit_swift), t.unit_builds), t.unit_targets
            ),
            "milliseconds",
            digits=8,
        ),
        TIMED.replace(
            "from v_unit_swift t",
            "from (select * replace (milliseconds * 8 as milliseconds) from v_unit_swift) t",
        ),
        "select * replace (round(milliseconds, 8) as milliseconds) from targeted",
    )
    add(
        "advice",
        lambda t: rounded(advice_of(t), "milliseconds", digits=8),
        TIMED,
        "select * replace (round(milliseconds, 8) as milliseconds) from advised",
    )
    add(
        "type_check_shares",
        lambda t: rounded(
            intel.type_check_shares(
                intel.advised_timings(t.unit_swift, t.unit_builds), t.unit_targets
            ),
            "milliseconds",
            "seconds",
            "share",
            digits=10,
        ),
        TIMED,
        """select build_key, target, round(ms, 10) as milliseconds, round(seconds, 10) as seconds,
             round(coalesce(ms / (seconds * 1000), 0), 10) as share from dominated""",
    )
    add(
        "sites_outside_bodies",
        lambda t: intel.outside_bodies(t.unit_swift).select(
            "build_key", "kind", "file", "line", "column_number", "milliseconds"
        ),
        TIMED.replace(
            """join v_unit_builds b
    on b.build_key = t.build_key where category <> 'noop'""",
            "",
        ),
        "select build_key, kind, file, line, column_number, milliseconds from outside",
    )
    failed = "select distinct build_key from v_unit_tests where status = 'failed'"
    slept = "select build_key from v_unit_metadata where value = 'true'"
    add(
        "change_relation",
        lambda t: intel.change_relation(
            t.unit_builds,
            t.unit_changes,
            t.unit_diagnostics,
            t.unit_tests.where("status = 'failed'"),
            t.unit_metadata.where("value = 'true'"),
        ).select("build_key", "confidence", "likely_related", F.size("evidence").alias("reasons")),
        f"""{RELATED}, s as (select b.build_key,
              exists (select 1 from related r where r.build_key = b.build_key) as d,
              exists (select 1 from v_unit_changes c where c.build_key = b.build_key
                and regexp_matches(path, '(^|/)Package\\.(swift|resolved)$')) as m,
              b.build_key in ({failed}) and b.build_key in
                (select build_key from v_unit_changes) as f,
              b.build_key in ({slept}) as x from v_unit_builds b),
            w as (select *, cast(case when d then 60 else 0 end + case when m then 20 else 0 end
              + case when f then 10 else 0 end + case when x and d then 10 else 0 end as int)
              as score from s)""",
        """select build_key, least(100, score) as confidence, case when score >= 60 then 'yes'
             when score <= 20 then 'no' else 'uncertain' end as likely_related,
             greatest(1, cast(d as int) + cast(m as int) + cast(f as int)
               + cast(x and d as int)) as reasons from w""",
    )
    add(
        "diagnostic_ownership",
        lambda t: intel.ownership(
            t.unit_diagnostics.where(F.col("file").isNotNull()).select(
                "build_key", "file", "line"
            ),
            t.blame,
            "/",
        ),
        "p as (select distinct build_key, ltrim(file, '/') as file, line from v_unit_diagnostics"
        " where file is not null)",
        """select p.build_key, p.file, p.line, author, commits from p
           join v_blame b on b.file = p.file and b.line = p.line""",
        "v_unit_diagnostics v_blame",
    )
    add(
        "findings",
        lambda t: rounded(
            gathered(t, findings_of, "findings"),
            "value",
            digits=6,
        ),
        f"""{LINKS}, {BOTTLENECKS[len(DEPENDENTS) + 1 :]}, {TIMED}""",
        """select build_key, 'impact' as result, changed_file as subject,
             coalesce(owning_target, '') as detail, cast(downstream as double) as value
             from impacts
           union all select build_key, 'bottleneck', target,
             cast(blocked_downstream as varchar), round(score, 6) from bottlenecks
           union all select build_key, 'evidence', subject, '', cast(confidence as double)
             from kept
           union all select build_key, 'advice', file || ':' || cast(line as varchar), advice,
             round(milliseconds, 6) from advised""",
    )
