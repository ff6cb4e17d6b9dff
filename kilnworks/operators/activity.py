"""Activity sections to steps, targets, phases and files (BI-11, BI-12, AG-32..39).

``sections(build_key, section_id, parent_id, ord, title, signature, subtitle,
time_started, time_stopped, was_fetched_from_cache, localized_result_string,
document_url)`` is one row per section, times in seconds of the Apple epoch,
``ord`` the pre-order place. ``messages(build_key, section_id, message_no, title,
severity, document_url, line, column_number)`` holds the messages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import activity as A
from ..functions.loglines import swift_timing_message
from ..runtime import joined_in_place, written, written_by
from .logs import deduplicated, with_fingerprint

BUILD = ["build_key"]
OWNERS = ("wrapper_id", "wrapper_name", "tagged_id", "tagged_name")
# Builds of more sections climb by section, with a shuffle a round, others in place.
LARGE_BUILD = 1_000_000


def exploded_messages(sections: DataFrame) -> DataFrame:
    """The message table of sections that carry ``messages`` as an array."""
    item = F.posexplode("messages").alias("message_no", "_m")
    return sections.select("build_key", "section_id", item).select(
        "build_key",
        "section_id",
        "message_no",
        "_m.title",
        "_m.severity",
        "_m.document_url",
        "_m.line",
        F.col("_m.column").alias("column_number"),
    )


def _flagged(sections: DataFrame) -> DataFrame:
    """Adds the name that a section gives as a target wrapper, or by a target tag."""
    return sections.withColumns(
        {
            "_wraps": A.wrapper_target(F.col("title")),
            "_tags": A.step_target(F.col("signature"), F.col("title")),
        }
    )


def _started(flagged: DataFrame) -> DataFrame:
    own = F.col("section_id")
    return flagged.where(own.isNotNull()).select(
        "build_key",
        "section_id",
        F.col("parent_id").alias("above"),
        F.when(F.col("_wraps").isNotNull(), own).alias("wrapper_id"),
        F.col("_wraps").alias("wrapper_name"),
        F.when(F.col("_tags").isNotNull(), own).alias("tagged_id"),
        F.col("_tags").alias("tagged_name"),
        own.alias("least"),
        F.lit(None).cast("string").alias("reject"),
    )


def _higher(rows: DataFrame, among: DataFrame) -> DataFrame:
    """One round: rows that point to a section above go on to where that one points."""
    upper = among.select(
        "build_key",
        F.col("section_id").alias("above"),
        F.col("above").alias("_above"),
        F.col("least").alias("_least"),
        F.col("reject").alias("_reject"),
        *(F.col(name).alias(f"_{name}") for name in OWNERS),
        F.lit(True).alias("_there"),
    )
    # A section stands once on a way up: the least of one stretch is not met again.
    met_twice = F.col("least") == F.col("_least")
    reject = (
        F.when(F.col("above").isNull(), F.col("reject"))
        .when(F.col("_there").isNull(), "orphan")
        .when(met_twice, "loop")
        .otherwise(F.col("_reject"))
    )
    above = F.when(reject.isNull(), F.col("_above"))
    return rows.join(upper.hint("merge"), ["build_key", "above"], "left").select(
        "build_key",
        "section_id",
        above.alias("above"),
        *(F.coalesce(f"_{name}", name).alias(name) for name in OWNERS),
        F.when(above.isNotNull(), F.least("least", "_least")).alias("least"),
        reject.alias("reject"),
    )


def _climbed_in_place(state: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Like :func:`climbed`, of started sections in buckets of their build.

    Each round stores all rows: a union of rounds would not lie in buckets any more.
    """
    while state.where(F.col("above").isNotNull()).limit(1).count():
        state = store(_higher(state, state))
    return state.select("build_key", "section_id", *OWNERS, "reject")


def _apart(sections: DataFrame, large: int) -> tuple[Column, bool]:
    """Whether a section's build has no more than ``large`` of them, and if any has more."""
    counts = sections.groupBy(*BUILD).count().where(F.col("count") > large)
    # At most one key for so many sections; those without a build join nothing.
    many = [row.build_key for row in counts.dropna().select(*BUILD).collect()]
    here = ~F.coalesce(F.col("build_key").isin(many), F.lit(False)) if many else F.lit(True)
    return here, bool(many)


def _stored_climb(rows: DataFrame, label: str = "section-climb") -> DataFrame:
    return written_by(rows, label, "build_key", placed=True)


def climbed_by_build(sections: DataFrame, large: int = LARGE_BUILD) -> DataFrame:
    """Like :func:`climbed`: what a climb reads of the sections moves once, to the place of
    their build, if it doesn't lie there already, and climbs there. Builds of more than
    ``large`` sections climb by section."""
    with joined_in_place(sections.sparkSession):
        here, many = _apart(sections, large)
        started = written_by(_started(_flagged(sections.where(here))), "section-flags", "build_key")
        climb = _climbed_in_place(started, _stored_climb)
    if not many:
        return climb
    return climb.unionByName(climbed(written(sections.where(~here), "large-sections")[0]))


def owned_sections(
    sections: DataFrame, large: int = LARGE_BUILD, again: bool = True
) -> tuple[DataFrame, DataFrame]:
    """BI-11: sections with their owners, see :func:`owned`, and all as they are, stored.

    Sections move once, to the place of their build, and climb there; they don't move at
    all if they lie there already. Builds of more than ``large`` sections are no work of
    one task: theirs climb by section. Owners that are read ``again`` are stored as well,
    else found in place by the one that reads them.
    """
    with joined_in_place(sections.sparkSession):
        here, many = _apart(sections, large)
        flagged = written_by(_flagged(sections.where(here)), "sections", "build_key")
        small = flagged.drop("_wraps", "_tags")
        climb = _climbed_in_place(_started(flagged), _stored_climb)
        found = owned(walked(small, climb), climb)
        stored = _stored_climb(found, "owned") if again else found
    if not many:
        return stored, small
    rest = written(sections.where(~here), "large-sections")[0]
    climbed_alone = written(owned(walked(rest)), "large-owned")[0]
    return stored.unionByName(climbed_alone), small.unionByName(rest)


def climbed(sections: DataFrame) -> DataFrame:
    """BI-11: (build_key, section_id, wrapper_id, wrapper_name, tagged_id, tagged_name,
    reject): the topmost section on the way from the root that is a target wrapper, or
    that carries a target tag.

    Every section climbs by a pointer to its parent that doubles its length each round,
    so a tree of depth d takes log2(d) rounds. ``reject`` says why a section has no way
    to a root: ``orphan`` below a parent that is not there, ``loop`` on or below a
    circle of parents. ``sections`` should be a stored table.
    """
    # The patterns run once; each round reads ids and names only.
    state, _ = written(_started(_flagged(sections)), "section-flags")
    done = state.where(F.col("above").isNull())
    open_ = state.where(F.col("above").isNotNull())
    while open_.limit(1).count():
        state, _ = written(_higher(open_, done.unionByName(open_)), "section-climb")
        done = done.unionByName(state.where(F.col("above").isNull()))
        open_ = state.where(F.col("above").isNotNull())
    return done.select("build_key", "section_id", *OWNERS, "reject")


def walked(sections: DataFrame, climb: DataFrame | None = None) -> DataFrame:
    """BI-11: sections that have a way to a root, with what :func:`climbed` found."""
    climb = climbed(sections) if climb is None else climb
    found = climb.where(F.col("reject").isNull()).drop("reject")
    return sections.join(found.hint("merge"), ["build_key", "section_id"])


def rejected_sections(climb: DataFrame) -> DataFrame:
    """BI-11: sections without a way to a root, with the reason."""
    return climb.where(F.col("reject").isNotNull()).select("build_key", "section_id", "reject")


def owned(walk: DataFrame, climb: DataFrame | None = None) -> DataFrame:
    """Adds ``target_id``, ``target`` and ``role`` (root, target, step or phase).

    A build without any wrapper falls back to tags: a topmost tagged section
    owns its subtree and is itself a step; its sections stay phases as well.
    The wrapped builds are read from ``climb`` if it is given, which saves a join.
    """
    ways = walk if climb is None else climb.where(F.col("reject").isNull())
    nested = ways.where(F.col("wrapper_id").isNotNull()).select("build_key").distinct()
    marked = walk.join(nested.withColumn("_nested", F.lit(True)).hint("merge"), BUILD, "left")
    wraps = F.coalesce("_nested", F.lit(False))
    return marked.select(
        *(c for c in walk.columns),
        wraps.alias("wrapped_build"),
        F.when(wraps, F.col("wrapper_id")).otherwise(F.col("tagged_name")).alias("target_id"),
        F.when(wraps, F.col("wrapper_name")).otherwise(F.col("tagged_name")).alias("target"),
        F.when(F.col("parent_id").isNull(), F.lit("root"))
        .when(wraps & (F.col("wrapper_id") == F.col("section_id")), F.lit("target"))
        .when(wraps & F.col("wrapper_id").isNotNull(), F.lit("step"))
        .when(~wraps & F.col("tagged_id").isNotNull(), F.lit("step"))
        .otherwise(F.lit("phase"))
        .alias("role"),
    )


def build_facts(sections: DataFrame) -> DataFrame:
    """The root section of each build, with scheme and platform (SF-18, SF-19)."""
    root = sections.where(F.col("parent_id").isNull()).select(
        "build_key",
        "section_id",
        A.verdict(F.col("localized_result_string")).alias("status"),
        A.apple_to_unix(F.col("time_started")).alias("started_at"),
        A.apple_to_unix(F.col("time_stopped")).alias("ended_at"),
        A.duration(F.col("time_started"), F.col("time_stopped")).alias("total_seconds"),
    )
    named = (
        sections.where(F.contains("subtitle", F.lit("Scheme ")))
        .groupBy("build_key", F.col("parent_id").alias("section_id"))
        .agg(F.min_by("subtitle", "ord").alias("_subtitle"))
    )
    return root.join(named, ["build_key", "section_id"], "left").select(
        "build_key",
        "status",
        "started_at",
        "ended_at",
        "total_seconds",
        A.labelled(F.col("_subtitle"), "Scheme ").alias("scheme"),
        A.labelled(F.col("_subtitle"), "Destination ").alias("platform"),
    )


def steps(owned_sections: DataFrame, builds: DataFrame) -> DataFrame:
    """Every step with its type, file, architecture and executed flag (SF-14..22)."""
    signature, title = F.col("signature"), F.col("title")
    started = A.apple_to_unix(F.col("time_started"))
    own = owned_sections.where(F.col("role") == "step").select(
        "build_key",
        "section_id",
        "ord",
        "target_id",
        "target",
        "title",
        "signature",
        A.step_type(signature, title).alias("step_type"),
        A.step_file(F.col("document_url"), signature).alias("file"),
        A.step_architecture(signature, title).alias("architecture"),
        F.coalesce(
            A.duration(F.col("time_started"), F.col("time_stopped")), F.lit(0.0)
        ).alias("seconds"),
        started.alias("started_at"),
        A.apple_to_unix(F.col("time_stopped")).alias("ended_at"),
        F.col("was_fetched_from_cache").alias("fetched_from_cache"),
    )
    begun = builds.select("build_key", F.col("started_at").alias("_begun"))
    return (
        own.join(begun, BUILD, "left")
        .withColumn("executed", A.executed(F.col("started_at"), F.col("_begun")))
        .withColumn(
            "fingerprint",
            A.step_fingerprint(
                *(F.col(c) for c in ("step_type", "target", "architecture", "file", "signature"))
            ),
        )
        .drop("_begun", "signature")
    )


def replayed_steps(step_rows: DataFrame) -> DataFrame:
    """SF-22: replayed steps per build."""
    return step_rows.groupBy(*BUILD).agg(F.count_if(~F.col("executed")).alias("replayed_steps"))


def target_spans(owned_sections: DataFrame) -> DataFrame:
    """Targets with their duration: the wrapper's own, or (AG-38) the span from the
    first start to the last end of the tagged sections, never their sum."""
    wrapper = owned_sections.where(F.col("role") == "target").select(
        "build_key",
        "target_id",
        "target",
        F.coalesce(
            A.duration(F.col("time_started"), F.col("time_stopped")), F.lit(0.0)
        ).alias("seconds"),
        A.apple_to_unix(F.col("time_started")).alias("started_at"),
        A.apple_to_unix(F.col("time_stopped")).alias("ended_at"),
        F.col("ord").alias("first_seen"),
    )
    tagged = owned_sections.where(
        ~F.col("wrapped_build") & (F.col("tagged_id") == F.col("section_id"))
    )
    begin, end = F.min("time_started"), F.max("time_stopped")
    span = tagged.groupBy("build_key", "target_id", "target").agg(
        F.coalesce(A.duration(begin, end), F.lit(0.0)).alias("seconds"),
        F.when(end >= begin, A.apple_to_unix(begin)).alias("started_at"),
        F.when(end >= begin, A.apple_to_unix(end)).alias("ended_at"),
        F.min("ord").alias("first_seen"),
    )
    return wrapper.unionByName(span)


def _relevant() -> Column:
    return F.col("executed") & ~F.col("step_type").isin(*C.NON_COMPILATION_STEPS)


def target_results(step_rows: DataFrame, spans: DataFrame) -> DataFrame:
    """AG-32, AG-33: category, compile count and cache flag of each target."""
    fresh = _relevant() & ~F.col("fetched_from_cache")
    counts = step_rows.groupBy("build_key", "target_id").agg(
        F.count_if(_relevant()).alias("_relevant"),
        F.count_if(fresh).alias("_compiled"),
        F.count_if("executed").alias("_executed"),
        F.count_if(F.col("executed") & F.col("fetched_from_cache")).alias("_cached"),
    )
    joined = spans.join(counts, ["build_key", "target_id"], "left").withColumns(
        {
            c: F.coalesce(c, F.lit(0))
            for c in ("_relevant", "_compiled", "_executed", "_cached")
        }
    )
    return joined.select(
        "build_key",
        "target_id",
        F.col("target").alias("name"),
        "seconds",
        "started_at",
        "ended_at",
        "first_seen",
        F.when(F.col("_compiled") == 0, F.lit("noop"))
        .when(F.col("_compiled") == F.col("_relevant"), F.lit("clean"))
        .otherwise(F.lit("incremental"))
        .alias("category"),
        F.col("_compiled").alias("compiled_count"),
        ((F.col("_executed") > 0) & (F.col("_cached") == F.col("_executed"))).alias(
            "fetched_from_cache"
        ),
        F.col("_executed").alias("executed_steps"),
        F.col("_cached").alias("cached_steps"),
    )


def build_results(builds: DataFrame, targets: DataFrame) -> DataFrame:
    """AG-34, AG-35: category, compile count, cache rate and status of each build."""
    totals = targets.groupBy(*BUILD).agg(
        F.count(F.lit(1)).alias("_targets"),
        F.count_if(F.col("category") == "noop").alias("_noop"),
        F.count_if(F.col("category") == "clean").alias("_clean"),
        F.sum("compiled_count").alias("_compiled"),
        F.sum("executed_steps").alias("_steps"),
        F.sum("cached_steps").alias("_cached"),
    )
    joined = builds.join(totals, BUILD, "left")
    steps_run = F.coalesce("_steps", F.lit(0))
    return joined.select(
        *builds.columns,
        F.when(F.col("_targets").isNull(), F.lit("unknown"))
        .when(F.col("_noop") == F.col("_targets"), F.lit("noop"))
        .when(F.col("_clean") > F.floor(F.col("_targets") / 2), F.lit("clean"))
        .otherwise(F.lit("incremental"))
        .alias("category"),
        F.coalesce("_compiled", F.lit(0)).alias("compiled_count"),
        F.when(steps_run > 0, F.try_divide("_cached", "_steps")).alias("cache_hit_rate"),
        F.when(steps_run == 0, F.lit("unknown"))
        .when(F.col("_cached") == F.col("_steps"), F.lit("warm"))
        .when(F.col("_cached") > 0, F.lit("partial"))
        .otherwise(F.lit("cold"))
        .alias("cache_status"),
    )


def phases(owned_sections: DataFrame) -> DataFrame:
    """AG-36: sections outside targets with a duration and a title, by title."""
    seconds = A.duration(F.col("time_started"), F.col("time_stopped"))
    outside = (F.col("role") == "phase") | (
        ~F.col("wrapped_build") & F.col("parent_id").isNotNull()
    )
    rows = owned_sections.where(outside & (seconds > 0) & (F.length("title") > 0))
    return rows.groupBy("build_key", F.col("title").alias("name")).agg(
        F.sum(seconds).alias("seconds"),
        F.min(A.apple_to_unix(F.col("time_started"))).alias("started_at"),
        F.max(A.apple_to_unix(F.col("time_stopped"))).alias("ended_at"),
    )


def files(step_rows: DataFrame) -> DataFrame:
    """AG-37: per (file, step type, architecture) the slowest run and the count."""
    rows = step_rows.where(F.col("file").isNotNull() & (F.col("seconds") > 0))
    slowest = F.struct("seconds", -F.col("ord"))
    return rows.groupBy("build_key", "file", "step_type", "architecture").agg(
        F.max("seconds").alias("seconds"),
        F.max_by("target", slowest).alias("target"),
        F.count(F.lit(1)).alias("occurrences"),
    )


def architectures(file_rows: DataFrame) -> DataFrame:
    """AG-41: the architectures of a build that has at least two."""
    named = file_rows.where(F.length("architecture") > 0)
    return (
        named.select("build_key", "architecture")
        .distinct()
        .groupBy("build_key")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.array_join(F.array_sort(F.collect_list("architecture")), ", ").alias("names"),
        )
        .where(F.col("count") >= 2)
    )


def step_messages(owned_sections: DataFrame, messages: DataFrame) -> DataFrame:
    """BI-12: messages of steps that are warnings or errors."""
    own = owned_sections.where(F.col("role") == "step").select(
        "build_key", "section_id", "ord", "target"
    )
    return (
        messages.where(F.col("severity") >= 1)
        .join(own, ["build_key", "section_id"])
        .select(
            "build_key",
            "ord",
            "message_no",
            F.when(F.col("severity") >= 2, F.lit("error"))
            .otherwise(F.lit("warning"))
            .alias("severity"),
            A.strip_file_url(F.col("document_url")).alias("file"),
            F.col("line").cast("bigint").alias("line"),
            F.col("column_number").cast("bigint").alias("column"),
            F.col("title").alias("message"),
            "target",
        )
    )


def message_totals(step_message_rows: DataFrame) -> DataFrame:
    """AG-39: warnings and errors of each build."""
    return step_message_rows.groupBy(*BUILD).agg(
        F.count_if(F.col("severity") == "error").alias("error_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
    )


def activity_diagnostics(step_message_rows: DataFrame) -> DataFrame:
    """AG-23, activity path: classified and de-duplicated like log lines."""
    ordered = with_fingerprint(step_message_rows).withColumn(
        "_order", F.struct("ord", "message_no")
    )
    return deduplicated(ordered, "_order", BUILD).drop("first_seen")


def swift_timings(owned_sections: DataFrame, messages: DataFrame) -> DataFrame:
    """SF-13 over section messages; sections outside targets name no target.

    In a build without wrappers every section is also read as a phase, so a
    step's report appears once without and once with its target.
    """
    reports = messages.withColumn("_s", swift_timing_message(F.col("title"))).where(
        F.col("_s").isNotNull()
    )
    step, root = F.col("role") == "step", F.col("parent_id").isNull()
    flat_step = step & ~F.col("wrapped_build")
    nothing = F.lit(None).cast("string")
    readers = owned_sections.where(~root).select(
        "build_key",
        "section_id",
        F.explode(
            F.when(flat_step, F.array(nothing, F.col("target")))
            .when(step, F.array(F.col("target")))
            .otherwise(F.array(nothing))
        ).alias("target"),
    )
    return reports.join(readers, ["build_key", "section_id"]).select(
        "build_key",
        "section_id",
        "message_no",
        "_s.kind",
        A.strip_file_url(F.coalesce("document_url", F.lit(""))).alias("file"),
        F.coalesce(F.col("line"), F.lit(0)).cast("bigint").alias("line"),
        F.coalesce(F.col("column_number"), F.lit(0)).cast("bigint").alias("column_number"),
        "_s.symbol",
        "_s.milliseconds",
        "target",
    )


def usable_builds(
    builds: DataFrame,
    targets: DataFrame,
    phase_rows: DataFrame,
    file_rows: DataFrame,
    timings: DataFrame,
    warnings: DataFrame,
) -> DataFrame:
    """PF-4, PF-5, PF-6: flags per build.

    ``builds`` needs build_key, total_seconds and compiled_count; ``warnings``
    is (build_key, warning).
    """

    def count(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*BUILD).agg(F.count(F.lit(1)).alias(name))

    setup = F.lit(False)
    for title in C.SETUP_PHASES:
        setup = setup | F.startswith("name", F.lit(title))
    per_phase = phase_rows.groupBy(*BUILD).agg(
        F.count(F.lit(1)).alias("_phases"), F.bool_and(setup).alias("_setup")
    )
    aborted = F.lit(False)
    for marker in C.PARTIAL_DECODE_MARKERS:
        aborted = aborted | F.contains("warning", F.lit(marker))
    cut = warnings.groupBy(*BUILD).agg(F.bool_or(aborted).alias("_aborted"))
    joined = builds.select("build_key", "total_seconds", "compiled_count")
    for part in (
        count(targets, "_targets"),
        count(file_rows, "_files"),
        count(timings, "_timings"),
        per_phase,
        cut,
    ):
        joined = joined.join(part, BUILD, "left")
    none = {c: F.coalesce(c, F.lit(0)) for c in ("_targets", "_files", "_timings", "_phases")}
    bare = (none["_targets"] == 0) & (none["_files"] == 0) & (F.col("compiled_count") == 0)
    no_work = bare & (none["_phases"] > 0) & F.coalesce("_setup", F.lit(False))
    partial = bare & F.coalesce("_aborted", F.lit(False))
    measured = (none["_files"] > 0) | (none["_timings"] > 0)
    timed = F.col("total_seconds").isNotNull() & (
        (none["_targets"] > 0) | (none["_phases"] > 0)
    )
    return joined.select(
        "build_key",
        no_work.alias("setup_only"),
        partial.alias("decoded_partially"),
        (measured | (~no_work & ~partial & timed)).alias("usable"),
    )


def prefer(first: DataFrame, second: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """J-13: rows of ``first``; for keys it lacks, rows of ``second``."""
    keys = keys or BUILD
    missing = second.join(first.select(*keys).distinct(), keys, "left_anti")
    return first.unionByName(missing, allowMissingColumns=True)


def swift_site_totals(timings: DataFrame) -> DataFrame:
    """AG-40: cost of each location over all its compilations."""
    # Of symbols of one place the least, whatever the order of rows.
    named = F.when(F.col("symbol").isNotNull(), F.struct("ord", "symbol"))
    return (
        timings.groupBy("build_key", "file", "line", "column_number")
        .agg(
            F.sum("milliseconds").alias("milliseconds"),
            F.count(F.lit(1)).alias("occurrences"),
            F.min_by("symbol", named).alias("symbol"),
        )
        .orderBy("build_key", F.desc("milliseconds"), "file", "line", "column_number")
    )
