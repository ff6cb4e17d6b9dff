"""Build intelligence over many builds at once (BI-2..BI-10, BI-13, J-8..J-11, J-14).

All inputs carry ``build_key``. ``changed_files(build_key, position, path)`` lists
the files of a change; ``files(build_key, file, step_type, architecture, target,
seconds)`` the compiled files; graphs come as the pairs and closure of
:mod:`kilnworks.operators.graph`, keyed by build.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import paths
from ..functions.text import slashes, strip
from .graph import by_name
from .ordered import top_per_key

BUILD = ["build_key"]


def file_matches(changed: DataFrame, files: DataFrame) -> DataFrame:
    """J-8: the compiled file of each changed file, slowest first; every changed
    file keeps one row, ``none`` when nothing matches.

    The join key is the file's base name; the suffix rule is a residual.
    """
    left = changed.withColumn("_base", paths.basename(F.col("path")))
    right = files.select(
        *BUILD,
        paths.basename(F.col("file")).alias("_base"),
        F.col("file").alias("_file"),
        F.col("target").alias("_target"),
        F.struct(
            (-F.col("seconds")).alias("s"), "file", "step_type", "architecture"
        ).alias("_order"),
    )
    kind = F.when(slashes(F.col("_file")) == slashes(F.col("path")), F.lit("exact")).otherwise(
        F.lit("suffix")
    )
    hits = (
        left.join(right, [*BUILD, "_base"])
        .where(paths.same_file(F.col("_file"), F.col("path")))
        .groupBy(*BUILD, "position", "path")
        .agg(
            F.min_by(
                F.struct(kind.alias("kind"), F.col("_target").alias("target")), "_order"
            ).alias("_hit")
        )
    )
    return changed.join(hits, [*BUILD, "position", "path"], "left").select(
        *BUILD,
        "position",
        F.col("path").alias("changed_file"),
        F.coalesce("_hit.kind", F.lit("none")).alias("match_kind"),
        F.col("_hit.target").alias("owning_target"),
    )


def diagnostics_in_change(diagnostics: DataFrame, changed: DataFrame) -> DataFrame:
    """J-9: diagnostics whose file is one of the changed files."""
    left = diagnostics.where(F.col("file").isNotNull()).withColumn(
        "_base", paths.basename(F.col("file"))
    )
    right = changed.select(
        F.col("build_key").alias("_build"),
        paths.basename(F.col("path")).alias("_other"),
        F.col("path").alias("_path"),
    )
    same = (
        (F.col("build_key") == F.col("_build"))
        & (F.col("_base") == F.col("_other"))
        & paths.same_file(F.col("file"), F.col("_path"))
    )
    return left.join(right, same, "left_semi").drop("_base")


def named_dependents(reach: DataFrame) -> DataFrame:
    """SO-3: dependents by bare name, united over same-named targets."""
    return (
        reach.where(F.col("src") != F.col("dst"))
        .select(
            F.col("graph").alias("build_key"),
            F.col("dst.name").alias("target"),
            F.col("src.name").alias("dependent"),
        )
        .distinct()
    )


def impacts(matches: DataFrame, dependents: DataFrame) -> DataFrame:
    """BI-2: one row per changed file with the number of targets downstream."""
    blocked = dependents.groupBy(*BUILD, "target").agg(F.count(F.lit(1)).alias("downstream"))
    return matches.join(
        blocked.withColumnRenamed("target", "owning_target"), [*BUILD, "owning_target"], "left"
    ).select(*matches.columns, F.coalesce("downstream", F.lit(0)).alias("downstream"))


def impact_downstream(matches: DataFrame, dependents: DataFrame) -> DataFrame:
    """BI-2: the downstream targets of each changed file, one per row."""
    return matches.join(
        dependents.withColumnRenamed("target", "owning_target"), [*BUILD, "owning_target"]
    ).select(*BUILD, "position", "changed_file", F.col("dependent").alias("downstream_target"))


def bottlenecks(
    targets: DataFrame, pairs: DataFrame, dependents: DataFrame, limit: int
) -> DataFrame:
    """BI-3: slow targets by the work they hold up, the first of each build."""
    slow = (
        targets.groupBy(*BUILD, F.col("name").alias("target"))
        .agg(F.sum("seconds").alias("seconds"))
        .where(F.col("seconds") >= C.BOTTLENECK_MIN_SECONDS)
    )
    blocked = dependents.groupBy(*BUILD, "target").agg(F.count(F.lit(1)).alias("_blocked"))
    near = (
        pairs.select(
            F.col("graph").alias("build_key"),
            F.col("dst.name").alias("target"),
            F.col("src.name").alias("_by"),
        )
        .distinct()
        .groupBy(*BUILD, "target")
        .agg(F.count(F.lit(1)).alias("_near"))
    )
    scored = (
        slow.join(blocked, [*BUILD, "target"], "left")
        .join(near, [*BUILD, "target"], "left")
        .select(
            *BUILD,
            "target",
            "seconds",
            F.coalesce("_near", F.lit(0)).alias("fan_in"),
            F.coalesce("_blocked", F.lit(0)).alias("blocked_downstream"),
        )
        .withColumn("score", F.col("seconds") * (1.0 + F.col("blocked_downstream")))
    )
    order = [F.desc("score"), F.asc("target")]
    return top_per_key(scored, BUILD, order, limit, "position")


# Evidence


def _stem(suite: Column) -> Column:
    return F.regexp_replace(F.lower(strip(suite)), "tests$", "")


def candidates(matches: DataFrame, downstream: DataFrame) -> DataFrame:
    """SO-5: owners in order, then their downstream targets in order."""
    owners = matches.where(F.col("owning_target").isNotNull()).select(
        *BUILD,
        F.col("owning_target").alias("target"),
        F.struct(F.lit(0).alias("tier"), "position", F.lit("").alias("name")).alias("place"),
    )
    rest = downstream.select(
        *BUILD,
        F.col("downstream_target").alias("target"),
        F.struct(
            F.lit(1).alias("tier"), "position", F.col("downstream_target").alias("name")
        ).alias("place"),
    )
    return owners.unionByName(rest)


def failing_suites(tests: DataFrame, candidate_targets: DataFrame) -> DataFrame:
    """J-10: the first candidate whose name is the suite's stem, per failed result.

    Candidates are reduced to one per stem before the join.
    """
    first = (
        candidate_targets.withColumn("_stem", F.lower(strip(F.col("target"))))
        .where(F.length("_stem") > 0)
        .groupBy(*BUILD, "_stem")
        .agg(F.min_by("target", "place").alias("target"))
    )
    failed = (
        tests.where(F.col("status") == "failed")
        .withColumn("_stem", _stem(F.col("suite")))
        .groupBy(*BUILD, "suite", "_stem")
        .agg(F.count(F.lit(1)).alias("results"))
    )
    return failed.join(first, [*BUILD, "_stem"]).select(*BUILD, "suite", "target", "results")


def evidence_links(
    matches: DataFrame,
    downstream: DataFrame,
    regressions: DataFrame,
    diagnostics: DataFrame,
    changed: DataFrame,
    tests: DataFrame,
) -> DataFrame:
    """BI-4, positive links: (build_key, subject, kind, weight, detail, repeats)."""
    one = F.lit(1).cast("bigint")
    by_file = matches.where(
        F.col("owning_target").isNotNull() & F.col("match_kind").isin("exact", "suffix")
    ).select(
        *BUILD,
        F.col("owning_target").alias("subject"),
        F.lit("changed_file").alias("kind"),
        F.when(F.col("match_kind") == "exact", C.EVIDENCE_EXACT)
        .otherwise(C.EVIDENCE_SUFFIX)
        .alias("weight"),
        F.col("changed_file").alias("detail"),
        one.alias("repeats"),
    )
    weight = F.when(F.col("confidence") == "high", C.EVIDENCE_REGRESSION["high"]).when(
        F.col("confidence") == "medium", C.EVIDENCE_REGRESSION["medium"]
    )
    by_regression = regressions.where(F.col("metric_kind") == "target").select(
        *BUILD,
        F.col("name").alias("subject"),
        F.lit("regression").alias("kind"),
        weight.otherwise(C.EVIDENCE_REGRESSION["low"]).alias("weight"),
        F.lit("").alias("detail"),
        one.alias("repeats"),
    )
    related = diagnostics_in_change(diagnostics, changed)
    owner = _first_impact(related, matches)
    by_diagnostic = (
        related.join(owner, [*BUILD, "fingerprint"], "left")
        .withColumn("subject", F.coalesce("target", "_owner"))
        .where(F.col("subject").isNotNull())
        .select(
            *BUILD,
            "subject",
            F.lit("diagnostic").alias("kind"),
            F.lit(C.EVIDENCE_DIAGNOSTIC).alias("weight"),
            slashes(F.col("file")).alias("detail"),
            one.alias("repeats"),
        )
    )
    by_suite = failing_suites(tests, candidates(matches, downstream)).select(
        *BUILD,
        F.col("target").alias("subject"),
        F.lit("failing_suite").alias("kind"),
        F.lit(C.EVIDENCE_SUITE).alias("weight"),
        F.col("suite").alias("detail"),
        F.col("results").alias("repeats"),
    )
    links = by_file.unionByName(by_regression).unionByName(by_diagnostic)
    return links.unionByName(by_suite)


def _first_impact(diagnostics: DataFrame, matches: DataFrame) -> DataFrame:
    """Owner of the first changed file that a diagnostic without a target points at."""
    left = diagnostics.where(F.col("target").isNull()).select(
        *BUILD, "fingerprint", "file", paths.basename(F.col("file")).alias("_base")
    )
    right = matches.select(
        *BUILD,
        paths.basename(F.col("changed_file")).alias("_base"),
        "changed_file",
        "position",
        "owning_target",
    )
    return (
        left.join(right, [*BUILD, "_base"])
        .where(paths.same_file(F.col("file"), F.col("changed_file")))
        .groupBy(*BUILD, "fingerprint")
        .agg(F.min_by("owning_target", F.struct("position", "changed_file")).alias("_owner"))
    )


def counter_evidence(metadata: DataFrame, regressions: DataFrame) -> DataFrame:
    """BI-4, counters: one row per build with a suspended machine or a changed environment."""
    slept = metadata.where(
        (F.col("key") == "build.was_suspended") & (F.col("value") == "true")
    ).select(*BUILD, F.lit(C.EVIDENCE_SUSPENDED).alias("suspended"), F.lit(0).alias("shifted"))
    shifted = regressions.where(
        F.array_contains("caveats", F.lit("environment_shifted"))
    ).select(*BUILD, F.lit(0).alias("suspended"), F.lit(C.EVIDENCE_ENVIRONMENT).alias("shifted"))
    return (
        slept.unionByName(shifted)
        .groupBy(*BUILD)
        .agg(F.min("suspended").alias("suspended"), F.min("shifted").alias("shifted"))
    )


def evidence_chains(links: DataFrame, counters: DataFrame) -> DataFrame:
    """BI-4: subjects with enough evidence; confidence is the clamped sum."""
    summed = links.groupBy(*BUILD, "subject").agg(
        F.sum(F.col("weight") * F.col("repeats")).alias("_positive"),
        F.sum("repeats").alias("positive_links"),
    )
    raw = (
        F.col("_positive")
        + F.coalesce("suspended", F.lit(0))
        + F.coalesce("shifted", F.lit(0))
    )
    return (
        summed.join(counters, BUILD, "left")
        .withColumn("_raw", raw)
        .where(
            (F.col("_raw") >= C.EVIDENCE_MIN_CONFIDENCE)
            & (F.col("positive_links") >= C.EVIDENCE_MIN_POSITIVE)
        )
        .select(
            *BUILD,
            "subject",
            "positive_links",
            F.least(F.lit(100), F.greatest(F.lit(0), F.col("_raw"))).alias("confidence"),
        )
    )


# Advice


def percent(share: Column) -> Column:
    """SF-34."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.round(share * 100))).cast("int")


def advised_timings(timings: DataFrame, builds: DataFrame) -> DataFrame:
    """BI-8: timings of builds that compiled something."""
    idle = builds.where(F.col("category") == "noop").select(*BUILD)
    return timings.join(idle, BUILD, "left_anti")


def outside_bodies(timings: DataFrame) -> DataFrame:
    """J-11: slow sites, without expressions inside a slow body of the same file."""
    slow = timings.where(F.col("milliseconds") >= C.ADVICE_SITE_MS)
    bodies = slow.where(F.col("kind") == "function_body").select(
        F.col("build_key").alias("_build"),
        F.col("file").alias("_file"),
        F.col("line").alias("_line"),
    ).distinct()
    inside = (
        (F.col("build_key") == F.col("_build"))
        & (F.col("file") == F.col("_file"))
        & (F.col("line") - F.col("_line")).between(0, C.ADVICE_BODY_LINES)
    )
    body = F.col("kind") == "function_body"
    return slow.where(body).unionByName(slow.where(~body).join(bodies, inside, "left_anti"))


def site_advice(timings: DataFrame, limit: int) -> DataFrame:
    """BI-5: the slowest remaining sites of each build."""
    order = [F.desc("milliseconds"), *map(F.asc, ("file", "line", "column_number", "kind"))]
    kept = top_per_key(outside_bodies(timings), BUILD, order, limit)
    named = F.col("symbol").isNotNull() & (F.col("kind") == "function_body")
    return kept.select(
        *BUILD,
        F.when(named, F.lit("large_function_body"))
        .otherwise(F.lit("expression_hotspot"))
        .alias("advice"),
        "file",
        "line",
        "target",
        "milliseconds",
        F.lit(None).cast("int").alias("percent"),
    )


def file_advice(timings: DataFrame) -> DataFrame:
    """BI-6: files with a large share of their target's type-checking time."""
    per_file = (
        timings.where(F.length("file") > 0)
        .groupBy(*BUILD, F.coalesce("target", F.lit("")).alias("_target"), "file")
        .agg(F.sum("milliseconds").alias("milliseconds"))
    )
    per_target = per_file.groupBy(*BUILD, "_target").agg(F.sum("milliseconds").alias("_total"))
    share = F.when(F.col("_total") > 0, F.col("milliseconds") / F.col("_total")).otherwise(0.0)
    return (
        per_file.join(per_target, [*BUILD, "_target"])
        .withColumn("_share", share)
        .where(
            (F.col("_share") >= C.ADVICE_FILE_SHARE)
            & (F.col("milliseconds") >= C.ADVICE_FILE_MS)
        )
        .select(
            *BUILD,
            F.lit("concentrated_file").alias("advice"),
            "file",
            F.lit(0).alias("line"),
            F.nullif(F.col("_target"), F.lit("")).alias("target"),
            "milliseconds",
            percent(F.col("_share")).alias("percent"),
        )
    )


def type_check_shares(timings: DataFrame, targets: DataFrame) -> DataFrame:
    """J-14: type-checking time beside the seconds of the same-named targets."""
    checked = (
        timings.where(F.col("target").isNotNull())
        .groupBy(*BUILD, "target")
        .agg(F.sum("milliseconds").alias("milliseconds"))
    )
    spent = targets.groupBy(*BUILD, F.col("name").alias("target")).agg(
        F.sum("seconds").alias("seconds")
    )
    total = F.col("seconds") * 1000.0
    share = F.when(total > 0, F.col("milliseconds") / total).otherwise(0.0)
    return checked.join(spent, [*BUILD, "target"], "left").withColumn("share", share)


def target_advice(timings: DataFrame, targets: DataFrame) -> DataFrame:
    """BI-7: targets in which type checking is a large share of the build step."""
    return (
        type_check_shares(timings, targets)
        .where(
            (F.col("share") >= C.ADVICE_TARGET_SHARE)
            & (F.col("milliseconds") >= C.ADVICE_TARGET_MS)
        )
        .select(
            *BUILD,
            F.lit("target_dominated_by_type_checking").alias("advice"),
            F.lit("").alias("file"),
            F.lit(0).alias("line"),
            "target",
            "milliseconds",
            percent(F.col("share")).alias("percent"),
        )
    )


def advice(
    timings: DataFrame, targets: DataFrame, builds: DataFrame, site_limit: int
) -> DataFrame:
    """All advice of the builds that pass the gate, of sites the first of each build."""
    kept = advised_timings(timings, builds)
    return (
        site_advice(kept, site_limit)
        .unionByName(file_advice(kept))
        .unionByName(target_advice(kept, targets))
    )


# Change relation and ownership


def change_relation(
    builds: DataFrame,
    changed: DataFrame,
    diagnostics: DataFrame,
    failed_builds: DataFrame,
    crashed_builds: DataFrame,
) -> DataFrame:
    """BI-9: how likely the change explains the build, with the reasons.

    ``failed_builds`` and ``crashed_builds`` list builds with reproducible test
    failures and with crashes.
    """

    def flag(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*BUILD).distinct().withColumn(name, F.lit(True))

    manifests = changed.where(paths.is_package_manifest(F.col("path")))
    joined = builds.select(*BUILD)
    for rows, name in (
        (diagnostics_in_change(diagnostics, changed), "_diagnostic"),
        (manifests, "_manifest"),
        (changed, "_changed"),
        (failed_builds, "_failed"),
        (crashed_builds, "_crashed"),
    ):
        joined = joined.join(flag(rows, name), BUILD, "left")

    def on(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    signals = (
        (
            on("_diagnostic"),
            C.RELATION_DIAGNOSTIC,
            "a diagnostic's source file changed in this commit range",
        ),
        (on("_manifest"), C.RELATION_MANIFEST, "Package.swift or Package.resolved changed"),
        (
            on("_failed") & on("_changed"),
            C.RELATION_FAILURES,
            "the build has reproducible test failures and the range changes source files",
        ),
        (
            on("_crashed") & on("_diagnostic"),
            C.RELATION_CRASH,
            "a crash is corroborated by a diagnostic in changed code",
        ),
    )
    score = F.lit(0)
    for signal, weight, _ in signals:
        score = score + F.when(signal, weight).otherwise(0)
    reasons = F.array_compact(F.array(*(F.when(s, F.lit(text)) for s, _, text in signals)))
    none = F.array(F.lit("no overlap between changed files and the build's evidence"))
    return joined.select(
        *BUILD,
        F.least(F.lit(100), score).alias("confidence"),
        F.when(score >= C.RELATION_LIKELY, F.lit("yes"))
        .when(score <= C.RELATION_UNRELATED, F.lit("no"))
        .otherwise(F.lit("uncertain"))
        .alias("likely_related"),
        F.when(F.size(reasons) == 0, none).otherwise(reasons).alias("evidence"),
    )


def ownership(locations: DataFrame, blame: DataFrame, repo_root: str = "") -> DataFrame:
    """BI-10 over SO-4: blame records of distinct locations; unresolved ones drop.

    ``locations(build_key, file, line)``; ``blame(file, line, ...)`` uses paths
    relative to the repository, a null line standing for the whole file.
    """
    folded = slashes(F.col("file"))
    prefix = repo_root.replace("\\", "/").rstrip("/") + "/"
    relative = F.when(
        F.startswith(folded, F.lit(prefix)), F.substr(folded, F.lit(len(prefix) + 1))
    ).otherwise(folded)
    places = locations.select(*BUILD, relative.alias("file"), "line").distinct()
    records = blame.withColumnRenamed("file", "_file").withColumnRenamed("line", "_line")
    same = (F.col("file") == F.col("_file")) & F.col("line").eqNullSafe(F.col("_line"))
    return places.join(records, same).drop("_file", "_line")


# Combined result


def findings(
    impact_rows: DataFrame, bottleneck_rows: DataFrame, chains: DataFrame, advice_rows: DataFrame
) -> DataFrame:
    """BI-13: all results of a build in one shape."""

    def shaped(rows: DataFrame, result: str, subject: Column, detail: Column, value: Column):
        return rows.select(
            *BUILD,
            F.lit(result).alias("result"),
            subject.alias("subject"),
            detail.alias("detail"),
            value.cast("double").alias("value"),
        )

    return (
        shaped(
            impact_rows,
            "impact",
            F.col("changed_file"),
            F.coalesce("owning_target", F.lit("")),
            F.col("downstream"),
        )
        .unionByName(
            shaped(
                bottleneck_rows,
                "bottleneck",
                F.col("target"),
                F.col("blocked_downstream").cast("string"),
                F.col("score"),
            )
        )
        .unionByName(
            shaped(chains, "evidence", F.col("subject"), F.lit(""), F.col("confidence"))
        )
        .unionByName(
            shaped(
                advice_rows,
                "advice",
                F.concat_ws(":", "file", F.col("line").cast("string")),
                F.col("advice"),
                F.col("milliseconds"),
            )
        )
    )


def find_target(nodes: DataFrame) -> DataFrame:
    """GR-7 under its build key."""
    return by_name(nodes).withColumnRenamed("graph", "build_key")
