"""Quality rules: base statistics of a text and robust multivariate outliers.

Every text gives a vector of transformed statistics. For every language and source the
minimum covariance determinant is sought: the share CORE of the rows whose covariance
has the least determinant. Concentration steps keep the rows nearest to the current
centre, by Mahalanobis distance, and estimate centre and covariance anew from them.
They begin at several estimates of each group, go on from the best of these until the
determinant no longer falls, and the least determinant decides. Texts too far from its
centre are rejected.

Rows meet their group's estimates in aggregates only: one step sums moments by group,
start and distance bin, and bins are added up from the nearest on until they hold the
core, the last one in part. Sums are of whole numbers, and no more than one bin is
weighted, so results don't depend on the order of addition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import maybe_broadcast
from .common import SPACES, stored

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
# Share of rows in the core, and the factor that makes the core's covariance estimate
# the whole's if that is normal: CORE / P(chi2 with 7 degrees < its 0.75 point with 5).
CORE, CONSISTENCY = 0.75, 1.42
# Starts: five of all rows, and SETS of about SET_ROWS rows each, chosen by hash.
SETS, SET_ROWS = 12, 7
# Every start takes FIRST_STEPS; FINALISTS of each group go on while the logarithm of the
# determinant falls by LEAST_FALL or more.
FIRST_STEPS, FINALISTS, LEAST_FALL = 2, 4, 1e-3
# Smaller groups are judged with the other small groups of their language, or failing
# that with all such rows.
LEAST_GROUP = 50
# Rejected beyond this squared distance: 15 in a million normal vectors are.
FARTHEST = 30.0
# Fixed-point scale of the vectors, and least standard deviation of each component:
# differences below it are never a reason.
SCALE = 1000
STATS = {
    "x_words": 0.5,
    "x_length": 0.12,
    "x_symbols": 0.05,
    "x_lines": 0.5,
    "x_repeats": 0.15,
}
# Distance bins of the steps of all starts, and of the finalists.
COARSE_BINS, FINE_BINS = 4, 16
# Rows of a file of estimates.
FILE_ROWS = 10_000


def base_statistics(docs: DataFrame, extra: list[str]) -> DataFrame:
    """Counts of every text, with the ``extra`` columns as they are."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACES}]"))
    first = docs.select(
        *extra,
        words.alias("_words"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("_lines"),
        F.length(F.translate(text, " \t\n\v\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    w = F.col("_words")
    windows = F.slice(
        F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
        1,
        F.greatest(F.size(w) - 2, F.lit(0)),
    )
    hashed = first.withColumn("_windows", windows)
    found = F.col("_windows")
    some_twice = F.size(F.array_distinct(found)) < F.size(found)
    ordered = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    hashed = hashed.withColumn("_ordered", F.when(some_twice, ordered))
    o = F.col("_ordered")
    twice = F.filter(
        o,
        lambda s, k: F.coalesce(s["h"] == F.get(o, k - 1)["h"], F.lit(False))
        | F.coalesce(s["h"] == F.get(o, k + 1)["h"], F.lit(False)),
    )
    hashed = hashed.withColumn("_starts", F.sort_array(F.transform(twice, lambda s: s["i"])))
    p = F.col("_starts")
    covered = F.transform(p, lambda at, k: F.least(F.lit(3), F.coalesce(at - F.get(p, k - 1), F.lit(3))))
    repeated = F.aggregate(covered, F.lit(0).cast("long"), lambda total, n: total + n)
    return hashed.select(
        *extra,
        F.size(w).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(repeated, F.lit(0).cast("long")).alias("n_repeat_words"),
        "_lines",
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )


def _vector() -> dict[str, Column]:
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "x_words": F.log1p("n_words"),
        "x_length": F.log(chars / n),
        "x_symbols": F.sqrt(F.col("n_symbols") / chars),
        "x_lines": F.log1p("n_dup_lines"),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / n),
    }


def _groups(rows: DataFrame) -> DataFrame:
    """Adds ``_group``: language and source, or a pool for groups that are too small."""
    key = F.to_json(F.struct(F.lit("s").alias("k"), "lang", "source"), {"ignoreNullFields": "false"})
    pool = F.to_json(F.struct(F.lit("l").alias("k"), "lang"), {"ignoreNullFields": "false"})
    rows = rows.withColumns({"_own": key, "_pool": pool})
    sizes = rows.groupBy("_own", "_pool").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn(
        "_few", F.sum(F.when(F.col("n") < LEAST_GROUP, F.col("n"))).over(Window.partitionBy("_pool"))
    )
    named = F.when(F.col("n") >= LEAST_GROUP, F.col("_own")).otherwise(
        F.when(F.col("_few") >= LEAST_GROUP, F.col("_pool")).otherwise(F.lit("all"))
    )
    names = stored(sizes.select("_own", named.alias("_group")), "quality-groups")
    return rows.join(maybe_broadcast(names, names.count()), "_own").drop("_own", "_pool")


def _with_distance(rows: DataFrame, estimate: DataFrame, n_groups: int) -> DataFrame:
    dims = list(STATS)
    joined = rows.join(maybe_broadcast(estimate, n_groups), "_group")
    for i, name in enumerate(dims):
        z = F.col(name) - F.col(f"_m{i}")
        for j in range(i):
            z = z - F.col(f"_l{i}{j}") * F.col(f"_z{j}")
        joined = joined.withColumn(f"_z{i}", z / F.col(f"_l{i}{i}"))
    total = reduce(lambda a, b: a + b, (F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(len(dims))))
    return joined.withColumn("_d2", total)


DIMS = range(len(STATS))
PAIRS = [(i, j) for i in DIMS for j in range(i + 1)]
ESTIMATE = [*(f"_m{i}" for i in DIMS), *(f"_l{i}{j}" for i, j in PAIRS), "_logdet"]


def _sums(values: list[Column]) -> list[Column]:
    """Count, sums and sums of products, exact for whole numbers."""
    whole = [v.cast("decimal(18,0)") for v in values]
    return [
        F.count("*").alias("n"),
        *(F.sum(whole[i]).alias(f"s{i}") for i in DIMS),
        *(F.sum(whole[i] * whole[j]).alias(f"c{i}{j}") for i, j in PAIRS),
    ]


def _mean(i: int) -> Column:
    return F.col(f"s{i}").cast("double") / F.col("n")


def _covariance(i: int, j: int) -> Column:
    return F.col(f"c{i}{j}").cast("double") / F.col("n") - _mean(i) * _mean(j)


def _factored(moments: DataFrame, centre: list[Column], covariance: dict[tuple[int, int], Column]) -> DataFrame:
    """ESTIMATE: the centre, the Cholesky factor of the covariance and its determinant.

    The floors of the components are added to the diagonal, so that the determinants of
    a group are compared with the same floors in all of them.
    """
    floors = [(SCALE * least) ** 2 for least in STATS.values()]
    out = moments.withColumns({f"_m{i}": centre[i] for i in DIMS})
    for i, j in PAIRS:
        entry = covariance[i, j]
        if i == j:
            entry = F.greatest(entry, F.lit(0.0)) + floors[i]
        for k in range(j):
            entry = entry - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
        entry = F.sqrt(F.greatest(entry, F.lit(0.1 * floors[i]))) if i == j else entry / F.col(f"_l{j}{j}")
        out = out.withColumn(f"_l{i}{j}", entry)
    logs = reduce(lambda a, b: a + b, (F.log(F.col(f"_l{i}{i}")) for i in DIMS))
    return out.withColumn("_logdet", 2 * logs).select("_group", "_start", *ESTIMATE)


def _starts(rows: DataFrame) -> tuple[DataFrame, int]:
    """Several estimates of every group, and the number of groups.

    All begin with medians and spreads between quartiles. ``quantile`` takes components
    as independent, ``moments`` all rows as they are; the others take the covariance of
    scores that far rows cannot rule: ``tanh`` of each component, ``quadrant`` its sign,
    ``spatial`` the direction from the centre. The others take the moments of a few rows
    that depend on a hash of their components alone; some of them are free of outliers.
    """
    dims = list(STATS)
    # Exact: a component of fixed point has a bounded number of values.
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    quartiles = rows.groupBy("_group").agg(
        F.count("*").alias("_n"), *(F.percentile(c, quarters).alias(c) for c in dims)
    )
    marks = quartiles.select(
        "_group",
        "_n",
        *(F.col(c)[1].alias(f"_q{i}") for i, c in enumerate(dims)),
        *(
            F.greatest((F.col(c)[2] - F.col(c)[0]) / 1.349, F.lit(SCALE * least)).alias(f"_s{i}")
            for i, (c, least) in enumerate(STATS.items())
        ),
    )
    marks = stored(marks, "quality-marks")
    n_groups = marks.count()
    placed = rows.join(maybe_broadcast(marks, n_groups), "_group").select(
        "_group", "_n", *dims, *(((F.col(c) - F.col(f"_q{i}")) / F.col(f"_s{i}")).alias(f"_z{i}") for i, c in enumerate(dims))
    )
    z = [F.col(f"_z{i}") for i in DIMS]
    length = F.greatest(F.sqrt(reduce(lambda a, b: a + b, (x * x for x in z))), F.lit(1e-9))
    scores = {
        "moments": z,
        "tanh": [F.tanh(x) for x in z],
        "quadrant": [F.signum(x) for x in z],
        "spatial": [x / length for x in z],
    }

    def start(name: Column, score: list[Column]) -> Column:
        return F.struct(
            name.alias("_start"), *(F.round(x * SCALE).cast("long").alias(f"y{i}") for i, x in enumerate(score))
        )

    chosen = F.filter(
        F.array(*(F.lit(k) for k in range(SETS))), lambda k: F.pmod(F.xxhash64(k, *dims), "_n") < SET_ROWS
    )
    sets = F.transform(chosen, lambda k: start(F.concat(F.lit("set "), k.cast("string")), z))
    whole = F.array(*(start(F.lit(name), score) for name, score in scores.items()))
    scored = placed.select("_group", F.explode(F.concat(whole, sets)).alias("score")).select("_group", "score.*")
    moments = scored.groupBy("_group", "_start").agg(*_sums([F.col(f"y{i}") for i in DIMS]))
    alone = marks.select(
        "_group",
        F.lit("quantile").alias("_start"),
        F.lit(1).cast("long").alias("n"),
        *(F.lit(0).alias(f"s{i}") for i in DIMS),
        *(F.lit(SCALE * SCALE if i == j else 0).alias(f"c{i}{j}") for i, j in PAIRS),
    )
    moments = moments.unionByName(alone).join(maybe_broadcast(marks, n_groups), "_group")
    shift = F.when(F.col("_start").isin("tanh", "quadrant", "spatial"), 0.0).otherwise(1.0) / SCALE
    centre = [F.col(f"_q{i}") + F.col(f"_s{i}") * _mean(i) * shift for i in DIMS]
    covariance = {
        (i, j): F.col(f"_s{i}") * F.col(f"_s{j}") * _covariance(i, j) / SCALE**2 for i, j in PAIRS
    }
    found = _factored(moments, centre, covariance)
    return _few_files(found, n_groups * (5 + SETS), "quality-starts"), n_groups


def _few_files(estimates: DataFrame, bound: int, label: str) -> DataFrame:
    """Write estimates, a row of each start of each group, in as many files as they fill."""
    return stored(estimates.repartition(1 + bound // FILE_ROWS), label)


def _concentrated(rows: DataFrame, estimates: DataFrame, bound: int, bins: int) -> DataFrame:
    """The estimate from the nearest CORE of the rows of a group, for each of ``estimates``.

    There are ``bins`` distance bins to a doubling.
    """
    near = _with_distance(rows, estimates, bound)
    octave = F.floor(F.log2(F.greatest("_d2", F.lit(2.0**-20))) * bins)
    summed = near.groupBy("_group", "_start", octave.alias("_bin")).agg(*_sums([F.col(c) for c in STATS]))
    # A start of a group has a bounded number of bins.
    group = Window.partitionBy("_group", "_start")
    inner = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(inner), F.lit(0))
    summed = summed.withColumns({"_before": before, "_core": CORE * F.sum("n").over(group)})
    share = F.least(F.lit(1.0), (F.col("_core") - F.col("_before")) / F.col("n"))
    core = summed.where(F.col("_before") < F.col("_core")).withColumn("_share", share)

    def held(name: str) -> Column:
        whole = F.sum(F.when(F.col("_share") == 1.0, F.col(name))).cast("double")
        part = F.sum(F.when(F.col("_share") < 1.0, F.col(name).cast("double") * F.col("_share")))
        return (F.coalesce(whole, F.lit(0.0)) + F.coalesce(part, F.lit(0.0))).alias(name)

    names = ["n", *(f"s{i}" for i in DIMS), *(f"c{i}{j}" for i, j in PAIRS)]
    moments = core.groupBy("_group", "_start").agg(*(held(c) for c in names))
    covariance = {(i, j): CONSISTENCY * _covariance(i, j) for i, j in PAIRS}
    return _factored(moments, [_mean(i) for i in DIMS], covariance)


def estimates(rows: DataFrame) -> tuple[DataFrame, int]:
    """ESTIMATE of every group, of the least determinant found, and the number of groups."""
    found, n_groups = _starts(rows)
    n_starts = n_groups * (5 + SETS)
    for _ in range(FIRST_STEPS):
        found = _few_files(_concentrated(rows, found, n_starts, COARSE_BINS), n_starts, "quality-core")
    best = Window.partitionBy("_group").orderBy("_logdet", "_start")
    found = found.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= FINALISTS)
    found = found.drop("_rank").withColumn("_open", F.lit(True))
    found = _few_files(found, n_starts, "quality-finalists")
    while not (moving := found.where("_open").drop("_open")).isEmpty():
        moved = _concentrated(rows, moving, n_starts, FINE_BINS)
        key = ["_group", "_start"]
        both = moving.select(*key, F.struct(*ESTIMATE).alias("old")).join(
            moved.select(*key, F.struct(*ESTIMATE).alias("new")), key
        )
        fell = F.col("new._logdet") <= F.col("old._logdet") - LEAST_FALL
        stepped = both.select(*key, F.when(fell, F.col("new")).otherwise(F.col("old")).alias("e"), fell.alias("_open"))
        closed = found.where("not _open")
        found = closed.unionByName(stepped.select(*key, "e.*", "_open"))
        found = _few_files(found, n_starts, "quality-core")
    least = found.groupBy("_group").agg(
        F.min_by(F.struct(*ESTIMATE), F.struct("_logdet", "_start")).alias("e")
    )
    return _few_files(least.select("_group", "e.*"), n_groups, "quality-estimates"), n_groups


def quality_rules(docs: DataFrame) -> DataFrame:
    """Base counts, ``base_failed``, ``distance`` and ``kept`` of every row.

    Takes ``doc_id, text, lang, source``; other columns are ignored. A null text has no
    words and fails. Null languages and sources are values of their own. Rows that fail
    the base rules take no part in the estimates and have a null distance. Where fewer
    than LEAST_GROUP rows are left to estimate from, nothing more is rejected.
    """
    extra = [F.col("doc_id").cast("long").alias("doc_id"), F.col("lang"), F.col("source")]
    names = ["doc_id", "lang", "source"]
    counted = base_statistics(docs.select(*extra, "text"), names)
    counted = counted.withColumn("base_failed", base_failed())
    table = stored(
        counted.withColumns({c: F.round(x * SCALE).cast("long") for c, x in _vector().items()}),
        "quality",
    )
    rows = _groups(table.where(~F.col("base_failed")))
    estimate, n_groups = estimates(rows)
    judged = _with_distance(rows, estimate, n_groups)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    sizes = stored(rows.groupBy("_group").agg(F.count("*").alias("_size")), "quality-sizes")
    judged = judged.join(maybe_broadcast(sizes, n_groups), "_group")
    far = (F.col("_d2") > FARTHEST) & (F.col("_size") >= LEAST_GROUP)
    passed = judged.select("doc_id", *counts, "base_failed", F.col("_d2").alias("distance"), (~far).alias("kept"))
    failed = table.where("base_failed").select(
        "doc_id", *counts, "base_failed", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")
    )
    return passed.unionByName(failed)
