"""Exact interpolated percentiles that hold no group in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer.
Here the values are counted first, a histogram over coarse buckets finds the
bucket that holds each wanted rank, and a bucket of many distinct values is split
again, between its own least and greatest value, until few are left to be ranked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import written

# Distinct values that one window may rank, and parts a larger bucket is split into.
RANKED_VALUES = 20_000
PARTS = 1024


def coarse_bucket(value: Column) -> Column:
    """Non-decreasing in the value, about 1000 buckets per factor of ten."""
    size = F.floor(F.log1p(F.abs(value)) * F.lit(434.0))
    return F.when(value < 0, -size - 1).otherwise(size)


def _inside(rank: Column, before: Column, size: Column) -> Column:
    return (rank >= before) & (rank < before + size)


def _holding(pieces: DataFrame, group: list[str], order: str, ranks: list[Column]) -> DataFrame:
    """Pieces of a histogram that hold a wanted rank, with the values before them.

    Within a group the pieces follow ``order`` and begin after ``_before`` values.
    """
    through = Window.partitionBy(*group).orderBy(order)
    placed = pieces.withColumn(
        "_before", F.col("_before") + F.sum("_size").over(through) - F.col("_size")
    )
    hit = F.lit(False)
    for rank in ranks:
        hit = hit | _inside(rank, F.col("_before"), F.col("_size"))
    return placed.where(hit)


def counted_values(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per key and distinct value with its number; such tables can be merged."""
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(count.cast("long").alias("_c"))
    )


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: Mapping[str, float],
    weight: str | None = None,
) -> DataFrame:
    """One row per key: ``n`` and each percentile, linearly interpolated.

    ``weight`` names a column that says how often a row counts.
    """
    keys = list(keys)
    counts = counted_values(df, keys, value, weight)
    counts, _ = written(counts.withColumn("_b", coarse_bucket(F.col("_v")).cast("string")), "values")
    lows = {name: F.floor(F.lit(p) * (F.col("n") - 1)) for name, p in wanted.items()}
    highs = {name: F.ceil(F.lit(p) * (F.col("n") - 1)) for name, p in wanted.items()}
    ranks = [*lows.values(), *highs.values()]

    # _b names a bucket, _part orders the buckets of one group.
    sizes = [F.sum("_c").alias("_size"), F.count(F.lit(1)).alias("_distinct")]
    histogram = (
        counts.groupBy(*keys, "_b")
        .agg(*sizes)
        .withColumn("_part", F.col("_b").cast("long"))
        .withColumn("n", F.sum("_size").over(Window.partitionBy(*keys)))
        .withColumn("_before", F.lit(0).cast("long"))
    )
    chosen = _holding(histogram, keys, "_part", ranks).select(*keys, "_b", "_before", "n", "_distinct")
    chosen, _ = written(chosen, "ranks")
    values = counts
    ready = []
    while True:
        small = chosen.where(F.col("_distinct") <= RANKED_VALUES).drop("_distinct")
        ready.append(values.join(small, [*keys, "_b"]))
        large = chosen.where(F.col("_distinct") > RANKED_VALUES).drop("_distinct")
        if not large.limit(1).count():
            break
        inside, _ = written(values.join(large, [*keys, "_b"]), "values")
        ends = inside.groupBy(*keys, "_b").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        # Halves keep differences finite; the ends of a bucket never share a part.
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        split = inside.join(ends, [*keys, "_b"]).select(
            *keys, "_v", "_c", "_b", "_before", "n", F.floor(share * PARTS).cast("long").alias("_part")
        )
        split, _ = written(split, "values")
        parts = split.groupBy(*keys, "_b", "_before", "n", "_part").agg(*sizes)
        name = F.concat_ws("/", "_b", "_part").alias("_b")
        chosen = _holding(parts, [*keys, "_b"], "_part", ranks)
        chosen, _ = written(chosen.select(*keys, name, "_before", "n", "_distinct"), "ranks")
        values = split.select(*keys, "_v", "_c", name)
    running = Window.partitionBy(*keys, "_b").orderBy("_v")
    picks = [F.max("n").alias("n")]
    for label in wanted:
        for end, rank in (("lo", lows[label]), ("hi", highs[label])):
            at = F.when(_inside(rank, F.col("_start"), F.col("_c")), F.col("_v"))
            picks.append(F.max(at).alias(f"_{end}_{label}"))
    ranked = [
        some.withColumn("_start", F.col("_before") + F.sum("_c").over(running) - F.col("_c"))
        for some in ready
    ]
    together = ranked[0]
    for some in ranked[1:]:
        together = together.unionByName(some)
    picked = together.groupBy(*keys).agg(*picks)
    out = []
    for label, p in wanted.items():
        low, high = F.col(f"_lo_{label}"), F.col(f"_hi_{label}")
        share = F.lit(p) * (F.col("n") - 1) - lows[label]
        out.append((low + (high - low) * share).alias(label))
    return picked.select(*keys, "n", *out)
