"""Ordered-sequence operators that do not put one key's whole sequence in one task.

A sequence (one log, one project's builds) is cut into chunks along its order.
Windows run inside a chunk; a small per-chunk summary carries state across
chunks. A key that holds a third of all rows is therefore spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

LINES_PER_CHUNK = 65_536


def line_chunk(line_no: str = "line_no", size: int = LINES_PER_CHUNK) -> Column:
    return F.floor(F.col(line_no) / F.lit(size))


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    chunk: Column,
    inclusive: bool = False,
) -> DataFrame:
    """Last non-null ``value`` of the key before each row (or up to it).

    ``chunk`` must not decrease along ``order``; keys must not be null.
    """
    return carry_each(df, keys, order, {out: value}, chunk, inclusive)


def carry_each(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    chunk: Column,
    inclusive: bool = False,
) -> DataFrame:
    """The last non-null one of each value before each row (or up to it), in one scan."""
    tagged = df.withColumn("_chunk", chunk).withColumns({f"_v_{n}": v for n, v in values.items()})
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = tagged.withColumns(
        {f"_here_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in values}
    )
    tails = tagged.groupBy(*keys, "_chunk").agg(
        *(
            F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order))).alias(f"_tail_{n}")
            for n in values
        )
    )
    carried = tails.select(
        *keys,
        "_chunk",
        *(
            F.last(f"_tail_{n}", ignorenulls=True).over(earlier_chunks(keys)).alias(f"_carry_{n}")
            for n in values
        ),
    )
    joined = local.join(carried, [*keys, "_chunk"], "left")
    return joined.select(
        *(c for c in df.columns if c not in values),
        *(F.coalesce(f"_here_{n}", f"_carry_{n}").alias(n) for n in values),
    )


def earlier_chunks(keys: Sequence[str]) -> WindowSpec:
    return (
        Window.partitionBy(*keys)
        .orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, chunk: Column
) -> DataFrame:
    """1-based position of each row in its key, counted chunk by chunk."""
    tagged = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = tagged.withColumn("_here", F.row_number().over(inside))
    counts = tagged.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *keys,
        F.col("_chunk").alias("_at"),
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"),
    )
    same = [local[k].eqNullSafe(offsets[k]) for k in keys]
    same.append(local["_chunk"].eqNullSafe(offsets["_at"]))
    joined = local.join(offsets.select(*keys, "_at", "_offset"), same, "left")
    return joined.select(
        *(local[c] for c in df.columns), (F.col("_here") + F.col("_offset")).alias(out)
    )


def top_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    limit: int,
    out: str | None = None,
    buckets: int = 32,
) -> DataFrame:
    """First ``limit`` rows of each key, ranked twice.

    The first ranking is inside (key, bucket), where Spark already drops rows
    beyond the limit before the shuffle; the second sees at most
    ``limit * buckets`` rows of a key, however large the key is.
    ``order`` must be total.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(buckets))
    first = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    rank = out or "_rank"
    kept = (
        df.withColumn("_bucket", salt)
        .withColumn("_local", F.row_number().over(first))
        .where(F.col("_local") <= limit)
        .drop("_bucket", "_local")
        .withColumn(rank, F.row_number().over(final))
        .where(F.col(rank) <= limit)
    )
    return kept if out else kept.drop("_rank")
