"""SimHash near-duplicates through pigeonhole blocks.

A fingerprint of 64 bits is split into ``distance + 2`` blocks. Two fingerprints that
differ in at most ``distance`` bits agree on some two whole blocks, so each is filed
under every pair of blocks; fingerprints are joined on these keys and verified. Equal
fingerprints are one node from the start, so copies never form pairs.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import by_batch, stored, texts_of, under_safe_names

WORDS = 3
DISTANCE = 2
SEED = 42
# A key with more fingerprints than this isn't joined with itself: its fingerprints
# look up their neighbours by value instead, which gives the same links.
LARGEST_BLOCK = 64
# Shingles hashed at a time, which bounds the memory a long text takes.
SHINGLES_AT_A_TIME = 1 << 14

_LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    tokens = text.translate(_LOWER).replace("\t", " ").replace("\n", " ")
    tokens = tokens.replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
    tokens = [t for t in tokens if t]
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = [" ".join(tokens)]
    else:
        shingles = list(map(" ".join, zip(*(tokens[i:] for i in range(words)))))
    votes = np.zeros(64, np.int64)
    digest = functools.partial(xxh64_intdigest, seed=seed)
    for at in range(0, len(shingles), SHINGLES_AT_A_TIME):
        part = shingles[at : at + SHINGLES_AT_A_TIME]
        hashes = np.fromiter(map(digest, part), np.uint64, len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * votes > len(shingles), bitorder="little")
    return int(majority.view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id`` and ``fp`` (signed) of every row."""

    def handle(batch: pa.RecordBatch):
        found = [fingerprint(text, words) for text in texts_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"]
        )

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return by_batch(source, handle, "doc_id long, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _blocks(distance: int) -> list[int]:
    """Masks of the pairs of blocks."""
    n = distance + 2
    edges = [64 * i // n for i in range(n + 1)]
    single = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(single, 2)]


def _flips(mask: int, distance: int) -> list[int]:
    """All changes of 1 to ``distance`` bits outside the mask."""
    free = [1 << bit for bit in range(64) if not mask >> bit & 1]
    return [
        _signed(functools.reduce(int.__or__, some))
        for n in range(1, distance + 1)
        for some in combinations(free, n)
    ]


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``a < b`` of different fingerprints within the distance.

    ``nodes`` has distinct fingerprints in ``fp``.
    """
    masks = _blocks(distance)
    keyed = nodes.select(
        "fp",
        F.explode(
            F.array(*(
                F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                for i, m in enumerate(masks)
            ))
        ).alias("at"),
    ).select("fp", "at.block", "at.key")
    sizes = keyed.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1")
    filed = stored(keyed.join(sizes, ["block", "key"]), "simhash-blocks")
    small = filed.where(F.col("n") <= LARGEST_BLOCK)
    a = small.select("block", "key", F.col("fp").alias("a"))
    b = small.select("block", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    joined = a.join(b, ["block", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    looked_up = None
    large = filed.where(F.col("n") > LARGEST_BLOCK)
    for i, mask in enumerate(masks):
        flips = F.explode(F.array(*map(F.lit, _flips(mask, distance))))
        one = large.where(F.col("block") == i).select(F.col("fp").alias("a"), flips.alias("flip"))
        one = one.select("a", F.col("a").bitwiseXOR(F.col("flip")).alias("b")).where("a < b")
        looked_up = one if looked_up is None else looked_up.union(one)
    if not large.limit(1).isEmpty():
        there = nodes.select(F.col("fp").alias("b"))
        joined = joined.union(looked_up.join(there, "b", "left_semi").select("a", "b"))
    return joined.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is linked with, for linked nodes.

    Alternates large-star and small-star steps, which keep every component connected
    and end in stars; each round is written to the shared folder.
    """
    now = stored(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), "simhash-links")

    def mark(table: DataFrame) -> tuple:
        row = table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    seen = mark(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        now = stored(small, "simhash-stars")
        last, seen = seen, mark(now)
        if seen == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """For every fingerprint its component's root, the smallest id in each, and overall.

    ``prints`` has ``doc_id`` and ``fp``; gives ``fp, least, root, component_id``.
    """
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = stored(nodes, "simhash-nodes")
    roots = components(links(nodes, distance))
    linked = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return linked.join(named, "root")


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id`` of every row of ``docs``.

    Takes ``doc_id`` and ``text``; other columns are ignored. A text without words,
    null or empty, has fingerprint zero and is linked like any other. Null ids count
    last: a component of null ids alone has a null id. Repeated rows stay.
    """
    prints = stored(fingerprints(docs, words), "simhash")
    found = classes(prints, distance).select("fp", "component_id")
    return prints.join(found, "fp").select("doc_id", hexed("fp").alias("fingerprint"), "component_id")


def hexed(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_first(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """The row of the smallest doc_id of each component, with all its columns.

    Of several such rows one stays; a component of null ids alone keeps one row too.
    Null and empty texts have fingerprint zero and are one another's copies. The columns
    may have any names; texts of any length are read as a whole.
    """
    return under_safe_names(docs, ("doc_id", "text"), lambda rows: _first(rows, words, distance))


def _first(docs: DataFrame, words: int, distance: int) -> DataFrame:
    names = docs.columns

    def tag(batch: pa.RecordBatch):
        found = [fingerprint(text, words) for text in texts_of(batch.column(len(names)))]
        columns = [*batch.columns[:-1], pa.array(found, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*names, "_fp"])

    schema = docs.withColumn("_fp", F.lit(0).cast("long")).schema
    tagged = by_batch(docs.withColumn("_text", F.col("text").cast("string")), tag, schema)
    tagged = stored(tagged, "simhash-tagged")
    found = classes(tagged.select(F.col("doc_id").cast("long"), F.col("_fp").alias("fp")), distance)
    order = F.struct(F.col("least").isNull(), "least", "fp")
    first = found.groupBy("root").agg(F.min(order).alias("kept"))
    first = first.select(F.col("kept.fp").alias("_fp_kept"), F.col("kept.least").alias("_id_kept"))
    same = (F.col("_fp") == F.col("_fp_kept")) & F.col("doc_id").eqNullSafe(F.col("_id_kept"))
    kept = tagged.join(first, same, "left_semi")
    return kept.dropDuplicates(["_fp", "doc_id"]).select(*names)
