"""Exact top-k search by inner product in M-trees.

An inner product becomes a Euclidean distance by one more component that gives all
vectors of a tree the same norm M: d(q, x)^2 = |q|^2 + M^2 - 2 q.x. Every task turns its
rows into M-trees of bounded size, whose pages hold routing vectors with covering radii
and distances to the parent. A search opens the page with the least possible distance
first, over all trees of a group at once. An entry whose stored parent distance shows,
by the triangle inequality, that nothing below it can enter the result is dropped
before its own distance is computed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 1024
TOP = 10
QUERY_MODULUS = 100
# Vectors of a tree, of a leaf page, and entries of an inner page.
TREE_ROWS, LEAF_ROWS, FANOUT = 4096, 256, 16
TREES_PER_GROUP = 4
QUERIES_PER_BLOCK = 1024
# Bounds are loosened by this share, far above the rounding of a distance.
SLACK = 1e-9


@dataclass
class Page:
    """Entries' vectors, with distance to the page's own routing vector."""

    points: np.ndarray
    to_parent: np.ndarray
    radii: np.ndarray | None = None
    children: list[Page] | None = None
    scored: np.ndarray | None = None
    ids: list[np.ndarray] | None = None


@dataclass
class Tree:
    norm2: float
    centre: np.ndarray
    radius: float
    root: Page


def _page(points, scored, ids, centre) -> Page:
    away = np.sqrt(((points - centre) ** 2).sum(1))
    n = len(points)
    if n <= LEAF_ROWS:
        return Page(points, away, scored=scored, ids=ids)
    # Seeds lie far from each other; every vector goes to its nearest.
    seeds, nearest, owner = [], np.full(n, np.inf), np.zeros(n, int)
    following = int(away.argmax())
    while len(seeds) < FANOUT and (not seeds or nearest[following] > 0):
        d = np.sqrt(((points - points[following]) ** 2).sum(1))
        closer = d < nearest
        owner[closer], nearest[closer] = len(seeds), d[closer]
        seeds.append(following)
        following = int(nearest.argmax())
    parts = [np.flatnonzero(owner == s) for s in range(len(seeds))]
    children = [
        _page(points[p], scored[p], [ids[i] for i in p], points[s]) for p, s in zip(parts, seeds)
    ]
    radii = np.array([nearest[p].max() for p in parts])
    return Page(points[seeds], away[seeds], radii=radii, children=children)


def build(ids: np.ndarray, vectors: np.ndarray, top: int) -> Tree:
    """Equal vectors are one entry; of their ids only ``top`` + 1 can ever be returned."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    distinct, owner = np.unique(vectors, axis=0, return_inverse=True)
    by_owner = np.argsort(owner.ravel(), kind="stable")
    cuts = np.flatnonzero(np.diff(owner.ravel()[by_owner])) + 1
    lists = [part[: top + 1] for part in np.split(ids[by_owner], cuts)]
    floats = distinct.astype(float)
    norms = (floats**2).sum(1)
    more = np.sqrt(np.maximum(norms.max() - norms, 0))
    points = np.column_stack([floats, more])
    centre = points.mean(0)
    root = _page(points, distinct, lists, centre)
    radius = float(np.sqrt(((points - centre) ** 2).sum(1)).max())
    return Tree(float(norms.max()), centre, radius, root)


def search(trees: list[Tree], query_id: int, query: np.ndarray, top: int) -> list[tuple[int, int]]:
    """The best (score, id) pairs over all trees, in order."""
    q = np.append(query.astype(float), 0.0)
    q2 = float((q**2).sum())
    best: list[tuple[int, int]] = []
    waiting: list[tuple] = []
    tie = 0
    for tree in trees:
        d = float(np.sqrt(((q - tree.centre) ** 2).sum()))
        low = max(0.0, d - tree.radius)
        heappush(waiting, (-(q2 + tree.norm2 - low * low) / 2, tie, tree, tree.root, d))
        tie += 1
    while waiting:
        bound, _, tree, page, d_page = heappop(waiting)
        full = len(best) == top
        slack = SLACK * (q2 + tree.norm2) + 1e-6
        if full and -bound + slack < best[-1][0]:
            break
        most = np.inf
        if full:
            most = np.sqrt(max(q2 + tree.norm2 - 2 * best[-1][0] + 2 * slack, 0.0))
        reach = np.abs(d_page - page.to_parent) * (1 - SLACK)
        if page.children is None:
            near = np.flatnonzero(reach <= most + 1e-6)
            if not len(near):
                continue
            scores = page.scored[near] @ query
            found = [
                (int(score), int(i))
                for score, at in zip(scores, near)
                if not full or score >= best[-1][0]
                for i in page.ids[at]
                if i != query_id
            ]
            if found:
                best = sorted(best + found, key=lambda r: (-r[0], r[1]))[:top]
            continue
        near = np.flatnonzero(reach - page.radii <= most + 1e-6)
        distances = np.sqrt(((page.points[near] - q) ** 2).sum(1))
        lows = np.maximum(distances * (1 - SLACK) - page.radii[near], 0)
        for at, d, low in zip(near, distances, lows):
            if low <= most + 1e-6:
                tie += 1
                heappush(
                    waiting,
                    (-(q2 + tree.norm2 - low * low) / 2, tie, tree, page.children[at], float(d)),
                )
    return best


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and whole-number components; unusable rows are left out."""
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & sound)
    whole = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long"))
    return rows.select(F.col("vec_id").cast("long"), whole.alias("x"), F.size(x).alias("size"))


def top_k(
    vectors: DataFrame, top: int = TOP, modulus: int = QUERY_MODULUS, scale: int = SCALE
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best candidates of every query.

    Takes ``vec_id`` and ``embedding``; other columns are ignored. Rows with the id of
    the query are its own and no candidates. Only vectors of as many components as the
    query's are compared. Equal scores go by smaller id; repeated rows count once each.
    Rows with a null id or an unusable vector take no part; no rows give no result.
    """
    rows = quantised(vectors, scale)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def flush(size: int) -> pa.RecordBatch:
            nonlocal made
            part = held.pop(size)
            tree = build(
                np.array([i for i, _ in part], np.int64),
                np.array([x for _, x in part], np.int64).reshape(len(part), size),
                top,
            )
            made += 1
            columns = [[task << 20 | made], [size], [pickle.dumps(tree)]]
            kinds = [pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["tree_id", "size", "tree"]
            )

        for batch in batches:
            for i, x, size in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(size, []).append((i, x))
                if len(held[size]) == TREE_ROWS:
                    yield flush(size)
        for size in list(held):
            yield flush(size)

    trees = stored(rows.mapInArrow(index, "tree_id long, size int, tree binary"), "mtree")
    queries = rows.where(F.col("vec_id") % modulus == 0).distinct()
    counts = trees.groupBy("size").agg(F.count("*").alias("n_trees"))
    counts = counts.join(queries.groupBy("size").agg(F.count("*").alias("n")), "size")
    counts = counts.select(
        "size",
        F.ceil(F.col("n_trees") / TREES_PER_GROUP).cast("int").alias("groups"),
        F.ceil(F.col("n") / QUERIES_PER_BLOCK).cast("int").alias("blocks"),
    )
    # Every block of queries meets every group of trees once.
    keys = ["size", "group", "block"]
    sides = trees.join(counts, "size").select(
        "size",
        F.pmod(F.xxhash64("tree_id"), "groups").cast("int").alias("group"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        "tree",
    )
    asked = queries.join(counts, "size").select(
        "size",
        F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"),
        F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"),
        "vec_id",
        "x",
    )

    def meet(trees: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        loaded = [pickle.loads(t) for t in trees["tree"]]
        found = [
            (query_id, i, score)
            for query_id, x in zip(queries["vec_id"], queries["x"])
            for score, i in search(loaded, int(query_id), np.asarray(x, np.int64), top)
        ]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = sides.groupBy(*keys).cogroup(asked.groupBy(*keys))
    found = found.applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
