"""Toxicity by a factorization machine over hashed terms.

A text is the set of its words and word beginnings, each hashed to a bucket. Besides a
weight, every bucket has a short vector; the products of two present buckets' vectors
add up to what the pair says beyond the sum of both, such as an insult together with
the mention of a group.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, stored, texts_of, under_safe_names

# The model is fitted on at most this many labelled ids of each class, those of the
# smallest xxhash64, one text an id; scores cover all rows.
MOST_TOXIC, MOST_CLEAN = 6_000, 12_000
SAMPLE_PARTS = 24
BUCKETS = 1 << 20
FACTORS = 4
# Buckets in fewer texts of the sample, or that differ less between the classes by the
# chi-square statistic with one degree of freedom (p = 0.001), stay out of the model.
LEAST_TEXTS, LEAST_CHI2 = 3, 10.83
STEPS, RATE, DECAY, SEED = 300, 0.05, 1e-4, 7
PREFIXES = (4, 5, 6)
CACHED_WORDS = 300_000

_WORD = re.compile(r"[^\W_]+")


def buckets_of(word: str) -> list[int]:
    """The word itself and its beginnings, marked apart by a last character."""
    terms = [word + "$"] + [word[:n] + "^" for n in PREFIXES if len(word) >= n]
    return [zlib.crc32(term.encode()) % BUCKETS for term in terms]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, n: int):
    """Bias, weights and vectors by full-batch Adam on the weighted logistic loss."""
    rng = np.random.default_rng(SEED)
    sizes = np.array([len(r) for r in rows])
    where = np.repeat(np.arange(len(rows)), sizes)
    what = np.concatenate(rows).astype(int) if len(rows) else np.zeros(0, int)
    theta = np.zeros((n, 1 + FACTORS))
    theta[:, 1:] = rng.normal(0, 0.05, (n, FACTORS))
    share = float(np.clip((labels * weights).sum() / max(weights.sum(), 1), 1e-3, 1 - 1e-3))
    bias = np.log(share / (1 - share))
    first, second = np.zeros((n + 1, 1 + FACTORS)), np.zeros((n + 1, 1 + FACTORS))
    for step in range(1, STEPS + 1):
        vectors = theta[what, 1:]
        sums = np.stack(
            [np.bincount(where, vectors[:, f], len(rows)) for f in range(FACTORS)], 1
        )
        squares = np.bincount(where, (vectors**2).sum(1), len(rows))
        y = bias + np.bincount(where, theta[what, 0], len(rows))
        y = y + 0.5 * ((sums**2).sum(1) - squares)
        error = weights * (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels) / weights.sum()
        slope = np.zeros((n + 1, 1 + FACTORS))
        slope[:n, 0] = np.bincount(what, error[where], n)
        for f in range(FACTORS):
            slope[:n, 1 + f] = np.bincount(what, error[where] * (sums[where, f] - vectors[:, f]), n)
        slope[:n] += DECAY * theta
        slope[n, 0] = error.sum()
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        theta -= move[:n]
        bias -= move[n, 0]
    return bias, theta


@dataclass
class Model:
    """``place`` gives the row of a bucket that the model knows."""

    bias: float
    place: dict[int, int]
    theta: np.ndarray

    def score(self, texts: list[str], seen: dict[str, tuple[int, ...]]) -> np.ndarray:
        scores = np.empty(len(texts))
        place = self.place
        for k, text in enumerate(texts):
            hit: set[int] = set()
            for word in words_of(text):
                at = seen.get(word)
                if at is None:
                    at = tuple(place[b] for b in buckets_of(word) if b in place)
                    if len(seen) < CACHED_WORDS:
                        seen[word] = at
                if at:
                    hit.update(at)
            part = self.theta[sorted(hit)]
            y = self.bias + part[:, 0].sum()
            y += 0.5 * ((part[:, 1:].sum(0) ** 2).sum() - (part[:, 1:] ** 2).sum())
            scores[k] = 1 / (1 + np.exp(-np.clip(y, -30, 30)))
        return scores


def in_fold(doc_id: str = "doc_id"):
    """True for the rows whose labels are not learnt from."""
    rest = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5
    return F.coalesce(rest == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.

    A doc_id with several labels counts as toxic if one of them says so; null ids and
    labels other than 0 and 1 are left out. Of the rows of one doc_id the text of the
    least hash is learnt from, so repeated rows change nothing and the sample is bounded
    in rows. Without labels of both kinds the model is a constant.
    """
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(~in_fold()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    some = [
        known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for kind, most in ((1, MOST_TOXIC), (0, MOST_CLEAN))
    ]
    # At most MOST_TOXIC + MOST_CLEAN rows of two numbers.
    sample = F.broadcast(some[0].union(some[1]).withColumnRenamed("doc_id", "_id"))
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string"))
    texts = texts.join(sample, F.col("doc_id") == F.col("_id"))
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text"))
    texts = texts.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("toxic"))
    # Written once for three passes, and in parts, for its words are counted in Python.
    texts = texts.agg(one.alias("text")).select("doc_id", "text", "toxic").repartition(SAMPLE_PARTS)
    texts = stored(texts, "toxicity-sample")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, toxic in zip(texts_of(batch.column(1)), batch.column(2).to_pylist()):
                found = {b for word in words_of(text) for b in buckets_of(word)}
                totals[toxic][list(found)] += 1
        some = np.flatnonzero(totals.sum(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(totals[1][some]), pa.array(totals[0][some])],
            ["bucket", "toxic", "clean"],
        )

    rows = texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()
    sampled = {r["toxic"]: r["n"] for r in rows}
    p, n = sampled.get(1, 0), sampled.get(0, 0)
    if not p or not n:
        return Model(20.0 if p else -20.0, {}, np.zeros((0, 1 + FACTORS)))
    counts = texts.mapInArrow(tally, "bucket long, toxic long, clean long")
    counts = counts.groupBy("bucket").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    total = F.lit(float(p + n))
    chi2 = total * (a * (n - b) - b * (p - a)) ** 2 / (
        F.lit(float(p)) * F.lit(float(n)) * (a + b) * (total - a - b)
    )
    # At most BUCKETS rows, whatever the corpus.
    chosen = counts.where((a + b >= LEAST_TEXTS) & (a + b < total)).where(chi2 >= LEAST_CHI2)
    place = {r["bucket"]: i for i, r in enumerate(chosen.select("bucket").orderBy("bucket").collect())}

    def present(batch: pa.RecordBatch):
        hits = [
            sorted({place[b] for word in words_of(text) for b in buckets_of(word) if b in place})
            for text in texts_of(batch.column(1))
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(hits, pa.list_(pa.int64()))],
            ["doc_id", "toxic", "hits"],
        )

    weight = {1: sizes[1] / p, 0: sizes[0] / n}

    def fit_all(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.assign(key=sample["hits"].map(lambda h: tuple(h)))
        sample = sample.sort_values(["doc_id", "toxic", "key"])
        labels = sample["toxic"].to_numpy(float)
        weights = np.where(labels > 0, weight[1], weight[0])
        bias, theta = fit([np.asarray(h) for h in sample["hits"]], labels, weights, len(place))
        return pd.DataFrame({"bias": [bias], "theta": [theta.ravel().tolist()]})

    # The sample, of bounded size, in one task.
    rows = by_batch(texts, present, "doc_id long, toxic long, hits array<long>")
    row = rows.groupBy().applyInPandas(fit_all, "bias double, theta array<double>").first()
    return Model(row["bias"], place, np.array(row["theta"]).reshape(-1, 1 + FACTORS))


def add_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with a score column; null and empty texts get the score of no terms."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            scores = shared.value.score(texts_of(batch.column(len(names))), seen)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores, pa.float64())], [*names, name]
            )

    schema = docs.withColumn(name, F.lit(0.0)).schema
    return docs.withColumn("_text_to_score", F.col("text").cast("string")).mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Takes ``doc_id`` and ``text`` of ``docs`` and ``doc_id`` and ``toxic`` of
    ``labels``; other columns are ignored. A null doc_id is not held out and never
    labelled; repeated rows each get their row; empty texts get a score too.
    """
    source = docs.select(F.col("doc_id").cast("long"), "text")
    scored = add_score(source, train(docs, labels), "score")
    return scored.select(
        "doc_id",
        in_fold().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the model doesn't call toxic, with their columns as they are.

    The columns may have any names. Null and empty texts are scored by the model's
    constant alone, repeated rows alike; texts of any length are scored as a whole.
    """

    def run(rows: DataFrame) -> DataFrame:
        scored = add_score(rows, train(rows, labels), "_toxicity")
        return scored.where(F.col("_toxicity") < 0.5).select(*rows.columns)

    return under_safe_names(docs, ("doc_id", "text"), run)
