"""Ranked lexical search: accumulators of short lists within document-at-a-time skipping.

Documents are cut into blocks; a block keeps, for every term that a query asks for, the
sorted places of its documents and the term's occurrences there. Per block and query the
short lists are summed into one list of accumulators. It is then one iterator among the
long lists: documents are visited in order, window by window, every iterator bounds what
it can add in a window, and windows or documents that cannot reach the best k any more
are skipped without reading the lists of the least bounds. The best of all blocks are
ranked again.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import maybe_broadcast
from .common import lower_ascii, packed, stored, unpacked

TOP = 10
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# A block ends at so many bytes of text or documents, which bounds the memory of a task.
BLOCK_BYTES = 32 << 20
BLOCK_DOCS = 1 << 15
# Lists of at most so many documents in a block are summed before the search.
SHORT = 256
WINDOW_DOCS = 256
# Queries that are searched together in a block.
BATCH = 1024
# So many distinct query terms are told to the tasks that read the documents, which then
# keep the lists of these alone. With more of them the lists of all terms are kept.
TOLD_TERMS = 200_000
# Parts that the lists of one term are dealt into where the query terms are not broadcast.
SALTS = 32

POSTINGS = "block long, term string, df long, n_terms long, docs binary, counts binary"
_POSTINGS = [part.split()[0] for part in POSTINGS.split(", ")]

# Term bytes stay, A to Z in lower case; every other byte becomes a space.
_FOLDED = bytes(
    b if re.match(TERM, chr(b)) else 32 for b in bytes(range(128)).lower()
) + bytes(range(128, 256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_FOLDED).split()


class Block:
    """Documents of one block while they are read."""

    def __init__(self):
        self.ids, self.lengths = [], array("q")
        self.lists: dict[bytes, tuple[array, array]] = {}
        self.size = 0

    def add(self, doc: int | None, text: bytes, told: set[bytes] | None) -> None:
        terms = terms_of(text)
        self.size += len(text)
        if not terms:
            return
        counts = Counter(terms)
        place = len(self.ids)
        self.ids.append(doc)
        self.lengths.append(len(terms))
        for term in counts.keys() if told is None else counts.keys() & told:
            held = self.lists.get(term)
            if held is None:
                held = self.lists[term] = (array("i"), array("q"))
            held[0].append(place)
            held[1].append(counts[term])

    def rows(self, name: int) -> Iterator[tuple]:
        """A row for the documents, in order of their ids, and one for each term."""
        known = np.array([doc is not None for doc in self.ids], bool)
        ids = np.array([doc or 0 for doc in self.ids], np.int64)
        order = np.lexsort([ids, ~known])
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(len(ids), dtype=np.int32)
        lengths = np.array(self.lengths, np.int64)
        yield (name, None, len(ids), int(lengths.sum()), packed(ids[order[: known.sum()]]), packed(lengths[order]))
        for term, (docs, counts) in self.lists.items():
            docs = place[np.frombuffer(docs, np.int32)]
            sort = np.argsort(docs)
            counts = np.frombuffer(counts, np.int64)[sort]
            yield (name, term.decode(), len(docs), 0, packed(docs[sort]), packed(counts))


def index(docs: DataFrame, told: set[bytes] | None = None) -> DataFrame:
    """Lists per block and term; a block's own row has no term and names its documents.

    There ``df`` is the number of documents with a term, ``n_terms`` that of all terms,
    ``docs`` their ids, those of null last and left out, and ``counts`` their lengths.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, block = TaskContext.get().partitionId(), 0, Block()

        def done() -> Iterator[pa.RecordBatch]:
            rows = list(block.rows(task << 32 | made)) if block.ids else []
            for i in range(0, len(rows), 10_000):
                columns = zip(*rows[i : i + 10_000])
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, _POSTINGS)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(doc, text.as_buffer().to_pybytes() if text.is_valid else b"", told)
                if block.size >= BLOCK_BYTES or len(block.ids) >= BLOCK_DOCS:
                    yield from done()
                    made, block = made + 1, Block()
        yield from done()

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return source.mapInArrow(read, POSTINGS)


@dataclass
class Postings:
    """A list of documents and what each adds, with the bounds of its windows."""

    docs: np.ndarray
    scores: np.ndarray
    cuts: np.ndarray
    bounds: np.ndarray


def postings(docs: np.ndarray, scores: np.ndarray, n_docs: int) -> Postings:
    edges = np.arange(0, n_docs + WINDOW_DOCS, WINDOW_DOCS)
    cuts = np.searchsorted(docs, edges)
    bounds = np.zeros(len(edges) - 1, np.int64)
    filled = np.flatnonzero(cuts[1:] > cuts[:-1])
    if len(filled):
        bounds[filled] = np.maximum.reduceat(scores, cuts[filled])
    return Postings(docs, scores, cuts, bounds)


def summed(lists: list[Postings], n_docs: int) -> Postings:
    docs, owner = np.unique(np.concatenate([one.docs for one in lists]), return_inverse=True)
    scores = np.zeros(len(docs), np.int64)
    np.add.at(scores, owner, np.concatenate([one.scores for one in lists]))
    return postings(docs, scores, n_docs)


def best(lists: list[Postings], n_docs: int, k: int, short: int = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best documents, equal scores by place."""
    brief = [one for one in lists if len(one.docs) <= short]
    iterators = [one for one in lists if len(one.docs) > short]
    need = 1
    if brief:
        accumulators = summed(brief, n_docs)
        iterators.append(accumulators)
        if len(accumulators.docs) >= k:
            # So many documents reach this already; no lower score can be among the best.
            need = max(need, int(np.partition(accumulators.scores, -k)[-k]))
    bounds = np.stack([one.bounds for one in iterators])
    reach = bounds.sum(axis=0)
    found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for window in np.flatnonzero(reach >= need):
        if reach[window] < need:
            continue
        here = bounds[:, window]
        total, base = np.zeros(WINDOW_DOCS, np.int64), window * WINDOW_DOCS
        rest, alive = int(reach[window]), None
        for i in np.argsort(-here, kind="stable"):
            if here[i] == 0 or (alive is not None and not len(alive)):
                break
            one = iterators[i]
            part = slice(one.cuts[window], one.cuts[window + 1])
            if alive is None and rest >= need:
                # A document that no earlier list holds can still be among the best.
                total[one.docs[part] - base] += one.scores[part]
            else:
                if alive is None:
                    alive = np.flatnonzero(total)
                alive = alive[total[alive] + rest >= need]
                add = np.zeros(WINDOW_DOCS, np.int64)
                add[one.docs[part] - base] = one.scores[part]
                total[alive] += add[alive]
            rest -= int(here[i])
        kept = np.flatnonzero(total) if alive is None else alive
        kept = kept[total[kept] >= need]
        if not len(kept):
            continue
        found, scores = np.concatenate([found, kept + base]), np.concatenate([scores, total[kept]])
        order = np.lexsort([found, -scores])[:k]
        found, scores = found[order], scores[order]
        if len(found) == k:
            # Later documents lose against equal scores.
            need = max(need, int(scores[-1]) + 1)
    return found, scores


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The k highest-scoring documents of every item, as item_id, rank, doc_id, score.

    Takes ``doc_id`` and ``text`` of the documents, ``item_id`` and ``text`` of the
    items; other columns, whatever their names, are ignored. A null or empty text has no
    terms, so it is never found and finds nothing. Equal scores are ranked by doc_id,
    null last. Repeated rows are documents, or items, of their own: equal items have
    their results once each. No documents or no items give no rows. A very long text is
    read as a whole; scores are 64-bit whole numbers.
    """
    asked = stored(
        items.select(
            F.monotonically_increasing_id().alias("query"),
            F.col("item_id").cast("long"),
            F.array_distinct(
                F.regexp_extract_all(lower_ascii(F.col("text").cast("string")), F.lit(TERM), F.lit(0))
            ).alias("terms"),
        ),
        "lexical-items",
    )
    terms = asked.select("query", F.explode("terms").alias("term"))
    distinct = terms.select("term").distinct()
    n_distinct = distinct.count()
    told = None
    if n_distinct <= TOLD_TERMS:
        told = {row.term.encode() for row in distinct.collect()}
    lists = stored(index(docs, told), "lexical-lists")
    blocks = lists.where("term is null")
    totals = blocks.agg(F.sum("df").alias("n"), F.sum("n_terms").alias("l")).first()
    n_all, l_all = totals["n"] or 0, totals["l"] or 0

    weight = F.floor(
        F.lit(1000.0) * F.log(F.lit(2.0 * n_all + 2) / (2 * F.col("df") + 1).cast("double"))
    ).cast("long")
    weights = (
        lists.where("term is not null")
        .join(distinct, "term", "left_semi")
        .groupBy("term")
        .agg(F.sum("df").alias("df"))
        .select("term", weight.alias("weight"))
    )
    wanted = stored(
        terms.groupBy(F.expr(f"query div {BATCH}").alias("batch"), "term")
        .agg(F.collect_list("query").alias("queries"))
        .join(weights.where("weight > 0"), "term"),
        "lexical-terms",
    )
    n_wanted = wanted.count()
    of_terms = lists.where("term is not null").select("block", "term", "docs", "counts")
    if maybe_broadcast(wanted, n_wanted) is not wanted:
        matched = of_terms.join(F.broadcast(wanted), "term")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        matched = of_terms.withColumn("salt", F.expr(f"cast(hash(block) & {SALTS - 1} as int)")).join(
            wanted.withColumn("salt", salts), ["term", "salt"]
        )
    matched = matched.select("block", "batch", "queries", "weight", "docs", "counts")

    def rank(rows: pd.DataFrame, named: pd.DataFrame) -> pd.DataFrame:
        ids = unpacked(named["docs"].iloc[0], np.int64)
        lengths = unpacked(named["counts"].iloc[0], np.int64)
        least = 8 * (100 - 90 + 90 * lengths * n_all // l_all)
        of_query: dict[int, list[Postings]] = {}
        for queries, w, held, times in zip(rows["queries"], rows["weight"], rows["docs"], rows["counts"]):
            places, tf = unpacked(held, np.int32), unpacked(times, np.int64)
            scores = w * (1_000_000_000 * tf // (1000 * tf + least[places]))
            one = postings(places, scores, len(lengths))
            for query in queries:
                of_query.setdefault(int(query), []).append(one)
        out = []
        for query, some in of_query.items():
            for place, score in zip(*(part.tolist() for part in best(some, len(lengths), k))):
                out.append((query, int(ids[place]) if place < len(ids) else None, score))
        table = pd.DataFrame(out, columns=["query", "doc_id", "score"])
        return table.astype({"query": "int64", "doc_id": "Int64", "score": "int64"})

    matched = stored(matched, "lexical-matched")
    pairs = matched.select("block", "batch").distinct()
    named = pairs.join(blocks.select("block", "docs", "counts"), "block").toDF(
        "in_block", "in_batch", "docs", "counts"
    )
    candidates = (
        matched.groupBy("block", "batch")
        .cogroup(named.groupBy("in_block", "in_batch"))
        .applyInPandas(rank, "query long, doc_id long, score long")
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
held AS (SELECT r, doc_id, len(terms) AS n, terms FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_all, CAST(sum(n) AS BIGINT) AS l_all FROM held),
counts AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM held) GROUP BY r, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0 * n_all + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM counts, totals GROUP BY term, n_all),
asked AS (
  SELECT DISTINCT q, item_id, term FROM (
    SELECT row_number() OVER () AS q, item_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark)),
scored AS (
  SELECT q, item_id, r, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_all) // l_all)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN held USING (r), totals
  GROUP BY q, item_id, r, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
