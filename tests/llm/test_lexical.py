"""Ranked search against a plain loop over all documents, with the odd cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kilnworks.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow_search(docs, items, k=10):
    held = [(doc, slow_terms(text)) for doc, text in docs]
    held = [(doc, Counter(terms), len(terms)) for doc, terms in held if terms]
    n_all, l_all = len(held), sum(n for _, _, n in held)
    df = Counter(term for _, counts, _ in held for term in counts)
    out = []
    for item, text in items:
        scored = []
        for doc, counts, n in held:
            m = 100 - 90 + 90 * n * n_all // l_all
            score = sum(
                math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
                for t in set(slow_terms(text))
                if t in counts
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1):
            out.append((item, rank, doc, -score))
    return out


def test_terms_are_those_of_the_pattern():
    rng = random.Random(3)
    letters = "aZé日\x80\x00\x7f @[`{/:09_-\n\t🙂ß́"
    for _ in range(500):
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        assert [t.decode() for t in lexical.terms_of(text.encode())] == slow_terms(text)


@pytest.mark.parametrize("short", [0, 5, 100, 10_000])
def test_best_of_a_block_is_that_of_all_sums(short):
    rng = np.random.default_rng(short)
    for _ in range(150):
        n_docs = int(rng.integers(1, 1500))
        lists, total = [], np.zeros(n_docs, np.int64)
        for _ in range(rng.integers(1, 9)):
            docs = np.flatnonzero(rng.random(n_docs) < rng.choice([0.002, 0.05, 0.6]))
            scores = rng.integers(1, rng.choice([3, 1000]), len(docs))
            if len(docs):
                total[docs] += scores
                lists.append(lexical.postings(docs, scores, n_docs))
        if lists:
            k = int(rng.integers(1, 12))
            order = np.lexsort([np.arange(n_docs), -total])
            order = order[total[order] > 0][:k]
            found, scores = lexical.best(lists, n_docs, k, short)
            assert found.tolist() == order.tolist() and scores.tolist() == total[order].tolist()


def test_hopeless_windows_are_not_read(monkeypatch):
    n_docs = 20_000
    everywhere = np.arange(n_docs)
    rare = lexical.postings(np.array([40]), np.array([1_000_000]), n_docs)
    common = lexical.postings(everywhere, np.ones(n_docs, np.int64), n_docs)
    read = []
    monkeypatch.setattr(lexical.np, "lexsort", lambda keys, f=np.lexsort: (read.append(1), f(keys))[1])
    found, scores = lexical.best([rare, common], n_docs, 1)
    assert (found.tolist(), scores.tolist(), len(read)) == ([40], [1_000_001], 1)


@pytest.mark.parametrize("told, rows, docs_a_block", [(200_000, 200_000, 1 << 15), (0, 0, 7)])
def test_search_ranks_as_the_loop_does(spark, monkeypatch, told, rows, docs_a_block):
    monkeypatch.setattr(lexical, "TOLD_TERMS", told)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", docs_a_block)
    if not rows:
        monkeypatch.setattr(lexical, "maybe_broadcast", lambda df, n: df)
    rng = random.Random(8)
    words = ["one", "Two", "three,", "vier-fünf", "日本", "x1", "the", "the", "the", "rare%d"]

    def made(n):
        return " ".join(w % rng.randint(0, 60) if "%d" in w else w for w in rng.choices(words, k=n))

    docs = [(i, made(rng.randint(0, 30)), "clash", 1.5) for i in range(120)]
    docs += [(500, None, None, None), (501, "", "", 0.0), (None, made(9), "z", 0.0), (None, made(9), "z", 0.0)]
    docs += [docs[5], docs[5], (502, made(30_000), "", 0.0), (503, " .,\n", "", 0.0)]
    items = [(i, made(rng.randint(1, 12)), 3) for i in range(20)]
    items += [(50, None, 1), (51, "", 1), (52, "absent", 1), (None, "one rare5", 1), items[0], items[0]]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string, term string, score double").repartition(3)
    items_df = spark.createDataFrame(items, "item_id long, text string, rank int")
    got = sorted(map(tuple, lexical.search(docs_df, items_df).collect()), key=str)
    assert got == sorted(slow_search([d[:2] for d in docs], [i[:2] for i in items]), key=str)
    assert lexical.search(docs_df.limit(0), items_df).count() == 0
    assert lexical.search(docs_df, items_df.limit(0)).count() == 0
