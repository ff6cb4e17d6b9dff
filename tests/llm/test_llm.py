"""Operators against brute force, libraries and round trips, with the odd cases."""

import base64
import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from kilnworks.llm import (
    byte_bpe, html_text, katz, line_dedup, mtree, packing, quality, repeats, simhash, toxicity,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing names."""
    rng = random.Random(4)
    words = ["one", "Two", "three,", "vier", "cinq.", "日本", "é", "x" * 60]
    texts = [None, "", " \n\t", "one", "a" * 3000, " ".join(rng.choices(words, k=4000))]
    texts += [" ".join(rng.choices(words, k=n)) + "\n" + " ".join(rng.choices(words, k=n)) for n in range(30)]
    rows = [(i, t, None if i % 7 == 0 else "en", "s", i, "clash") for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "no id here", None, None, 0, None), (200, texts[20], "en", "s", 1, "z")]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score string"
    ).repartition(3)


def texts_by_id(docs):
    out = collections.defaultdict(list)
    for row in docs.select("doc_id", "text").collect():
        out[row.doc_id].append(row.text or "")
    return out


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def codec():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    wanted = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe.ByteBpe(path, public_tokenizers.PATTERN), wanted


def test_bpe_merges_as_the_library_does(codec):
    own, wanted = codec
    rng = random.Random(1)
    letters = "ab cdeéß\n\t  \x1c'1²½日本語🙂👩‍💻́ st ll re%$#-_aeiounrs"
    cases = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(1500)]
    cases += ["ab" * 10_000 + "aaaa" * 3000, "<|endoftext|>", "z" * 5000]
    for text in cases:
        ids = [i for part in own.encode(text) for i in part]
        assert ids == wanted.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_bpe_query_digests(spark, odd, codec):
    _, wanted = codec
    texts = texts_by_id(odd)
    rows = byte_bpe.encode_documents(odd).collect()
    assert len(rows) == odd.count()
    for row in rows:
        text = texts[row.doc_id][0]
        ids = wanted.encode_ordinary(text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.encode_documents(odd.limit(0)).count() == 0


def test_packing_covers_every_id_once(spark, odd):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    special = spark.createDataFrame(
        [(1, "<|endoftext|> x"), (2, "a<|startoftext|>b <|ENDOFTEXT|>"), (3, "<|endoftext |> <|endoftext|>\n")],
        "doc_id long, text string",
    )
    for docs in (special, odd.where("doc_id is not null").dropDuplicates(["doc_id"]), documents(spark)):
        rows = packing.pack(docs).collect()
        pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
        for row in rows:
            pieces[row.doc_id].append(row)
            sequences[row.sequence_id].append(row)
        for doc, texts in texts_by_id(docs).items():
            ids = np.array(tokenizer.encode(texts[0], add_special_tokens=False).ids + [1], "<u4")
            at = 0
            for row in sorted(pieces[doc], key=lambda r: r.start):
                assert (row.start, row.doc_tokens) == (at, len(ids))
                assert row.ids_crc32 == zlib.crc32(ids[at : at + row.length].tobytes())
                at += row.length
            assert at == len(ids)
        for some in sequences.values():
            at = 0
            for row in sorted(some, key=lambda r: r.offset):
                assert row.offset == at
                at += row.length
            assert at <= packing.WINDOW
    assert packing.pack(odd).where("doc_id is null").count() == 1
    assert packing.pack(odd.limit(0)).count() == 0


def slow_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = WORD.findall(text)
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components_are_all_pairs_components(spark, odd):
    for docs in (documents(spark), odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        prints = {doc: slow_print(t[0]) for doc, t in texts_by_id(docs).items()}
        least = {doc: doc for doc in prints}

        def find(x):
            while least[x] != x:
                x = least[x]
            return x

        ids = sorted(prints)
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    a_, b_ = find(a), find(b)
                    least[max(a_, b_)] = min(a_, b_)
        for row in simhash.near_duplicates(docs).collect():
            assert row.fingerprint == f"{prints[row.doc_id]:016x}"
            assert row.component_id == find(row.doc_id)
        kept = simhash.keep_first(docs)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {find(i) for i in ids}
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_simhash_blocks_with_many_fingerprints(spark, monkeypatch):
    rng = random.Random(2)
    base = rng.getrandbits(62)
    values = {base ^ 1 << rng.randrange(62) ^ 1 << rng.randrange(62) for _ in range(300)} | {base}
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    wanted = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}
    for most in (10_000, 8):
        monkeypatch.setattr(simhash, "LARGEST_BLOCK", most)
        assert {tuple(r) for r in simhash.links(nodes).collect()} == wanted


def slow_repeats(rows, size):
    seen = collections.Counter()
    for text in rows:
        seen.update(text[i : i + size] for i in range(len(text) - size + 1))
    out = []
    for text in rows:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - size + 1):
            if seen[text[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        left = np.frombuffer(text, np.uint8)[~gone].tobytes()
        out.append((len(text), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("size,frequent", [(400, 512), (400, 2), (57, 3), (8, 2)])
def test_repeats_are_those_of_brute_force(spark, odd, size, frequent):
    for docs in (odd, documents(spark)) if size == 400 else (odd,):
        wanted = slow_repeats([t.encode() for some in texts_by_id(docs).values() for t in some], size)
        got = repeats.repeated_bytes(docs, size, frequent).collect()
        assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == wanted
    kept = repeats.remove_repeats(odd, size)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert repeats.repeated_bytes(odd.limit(0), size).count() == 0


def test_merged_transforms_find_repeated_windows():
    rng = random.Random(3)
    for _ in range(20):
        pool = bytes(rng.choices(b"ab", k=60))
        strings = {pool[rng.randint(0, 20) : rng.randint(35, 60)] + bytes(rng.choices(b"abc", k=9)) for _ in range(12)}
        strings = sorted(s for s in strings if len(s) >= 12)
        seen = collections.Counter(s[i : i + 12] for s in strings for i in range(len(s) - 11))
        for s, found in zip(strings, repeats.repeated_windows(strings, 12)):
            assert [seen[s[i : i + 12]] > 1 for i in range(len(s) - 11)] == list(found)


def test_line_dedup_is_that_of_all_pairs(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    base = [rng.sample(words, rng.randint(1, 25)) for _ in range(12)]
    rows = [(None, "a b c d e\n\nzz"), (500, None), (501, ""), (502, " \n\t")]
    for k in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(rng.choice([" ".join(line), "", "  "]))
        rows.append((k, "\n".join(lines)))
    earlier, wanted = [], {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        kept = []
        for line in (text or "").split("\n"):
            found = frozenset(WORD.findall(line))
            if not found or not any(9 * len(found & e) >= 4 * (len(found) + len(e)) for e in earlier):
                kept.append(line)
            if found:
                earlier.append(found)
        wanted[doc] = None if text is None else "\n".join(kept)
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, place long").repartition(3)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert {r.doc_id: r.text for r in out.collect()} == wanted
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_variants_of_a_line_do_not_all_meet(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"base{i}" for i in range(60)]
    others = [f"other{i}" for i in range(40)]
    rows = []
    for i in range(120):
        # The words put in are rarer than those of the line, but say nothing of its variants.
        words = base[:]
        for at in rng.sample(range(60), 4):
            words[at] = rng.choice(others)
        rows.append((i, " ".join(words)))
    pairs = []

    def counted(rows):
        out = line_dedup_candidates(rows)
        pairs.append(out.count())
        return out

    line_dedup_candidates = line_dedup._candidates
    monkeypatch.setattr(line_dedup, "_candidates", counted)
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = {i: set(text.split()) for i, text in rows}
    alike = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    gone = {i for i, _ in rows if any(alike(i, j) for j in range(i))}
    assert {r.doc_id for r in out if r.n_removed} == gone and len(gone) > 80
    assert pairs[0] < 8 * len(rows)


def test_line_dedup_of_rows_without_an_id_of_their_own(spark):
    rng = random.Random(6)
    pool = [" ".join(rng.sample([f"v{i}" for i in range(40)], 10)) for _ in range(25)]
    rows = [(None, "first of null\n" + pool[0]), (None, "another beginning\n" + pool[1]), (None, "x y z\n\nx y z")]
    for doc in [None] * 8 + [7] * 15 + list(range(12)):
        lines = [rng.choice(pool + ["", f"own line {rng.random()}"]) for _ in range(rng.randint(1, 6))]
        lines = [re.sub("v3 ", "", x) if rng.random() < 0.3 else x for x in lines]
        rows.append((doc, "\n".join(lines)))
    rows += [rows[5], rows[5], (7, None), (7, None)]
    tie = lambda text: xxhash.xxh64_intdigest(text, seed=42) if text is not None else 42
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    earlier, wanted = [], []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(tie(r[1])))):
        lines = [] if text is None else text.split("\n")
        kept = []
        for line in lines:
            found = frozenset(WORD.findall(line))
            if not found or not any(9 * len(found & e) >= 4 * (len(found) + len(e)) for e in earlier):
                kept.append(line)
            if found:
                earlier.append(found)
        wanted.append((str(doc), str(None if text is None else "\n".join(kept)), len(lines), len(lines) - len(kept)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = line_dedup.dedup_lines(docs).collect()
    assert sorted((str(r.doc_id), str(r.text), r.n_lines, r.n_removed) for r in out) == sorted(wanted)


@pytest.mark.parametrize("bits", [50, 55, 63])
def test_line_dedup_keeps_the_lines_of_wide_ids(spark, bits):
    rng = random.Random(1)
    ids = {rng.randrange(-(1 << bits - 1), 1 << bits - 1) for _ in range(300)}
    rows = [(i, "\n".join(f"w{rng.random()} w{rng.random()}" for _ in range(97))) for i in ids]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.text) for r in out.collect()} == set(rows)


def test_katz_sums_to_one_and_scores_as_by_hand(spark, odd):
    docs = documents(spark)
    rows = katz.score_documents(docs).collect()
    tokens, held = {}, {}
    for doc, texts in texts_by_id(docs).items():
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[0])
        tokens[doc] = WORD.findall(text) + ["</s>"]
        held[doc] = zlib.crc32(str(doc).encode()) % 7 == 2
    ones, after = collections.Counter(), collections.defaultdict(collections.Counter)
    for doc, words in tokens.items():
        if not held[doc]:
            for a, b in zip(["<s>", *words], words):
                ones[b] += 1
                after[a][b] += 1
    n, v = sum(ones.values()), len(ones)

    def factors(counts):
        of = collections.Counter(counts)
        return katz.Discounts([of[r] for r in range(1, 7)]).factors

    first, second = factors(ones.values()), factors(c for x in after.values() for c in x.values())
    cut = lambda f, c: f[c - 1] if c <= 5 else 1.0
    unknown = 1 - sum(cut(first, c) * c / n for c in ones.values())
    uni = lambda w: cut(first, ones[w]) * ones[w] / n if ones[w] else unknown
    alphas = {}

    def p(a, w):
        seen = after.get(a)
        if not seen:
            return uni(w)
        if a not in alphas:
            total = sum(seen.values())
            if all(cut(second, c) == 1.0 for c in seen.values()):
                total, left = total + 1, 1 / (total + 1)
            else:
                left = 1 - sum(cut(second, c) * c / total for c in seen.values())
            alphas[a] = total, left / (1 - sum(uni(x) for x in seen))
        total, alpha = alphas[a]
        return cut(second, seen[w]) * seen[w] / total if w in seen else alpha * uni(w)

    for a in ["the", "<s>", "of"]:
        assert math.isclose(sum(p(a, w) for w in ones) + p(a, "unheard-of"), 1, rel_tol=1e-9)
    for row in rows:
        words = tokens[row.doc_id]
        assert (row.n_tokens, row.train_tokens, row.held_out) == (len(words), n, held[row.doc_id])
        assert row.n_known == sum(w in ones for w in words)
        assert math.isclose(row.base_score, sum(math.log10((ones[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        score = sum(math.log10(p(a, b)) for a, b in zip(["<s>", *words], words))
        assert math.isclose(row.score, score, rel_tol=1e-9)
    assert katz.score_documents(odd).count() == odd.count()
    assert katz.score_documents(odd.limit(0)).count() == 0


def test_katz_query_backs_off_from_two_words(spark):
    from kilnworks.llm import queries

    words, held = {}, {}
    for doc, texts in texts_by_id(documents(spark)).items():
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[0])
        words[doc] = WORD.findall(text) + ["</s>"]
        held[doc] = zlib.crc32(str(doc).encode()) % 7 == 2
    after = collections.defaultdict(collections.Counter)
    for doc, tokens in words.items():
        padded = ["<s>", "<s>", *tokens]
        for i in range(2, len(padded) if not held[doc] else 0):
            for k in range(3):
                after[tuple(padded[i - k : i])][padded[i]] += 1
    factors = []
    for k in range(3):
        of = collections.Counter(n for c, x in after.items() if len(c) == k for n in x.values())
        factors.append(katz.Discounts([of[r] for r in range(1, 7)]).factors)
    total = sum(after[()].values())
    kept = lambda k, n: n * (factors[k][n - 1] if n <= 5 else 1.0)
    unknown = 1 - sum(kept(0, n) for n in after[()].values()) / total
    weights = {}

    def p(context, w):
        seen = after.get(context)
        if not context:
            return kept(0, seen[w]) / total if w in seen else unknown
        if not seen:
            return p(context[1:], w)
        if context not in weights:
            n, k = sum(seen.values()), len(context)
            left = n - sum(kept(k, c) for c in seen.values())
            if all(c > 5 or factors[k][c - 1] == 1.0 for c in seen.values()):
                n, left = n + 1, 1
            weights[context] = n, left / n / (1 - sum(p(context[1:], x) for x in seen))
        n, alpha = weights[context]
        return kept(len(context), seen[w]) / n if w in seen else alpha * p(context[1:], w)

    for context in [("<s>", "<s>"), ("of", "the"), ("the", "of")]:
        assert math.isclose(sum(p(context, w) for w in after[()]) + p(context, "unheard-of"), 1, rel_tol=1e-9)
    for row in queries.op4_katz(spark, SF).collect():
        padded = ["<s>", "<s>", *words[row.doc_id]]
        score = sum(math.log10(p(tuple(padded[i - 2 : i]), padded[i])) for i in range(2, len(padded)))
        assert math.isclose(row.score, score, rel_tol=1e-8)


def test_top_k_is_exact_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=6).round(1)]) for i in range(900)]
    rows += [(900 + i, rows[5][1]) for i in range(40)]
    bad = [(2000, None), (2100, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2200, [float("nan")] * 6), (None, rows[3][1]), (2300, [])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<double>, score int")
    got = collections.defaultdict(list)
    for row in mtree.top_k(vectors.repartition(3)).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    whole = {i: np.floor(1024 * np.array(x)).astype(np.int64) for i, x in rows}
    for q in [i for i in whole if i % 100 == 0]:
        ranked = sorted(((-int(whole[q] @ x), i) for i, x in whole.items() if i != q))[:10]
        assert got[q] == [(i, -s) for s, i in ranked]
    assert set(got) == {i for i in whole if i % 100 == 0}
    assert mtree.top_k(vectors.limit(0)).count() == 0


def test_quality_counts_and_outliers(spark, odd):
    rows = quality.quality_rules(odd).collect()
    texts = texts_by_id(odd)
    assert len(rows) == odd.count()
    for row in rows:
        text = texts[row.doc_id][0]
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = collections.Counter(three)
        covered = {i + k for i, t in enumerate(three) if often[t] > 1 for k in range(3)}
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (
            len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered),
        )
        assert row.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (row.base_failed and row.kept)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    judged = quality.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    judged = judged.where("not base_failed").join(labels, "doc_id").collect()
    good, poor = [r.kept for r in judged if r.quality], [r.kept for r in judged if not r.quality]
    assert np.mean(good) > 0.99 and np.mean(poor) < 0.1
    assert quality.quality_rules(odd.limit(0)).count() == 0


def test_toxicity_on_the_held_out_fold(spark, odd):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = rows.where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([t > c for t in toxic for c in clean]) > 0.9
    assert np.mean(np.array(clean) < 0.5) > 0.99 and np.mean(np.array(toxic) >= 0.5) > 0.8
    scored = toxicity.score_documents(odd, labels)
    assert scored.count() == odd.count()
    assert scored.where("not held_out and doc_id % 1 = 0 and score between 0 and 1").count() > 0
    assert toxicity.drop_toxic(odd, labels.limit(0)).columns == odd.columns


def test_factorization_machine_learns_a_pair():
    rows = [np.array(r) for r in ([0], [1], [0, 1], [])] * 50
    labels = np.array([0.0, 0, 1, 0] * 50)
    bias, theta = toxicity.fit(rows, labels, np.ones(200), 2)
    model = toxicity.Model(bias, {}, theta)
    both = bias + theta[:, 0].sum() + theta[0, 1:] @ theta[1, 1:]
    assert both > 0 > max(bias + theta[0, 0], bias + theta[1, 0], model.bias)


PAGE = """<html><head><title>x</title></head><body class="no-sidebar"><header><h1>Site</h1></header>
<nav><a>n</a></nav><div class="cookie-notice">c</div><main><article id=post><header><h1>Title &amp; more</h1>
<span>by me</span></header><p>One <b>two</b>\n three<p>Four<br>five &lt;x&gt; <a href=q>li nk</a><ul><li>i1<li>i2</ul>
<aside>no</aside><div class='share-buttons'>sh</div><script>var a="<p>no</p>";</script><form>f</form>
<section class="comments"><p>bad</p></section></article></main><div class="sidebar">s</div><footer>f</footer>"""


def test_main_text_of_a_marked_article(spark):
    wanted = "Title & more\nOne two three\nFour five <x> li nk\ni1\ni2"
    rows = [(1, "http://a.b/c", PAGE, 1), (2, None, None, 1), (3, "x", "", 1), (3, "x", "", 1)]
    rows += [(4 + i, "http://a.b/d", bad, 1) for i, bad in enumerate(["<", "<p", "&am", "</p>x", "<!-- x", "<script>"])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.text for r in got}[1] == wanted
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_wrapper_tells_the_host_from_the_page():
    whole = None
    for i in range(6):
        page = (
            f"<body><div class=top>About us, all of us</div><div class=c><h2>T{i}</h2>"
            f"<p>Text number {i} is long enough</p><p>Another one {i * 7}</p></div><div class=b>Contact</div>"
        )
        whole = html_text.join_wrappers(whole, {"pages": 1, "tree": html_text.folded(html_text.parse(page).tree)})
    assert html_text.expression(whole["tree"]) == (
        "<body><div.top>text</> <div.c><h2>#</> (<p>#</>)+</> <div.b>text</></>"
    )
    assert html_text.main_text(page, json.dumps(whole)) == "T5\nText number 5 is long enough\nAnother one 35"


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        docs = out
    assert docs.agg({"length": "max"}).first()[0] <= packing.WINDOW


def test_anchors_before_the_only_span_of_a_chunk_are_passed_over():
    chunk = repeats.Chunk(repeats.pd.DataFrame({"_row": [0], "text": ["ab" * 100]}), 80)
    # The anchor at 20 is alone, so no string holds the one at 10.
    at, keys, status = np.array([10, 20]), np.array([4, 6], np.uint64), np.array([1, 0], np.uint8)
    starts, least = chunk.candidates(at, keys, status)
    assert starts.tolist() == list(range(21, 121))
    assert set(least.tolist()) == {2**64 - 1}


def test_repeats_stage_takes_out_passages_of_over_fifty_words(spark):
    import corpus_pipeline

    rng = random.Random(8)
    words = ["of", "the", "kiln", "glaze", "fires", "potter", "and", "earthen", "in", "vessel"]
    rows, wanted = [], []
    for n in range(51, 66):
        passage = " ".join(rng.choices(words, k=n))
        while len(passage) < 250:
            passage = " ".join(rng.choices(words, k=n))
        assert 250 <= len(passage) < 400
        for k in (0, 1):
            # Other letters at both ends: nothing else repeats.
            begin, end = f"{rng.random()}{'xy'[k]}", f"{'pq'[k]}{rng.random()}"
            rows.append((len(rows), f"{begin}\n{passage}\n{end}", len(passage)))
            wanted.append((begin, end))
    rows.append((len(rows), " ".join(rng.choices(words, k=60)), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = sorted(corpus_pipeline.remove_repeats(spark, docs, SF).collect())
    assert out[-1].text == rows[-1][1]
    for row, (begin, end) in zip(out, wanted):
        assert row.text == begin + end
        assert row.n_chars == len(row.text)


def test_names_made_from_titles_drop_nothing():
    kept = [
        "<h2 id='related-work'>Related work</h2>", "<h2 id='social-impact'>Social impact</h2>",
        "<section id='notice-periods'>Notice periods</section>", "<p class='alert'>Mind the kiln</p>",
        "<div id='promotion-rules'>Promotion rules</div>", "<h3 class='share'>The share</h3>",
    ]
    gone = [
        "<p class='ad'>Buy</p>", "<div class='share-buttons'>Send</div>", "<section id='comments'>Me too</section>",
        "<div class='related-posts'>More</div>", "<div class='x newsletter-form'>Join</div>", "<ul class='nav'><li>Up</ul>",
    ]
    page = "<article>" + "".join(a + b for a, b in zip(kept, gone)) + "</article>"
    assert html_text.main_text(page, None) == "\n".join(re.sub("<.*?>", "", k) for k in kept)


def test_main_text_beside_articles_stays():
    page = (
        "<div>Top</div><main><h1>Title</h1><p>Lead.</p><article><p>Body.</p></article>"
        "<article class='card'><p>Card.</p></article><p>End.</p></main><div>Bottom</div>"
    )
    assert html_text.main_text(page, None) == "Title\nLead.\nBody.\nCard.\nEnd."
