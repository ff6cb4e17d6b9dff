"""Chunk reuse against the tokenizers library, with the odd cases."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kilnworks.llm import chunk_bpe
from kilnworks.llm.packing import word_encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(seed):
    rng = random.Random(seed)
    letters = "ab cdeéß\n\t 's're 　 1²½日本語🙂👩‍💻́ st ll%$#-_.,ΣİÅ"
    common = "".join(rng.choices(letters, k=3000))
    passage = " ".join("".join(rng.choices("etaoinshr", k=rng.randint(1, 9))) for _ in range(400))
    out = [None, "", " \n\t", "one", "a" * 30_000, "x" * 5000 + " " + "ab" * 9000, "é" * 20_000]
    out += ["<|endoftext|> x", "a<|startoftext|>b", "y" * 300 + "<|endoftext|>" * 900, "́" * 3000]
    out += ["".join(rng.choices(letters, k=rng.randint(0, 2500))) for _ in range(60)]
    out += [out[-1][:500] + common + tail for tail in ("", "q", " end", "́")]
    out += [str(i) * i + " " + passage + common[i:] for i in range(12)]
    out += ["".join(rng.choices(letters.replace(" ", "").replace("\n", ""), k=20_000)) for _ in range(2)]
    return out


def test_pieces_hold_whole_characters_and_line_up_in_copies():
    for text in texts(1):
        data = (text or "").encode()
        ends = chunk_bpe.cut_points(data)
        assert ends == sorted(set(ends)) and (ends[-1:] == [len(data)] or not data)
        pieces = [data[i:j] for i, j in zip([0, *ends], ends)]
        assert all(len(p) <= chunk_bpe.MOST + 3 for p in pieces)
        assert "".join(p.decode() for p in pieces) == (text or "")
    rng = random.Random(2)
    shared = bytes(rng.choices(b"abcdefgh ", k=20_000))
    cuts = [
        {len(head) - at for at in chunk_bpe.cut_points(head + shared)} for head in (b"", b"xyz" * 100, b"q" * 1000)
    ]
    assert len(set.intersection(*cuts)) > 20


def test_joined_pieces_have_the_ids_of_the_whole(library):
    encoder = word_encoder(PATH)
    rng = random.Random(5)
    for text in texts(3):
        data = (text or "").encode()
        places = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(len(data) // 7 + 1))})
        places = [p for p in places if p == len(data) or data[p] & 0xC0 != 0x80]
        for ends in (chunk_bpe.cut_points(data), places[1:]):
            pieces = [data[i:j] for i, j in zip([0, *ends], ends)]
            coded = [chunk_bpe.code_piece(p, encoder) for p in pieces]
            coded = [chunk_bpe._received(chunk_bpe._sent(one)) for one in coded]
            ids = b"".join(chunk_bpe.joined_ids(pieces, coded, encoder))
            wanted = library.encode(text or "", add_special_tokens=False).ids
            assert list(memoryview(ids).cast("I")) == wanted


def test_documents_have_the_digests_of_the_library(spark, library):
    rows = [(i, t, "en", b"x", "clash", 1) for i, t in enumerate(texts(7))]
    rows += [rows[-1], rows[-1], (None, "no id here", None, None, None, None), (None, None, None, None, None, None)]
    names = "doc_id long, text string, block string, ends binary, digests string, coded int"
    docs = spark.createDataFrame(rows, names).repartition(5)
    shared = chunk_bpe.shared_pieces(chunk_bpe._cut(docs, 4000))
    assert shared.count() > 0
    assert shared.groupBy("digest").agg({"owner": "max"}).count() < shared.count()
    wanted = []
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (" ".join(map(str, ids)), decoded)]
        wanted.append((doc is None, doc, len(ids), *digests, ids, decoded))
    for block_bytes in (4000, chunk_bpe.BLOCK_BYTES):
        got = chunk_bpe.encode_documents(docs, with_ids=True, block_bytes=block_bytes).collect()
        got = [(r.doc_id is None, *r) for r in got]
        assert sorted(got, key=str) == sorted(wanted, key=str)
    assert chunk_bpe.encode_documents(docs.limit(0)).count() == 0
    assert chunk_bpe.encode_documents(docs).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
