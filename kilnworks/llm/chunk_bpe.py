"""Byte-pair encoding and decoding that encodes shared content once.

Texts are cut where a rolling hash of the last bytes has its top bits clear, so equal
passages are cut alike wherever they stand. The pieces are counted over the corpus by
digest. A piece that more than one block of documents holds is encoded once, by the block of documents
that owns it, and its ids are sent to the blocks that hold it; all others are encoded
where they are. Only digests and the ids of shared pieces are shuffled, never the texts.

A cut may fall inside a word. Every piece therefore keeps the ids of what stands before
its first and after its last space apart. Where two pieces meet, the words around the
cut are encoded again, over as many pieces as it takes to reach a space on both sides,
and replace what the pieces held there unless both agree. The tokenizer treats a space
or line end as the end of whatever stands before it, so the result is that of the whole
text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, stored, stored_by, texts_of, unpacked
from .packing import word_encoder

# The rolling hash covers 32 bytes; a cut wants 9 of its bits clear. A piece has at
# least LEAST bytes and at most MOST, which bounds the pieces of texts without cuts.
WINDOW_STEPS = 5
CUT_BITS = 9
LEAST = 64
MOST = 8192
# Bytes of text in a block of documents, which bounds the memory of a task; a longer
# text is a block of its own.
BLOCK_BYTES = 16 << 20
DIGEST = 16

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

_GEAR = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)


def cut_points(data: bytes, bits: int = CUT_BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the pieces of a text in UTF-8; every piece holds whole characters."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    codes = np.frombuffer(data, np.uint8)
    rolled = _GEAR[codes]
    for step in range(WINDOW_STEPS):
        shift = 1 << step
        rolled[shift:] += rolled[:-shift] << np.uint64(shift)
    wanted = np.flatnonzero(rolled >> np.uint64(64 - bits) == 0) + 1
    ends, begin = [], 0
    for at in wanted.tolist() + [n]:
        if at - begin < least and at < n:
            continue
        while at - begin > most:
            begin = _whole(codes, begin + most)
            ends.append(begin)
        at = _whole(codes, at)
        if at > begin:
            ends.append(at)
            begin = at
    return ends


def _whole(codes: np.ndarray, at: int) -> int:
    """The next place from here on that does not part a character."""
    while at < len(codes) and codes[at] & 0xC0 == 0x80:
        at += 1
    return at


def _spaces(piece: bytes) -> tuple[int, int]:
    """First and last place of a space or line end; -1 twice without any."""
    firsts = [at for at in (piece.find(b" "), piece.find(b"\n")) if at >= 0]
    return (min(firsts), max(piece.rfind(b" "), piece.rfind(b"\n"))) if firsts else (-1, -1)


@dataclass(frozen=True)
class Coded:
    """A piece's ids, as packed 32-bit numbers, before, between and after its spaces."""

    head: bytes
    body: bytes
    tail: bytes
    open: bool  # no space at all: the piece is part of one word


def code_piece(piece: bytes, encoder) -> Coded:
    first, last = _spaces(piece)
    if first < 0:
        return Coded(encoder.encode(piece.decode()), b"", b"", True)
    head, body, tail = piece[:first], piece[first:last], piece[last:]
    return Coded(*(encoder.encode(part.decode()) for part in (head, body, tail)), False)


def joined_ids(pieces: list[bytes], coded: list[Coded], encoder) -> Iterator[bytes]:
    """Ids of the text that the pieces make up, its cut words encoded again."""
    held, known = [], []  # the word under way: its parts, and the ids that pieces gave them

    def word() -> bytes:
        alone = b"".join(known)
        if len(held) < 2:
            return alone
        again = encoder.encode(b"".join(held).decode())
        return alone if again == alone else again

    for piece, one in zip(pieces, coded):
        if one.open:
            held.append(piece)
            known.append(one.head)
            continue
        first, last = _spaces(piece)
        if first:
            held.append(piece[:first])
            known.append(one.head)
        yield word()
        yield one.body
        held, known = [piece[last:]], [one.tail]
    yield word()


def _sent(one: Coded) -> bytes:
    sizes = np.array([len(one.head), len(one.body), one.open], "<u4").tobytes()
    ids = np.frombuffer(one.head + one.body + one.tail, "<u4")
    return packed(np.concatenate([np.frombuffer(sizes, np.uint8), ids.astype("<u2").view(np.uint8)]))


def _received(blob: bytes) -> Coded:
    raw = unpacked(blob, np.uint8)
    head, body, is_open = raw[:12].view("<u4").tolist()
    ids = raw[12:].view("<u2").astype("<u4").tobytes()
    return Coded(ids[:head], ids[head : head + body], ids[head + body :], bool(is_open))


def _cut(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Documents in blocks, with the ends of their pieces and a digest of each piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            blocks, ends, digests = [], [], []
            for text in texts_of(batch.column(1)):
                data = text.encode()
                if size and size + len(data) > block_bytes:
                    made, size = made + 1, 0
                size += len(data)
                places = cut_points(data)
                blocks.append(task << 32 | made)
                ends.append(np.array(places, "<i8").tobytes())
                digests.append(
                    b"".join(
                        hashlib.blake2b(data[i:j], digest_size=DIGEST).digest()
                        for i, j in zip([0, *places], places)
                    )
                )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(blocks, pa.int64()), pa.array(ends, pa.binary()), pa.array(digests, pa.binary())],
                ["doc_id", "text", "block", "ends", "digests"],
            )

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, text string, block long, ends binary, digests binary"
    return stored_by(source.mapInArrow(cut, schema), "chunk-bpe-blocks", "block")


def _named(digests: bytes) -> list[bytes]:
    return [digests[i : i + DIGEST] for i in range(0, len(digests), DIGEST)]


def _pieces(rows: pd.DataFrame) -> Iterator[tuple[object, list[bytes], list[bytes]]]:
    """Of each document: its id, its pieces and their digests."""
    for doc, text, ends, digests in zip(rows["doc_id"], rows["text"], rows["ends"], rows["digests"]):
        data = (text or "").encode()
        places = np.frombuffer(ends, "<i8").tolist()
        yield doc, [data[i:j] for i, j in zip([0, *places], places)], _named(digests)


def shared_pieces(blocks: DataFrame) -> DataFrame:
    """(block, digest, owner) of every piece that occurs more than once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block_of = batch.column(0).to_numpy()
            for block in np.unique(block_of):
                some = pc.filter(batch.column(1), pa.array(block_of == block))
                names = np.frombuffer(b"".join(some.to_pylist()), f"V{DIGEST}")
                distinct, counts = np.unique(names, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(distinct), block), pa.int64()),
                        pa.array(_named(distinct.tobytes()), pa.binary()),
                        pa.array(counts, pa.int64()),
                    ],
                    ["block", "digest", "n"],
                )

    counted = blocks.select("block", "digests").mapInArrow(count, "block long, digest binary, n long")
    held = stored(counted.groupBy("digest", "block").agg(F.sum("n").alias("n")), "chunk-bpe-held")
    shared = (
        held.groupBy("digest")
        .agg(F.sum("n").alias("times"), F.count("*").alias("holders"), F.min("block").alias("owner"))
        .where("holders > 1")
        .select("digest", "owner")
    )
    return held.join(shared, "digest").select("block", "digest", "owner")


def encode_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    with_ids: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Ids of every whole text and what they decode to, as counts and digests.

    Takes ``doc_id`` and ``text``; other columns, whatever their names, are ignored. A
    null or empty text has no ids and decodes to nothing; a null doc_id stays null;
    repeated rows give repeated rows; no documents give no rows. A very long text is one
    block, encoded piece by piece. ``with_ids`` adds the ids and the decoded text.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    blocks = _cut(docs, block_bytes)
    shared = stored(shared_pieces(blocks), "chunk-bpe-shared")

    def code_owned(rows: pd.DataFrame, owned: pd.DataFrame) -> pd.DataFrame:
        encoder, wanted, out = word_encoder(path), set(owned["digest"]), []
        if wanted:
            for _, pieces, names in _pieces(rows):
                for piece, name in zip(pieces, names):
                    if name in wanted:
                        wanted.remove(name)
                        out.append((name, _sent(code_piece(piece, encoder))))
        return pd.DataFrame(out, columns=["digest", "coded"])

    owned = shared.where("block = owner").select("block", "digest")
    coded = stored(
        blocks.groupBy("block")
        .cogroup(owned.groupBy("block"))
        .applyInPandas(code_owned, "digest binary, coded binary"),
        "chunk-bpe-coded",
    )
    replies = shared.join(coded, "digest").select("block", "digest", "coded")

    def encode(rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        encoder = word_encoder(path)
        shown = encoder.shown()
        decimal = [str(i) for i in range(len(shown))]
        sent = dict(zip(given["digest"], given["coded"]))
        known: dict[bytes, Coded] = {}
        out = []
        for doc, pieces, names in _pieces(rows):
            coded = []
            for piece, name in zip(pieces, names):
                one = known.get(name)
                if one is None:
                    blob = sent.get(name)
                    one = known[name] = _received(blob) if blob else code_piece(piece, encoder)
                coded.append(one)
            ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
            all_ids, all_text = [], []
            for some in joined_ids(pieces, coded, encoder):
                ids = np.frombuffer(some, "<u4").tolist()
                if not ids:
                    continue
                text = " ".join(map(shown.__getitem__, ids))
                if n:
                    ids_hash.update(b" ")
                    text_hash.update(b" ")
                ids_hash.update(" ".join(map(decimal.__getitem__, ids)).encode())
                text_hash.update(text.encode())
                n += len(ids)
                if with_ids:
                    all_ids += ids
                    all_text.append(text)
            row = (None if pd.isna(doc) else int(doc), n, ids_hash.hexdigest(), text_hash.hexdigest())
            out.append((*row, all_ids, " ".join(all_text)) if with_ids else row)
        table = pd.DataFrame(out, columns=[part.split()[0] for part in schema.split(", ")])
        return table.astype({"doc_id": "Int64"})

    schema = SCHEMA + (", ids array<int>, decoded string" if with_ids else "")
    return (
        blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(encode, schema)
    )
