"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Every pre-token is merged by rank. The possible merges wait in buckets, one per rank,
that hold positions of a linked list of parts. A bitmap of two levels, 256 ranks to a
word, tells which buckets hold anything: finding the first set bit at each level gives
the lowest rank. Entries of parts that have merged since are skipped when they come
up. A pre-token of n bytes takes O(n) queue steps whatever its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, islice

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

# Pre-tokens that a worker keeps with their ids, and the longest one kept. The first
# ones met stay, which are the common ones.
CACHED_PIECES = 1_000_000
CACHED_PIECE_CHARS = 40
# Pre-tokens handled at a time, which bounds the memory a long text takes.
PIECES_AT_A_TIME = 100_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of the parts that are left when no two neighbours can merge.

    The lowest rank merges first, the leftmost pair within a rank.
    """
    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    waiting: list[int | None] = [None] * n
    buckets: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    top = 0
    rank_of = ranks.get
    fresh = [(i, i + 2) for i in range(n - 1)]
    while True:
        for i, end in fresh:
            rank = rank_of(piece[i:end]) if end - i <= longest else None
            waiting[i] = rank
            if rank is None:
                continue
            bucket = buckets.get(rank)
            if bucket:
                heappush(bucket, i)
            else:
                buckets[rank] = [i]
                word = rank >> 8
                low[word] = low.get(word, 0) | 1 << (rank & 255)
                top |= 1 << word
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = word << 8 | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                bits &= bits - 1
                low[word] = bits
                if not bits:
                    top &= top - 1
            if waiting[i] == rank:
                break
        else:
            break
        j = after[i]
        end = after[i] = after[j]
        waiting[j] = waiting[i] = None
        fresh = []
        if end < n:
            before[end] = i
            fresh.append((i, after[end]))
        if before[i] >= 0:
            fresh.append((before[i], end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class ByteBpe:
    """Encodes and decodes by a table of ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {
                base64.b64decode(token): int(rank)
                for token, rank in (line.split() for line in lines if line.strip())
            }
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.pattern = regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        return tuple(merge_by_rank(piece, self.ranks, self.longest))

    def ids_of(self, piece: str) -> tuple[int, ...]:
        ids = self.merge(piece.encode())
        if len(piece) <= CACHED_PIECE_CHARS and len(self.known) < CACHED_PIECES:
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, some pre-tokens at a time."""
        pieces = (match.group() for match in self.pattern.finditer(text))
        if len(text) <= PIECES_AT_A_TIME:
            pieces = iter(self.pattern.findall(text))
        while part := list(islice(pieces, PIECES_AT_A_TIME)):
            known, ids_of = self.known.get, self.ids_of
            yield list(chain.from_iterable([known(p) or ids_of(p) for p in part]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=1)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One for all tasks of a worker process, with the pre-tokens it knows by then."""
    return ByteBpe(path, pattern)


def encode_documents(
    docs: DataFrame,
    ranks: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    with_ids: bool = False,
) -> DataFrame:
    """Ids of every text and what they decode to, as counts and digests.

    Takes ``doc_id`` and ``text``; other columns are ignored. A null or empty text has
    no ids; repeated rows give repeated rows; a null doc_id stays null. ``with_ids``
    adds the ids and the decoded bytes. A text is handled in parts, so that only its
    ids, if asked for, grow with its length.
    """
    path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(path, pattern)
        decimal = {rank: str(rank) for rank in codec.bytes_of}
        for batch in batches:
            counts, digests, decoded_digests, all_ids, all_bytes = [], [], [], [], []
            for text in texts_of(batch.column(1)):
                ids_hash, bytes_hash, n = hashlib.sha256(), hashlib.sha256(), 0
                kept, kept_bytes = [], []
                for ids in codec.encode(text):
                    decoded = codec.decode(ids)
                    if n:
                        ids_hash.update(b",")
                    ids_hash.update(",".join(map(decimal.__getitem__, ids)).encode())
                    bytes_hash.update(decoded)
                    n += len(ids)
                    if with_ids:
                        kept += ids
                        kept_bytes.append(decoded)
                counts.append(n)
                digests.append(ids_hash.hexdigest())
                decoded_digests.append(bytes_hash.hexdigest())
                all_ids.append(kept)
                all_bytes.append(b"".join(kept_bytes))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
                       pa.array(decoded_digests, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_bytes, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = SCHEMA + (", ids array<int>, decoded binary" if with_ids else "")
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, schema)
