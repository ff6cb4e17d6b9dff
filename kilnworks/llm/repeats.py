"""Removes byte strings that occur elsewhere, by merging Burrows-Wheeler transforms.

1. Every text is hashed at all positions; a sample of positions that depends on the
   bytes there alone, the anchors, is counted over the corpus. A string of MATCH bytes
   can only recur if all anchors in it do, which leaves few candidates.
2. A candidate belongs to its least anchor. Runs of candidates of one anchor are cut out
   as strings and sent to a partition by anchor; equal strings are sent once.
3. There the strings of a few chunks make a shard. A shard's strings are read in steps
   of STRIDE bytes, each symbol the hash of the bytes from there on, so that four
   symbols span MATCH bytes. Its suffixes are sorted and give its transform. The shards'
   transforms are merged by refining their interleave: each round prepends a symbol to
   every suffix by a stable sort of the transforms' symbols, and splits the intervals of
   equal prefixes. After four rounds the intervals of more than one suffix are the
   repeated strings. No suffixes are sorted anew.
4. Candidates without an anchor, and those of an anchor that is very frequent, are
   instead compared by 128-bit hashes, equal ones counted once per chunk: which way a
   string goes depends on its bytes and its anchor's count alone.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, stored, stored_by, under_safe_names, unpacked

MATCH = 400
SYMBOLS = 4
# One position in so many is an anchor.
SPARSE = 32
# Anchors more frequent than this take the way of step 4.
FREQUENT = 512
SHARDS = 8
CHUNK_BYTES = 4 << 20
# Buckets of a partition are handled one after the other, each in memory.
BUCKETS_PER_PARTITION = 6

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_ROW = "_row"


class Hashes:
    """Hashes of all substrings of a buffer of one length."""

    def __init__(self, data: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        of_byte = rng.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
        base = int(rng.integers(0, 1 << 62)) << 1 | 1
        with np.errstate(over="ignore"):
            powers = np.full(len(data) + 1, base, np.uint64)
            powers[0] = 1
            np.cumprod(powers, out=powers)
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(of_byte[data] * powers[:-1], out=self.sums[1:])
            self.inverse = np.full(len(data) + 1, pow(base, -1, 1 << 64), np.uint64)
            self.inverse[0] = 1
            np.cumprod(self.inverse, out=self.inverse)

    def of(self, length: int, at=None) -> np.ndarray:
        with np.errstate(over="ignore"):
            if at is None:
                found = (self.sums[length:] - self.sums[:-length]) * self.inverse[: len(self.sums) - length]
            else:
                found = (self.sums[at + length] - self.sums[at]) * self.inverse[at]
            found ^= found >> np.uint64(32)
            found *= np.uint64(0xD6E8FEB86659FD93)
            found ^= found >> np.uint64(29)
        return found


class Chunk:
    """The texts of a chunk that are long enough, one after the other."""

    def __init__(self, rows: pd.DataFrame, match: int):
        rows = rows.sort_values(_ROW)
        self.match, self.gram = match, max(3, match // 8)
        self.texts = [(t or "").encode() for t in rows["text"]]
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.long = np.flatnonzero(lengths >= match)
        data = b"".join(self.texts[i] for i in self.long)
        self.raw, self.data = data, np.frombuffer(data, np.uint8)
        self.ends = np.cumsum(lengths[self.long])
        self.begins = self.ends - lengths[self.long]

    def anchors(self, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys; the keys are even."""
        keys = hashes.of(self.gram)
        at = np.flatnonzero(keys % np.uint64(SPARSE * 2) < np.uint64(2))
        owner = np.searchsorted(self.ends, at, "right")
        at = at[at + self.gram <= self.ends[owner]]
        return at, keys[at] // np.uint64(2) * np.uint64(2)

    def candidates(self, at: np.ndarray, keys: np.ndarray, status: np.ndarray):
        """Starts of candidate strings and the least anchor's key, odd if frequent."""
        span = self.match - self.gram
        alone = at[status == 0]
        marks = np.concatenate([self.begins - 1, alone, self.ends - self.gram + 1])
        last = np.concatenate([np.zeros(len(marks) - len(self.ends), bool), np.ones(len(self.ends), bool)])
        order = np.argsort(marks, kind="stable")
        marks, last = marks[order], last[order]
        low, high = marks[:-1] + 1, marks[1:] - span - 1
        good = ~last[:-1] & (high >= low)
        low, high = low[good], high[good]
        if not len(low):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sizes = high - low + 1 + span
        offsets = np.cumsum(sizes) - sizes
        least = np.full(int(sizes.sum()), _NONE)
        kept = status > 0
        spots, values = at[kept], keys[kept] | (status[kept] == 2).astype(np.uint64)
        span_of = np.searchsorted(low, spots, "right") - 1
        # An anchor can lie in two spans, which may overlap.
        for back in (0, 1):
            known = span_of >= back
            here = np.where(known, span_of - back, 0)
            inside = known & (spots - low[here] < sizes[here]) & (spots >= low[here])
            least[(offsets[here] + spots - low[here])[inside]] = values[inside]
        width = 1
        while width < span + 1:
            step = min(width, span + 1 - width)
            least[:-step] = np.minimum(least[:-step], least[step:])
            width += step
        place = np.arange(len(least)) - np.repeat(offsets, sizes)
        starts = place + np.repeat(low, sizes)
        window = place <= np.repeat(high - low, sizes)
        return starts[window], least[window]


def _runs(starts: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and sizes of runs of consecutive starts with equal ``same``."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], (np.diff(starts) != 1) | (same[1:] != same[:-1])])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(starts)))


class Shard:
    """Strings read in steps of ``stride``, with their transform."""

    def __init__(self, strings: list[bytes], match: int):
        stride = max(1, match // SYMBOLS)
        symbol = match - (SYMBOLS - 1) * stride
        sizes = np.array([len(s) for s in strings], np.int64) - symbol + 1
        whole = np.frombuffer(b"".join(strings), np.uint8)
        hashes = Hashes(whole, 5).of(symbol) | np.uint64(1)
        from_byte = np.cumsum(sizes + symbol - 1) - (sizes + symbol - 1)
        nodes = sizes + stride
        self.begins = np.cumsum(nodes) - nodes
        n = int(nodes.sum())
        place = np.arange(n) - np.repeat(self.begins, nodes)
        real = place < np.repeat(sizes, nodes)
        symbols = np.zeros(n, np.uint64)
        symbols[real] = hashes[(place + np.repeat(from_byte, nodes))[real]]
        # Suffix order by doubling; the ends, all different, come first.
        following = np.where(real, np.arange(n) + stride, np.arange(n))
        rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        n_ends = int((~real).sum())
        rank = np.where(real, rank + n_ends, (~real).cumsum() - 1)
        while True:
            pairs = rank * (2 * n + 2) + np.where(real, rank[following] + 1, 0)
            distinct, rank = np.unique(pairs, return_inverse=True)
            if len(distinct) == n:
                break
            real, following = real & real[following], following[following]
        self.places = np.empty(n, np.int64)
        self.places[rank] = np.arange(n)
        inside = place >= stride
        before = np.zeros(n, np.uint64)
        before[inside] = symbols[np.flatnonzero(inside) - stride]
        self.transform = before[self.places]


def merge(shards: list[Shard], rounds: int = SYMBOLS) -> list[np.ndarray]:
    """For every place of every shard, whether its first symbols recur anywhere."""
    sizes = [len(s.transform) for s in shards]
    source = np.repeat(np.arange(len(shards)), sizes)
    transforms = np.concatenate([s.transform for s in shards])
    interval = np.zeros(len(source), np.int64)
    for _ in range(rounds):
        by_shard = np.argsort(source, kind="stable")
        symbols = np.empty(len(source), np.uint64)
        symbols[by_shard] = transforms
        order = np.argsort(symbols, kind="stable")
        symbols, above = symbols[order], interval[order]
        split = (symbols[1:] != symbols[:-1]) | (above[1:] != above[:-1])
        source = source[order]
        interval = np.concatenate([[0], split.cumsum()])
    often = np.bincount(interval)[interval] > 1
    out = []
    for k, shard in enumerate(shards):
        found = np.empty(len(shard.places), bool)
        found[shard.places] = often[source == k]
        out.append(found)
    return out


def repeated_windows(strings: list[bytes], match: int) -> list[np.ndarray]:
    """For different strings: which of each one's windows recur in any of them."""
    n_shards = min(SHARDS, len(strings))
    dealt = [list(range(k, len(strings), n_shards)) for k in range(n_shards)]
    shards = [Shard([strings[i] for i in part], match) for part in dealt]
    out: list = [None] * len(strings)
    for part, shard, found in zip(dealt, shards, merge(shards)):
        for i, begin in zip(part, shard.begins):
            out[i] = found[begin : begin + len(strings[i]) - match + 1]
    return out


ASKED = "bucket int, chunk long, kind int, a binary, b binary, c binary, d binary, e binary"
_ASKED = [part.split()[0] for part in ASKED.split(", ")]


class Repeats:
    def __init__(self, docs: DataFrame, match: int = MATCH, frequent: int = FREQUENT):
        self.match, self.frequent = match, frequent
        self.names = docs.columns
        partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.n_buckets = BUCKETS_PER_PARTITION * partitions
        self.chunks = stored_by(self._cut(docs), "repeats-chunks", "_chunk")
        self.found = self._found()

    def _cut(self, docs: DataFrame) -> DataFrame:
        names = self.names
        where = names.index("text")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, made, size, row = TaskContext.get().partitionId(), 0, 0, 0
            for batch in batches:
                chunks, rows = [], []
                for length in pa.compute.binary_length(batch.column(where)).to_pylist():
                    if size and size + (length or 0) > CHUNK_BYTES:
                        made, size, row = made + 1, 0, 0
                    chunks.append(task << 24 | made)
                    rows.append(row)
                    size, row = size + (length or 0), row + 1
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(chunks, pa.int64()), pa.array(rows, pa.int64())],
                    [*names, "_chunk", _ROW],
                )

        marked = docs.withColumns({"_chunk": F.lit(0).cast("long"), _ROW: F.lit(0).cast("long")})
        return docs.mapInArrow(cut, marked.schema)

    def _replied(self, asked: DataFrame, answer, schema: str, label: str) -> DataFrame:
        return stored(asked.groupBy("bucket").applyInPandas(answer, schema), label)

    def _found(self) -> DataFrame:
        """Runs of starts of repeated strings: per chunk, first starts and sizes."""
        match, n_buckets, frequent = self.match, self.n_buckets, self.frequent
        texts = self.chunks.select("_chunk", _ROW, "text")

        def ask_anchors(rows: pd.DataFrame) -> pd.DataFrame:
            chunk = Chunk(rows, match)
            out = []
            if len(chunk.long):
                _, keys = chunk.anchors(Hashes(chunk.data, 1))
                distinct, counts = np.unique(keys, return_counts=True)
                bucket = (distinct // np.uint64(2) % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                name = int(rows["_chunk"].iloc[0])
                for b, i, j in zip(range(n_buckets), cuts, cuts[1:]):
                    if i < j:
                        part = order[i:j]
                        out.append((b, name, packed(distinct[part]), packed(np.minimum(counts[part], 60_000).astype(np.uint16))))
            return pd.DataFrame(out, columns=["bucket", "chunk", "keys", "counts"])

        def answer_anchors(rows: pd.DataFrame) -> pd.DataFrame:
            keys = [unpacked(b, np.uint64) for b in rows["keys"]]
            counts = np.concatenate([unpacked(b, np.uint16) for b in rows["counts"]])
            distinct, owner = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.bincount(owner, counts, len(distinct))
            status = (totals > 1).astype(np.uint8) + (totals > frequent).astype(np.uint8)
            parts = np.split(status[owner], np.cumsum([len(k) for k in keys])[:-1])
            return pd.DataFrame(
                {"bucket": rows["bucket"], "chunk": rows["chunk"], "status": [packed(p) for p in parts]}
            )

        asked = texts.groupBy("_chunk").applyInPandas(
            ask_anchors, "bucket int, chunk long, keys binary, counts binary"
        )
        schema = "bucket int, chunk long, status binary"
        known = self._replied(asked, answer_anchors, schema, "repeats-anchors")

        def ask(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
            chunk = Chunk(rows, match)
            if not len(chunk.long):
                return pd.DataFrame([], columns=_ASKED)
            name = int(rows["_chunk"].iloc[0])
            hashes = Hashes(chunk.data, 1)
            at, keys = chunk.anchors(hashes)
            distinct, owner = np.unique(keys, return_inverse=True)
            bucket = (distinct // np.uint64(2) % np.uint64(n_buckets)).astype(np.int64)
            status = np.empty(len(distinct), np.uint8)
            replies = replies.sort_values("bucket")
            known = [unpacked(b, np.uint8) for b in replies["status"]]
            if known:
                status[np.argsort(bucket, kind="stable")] = np.concatenate(known)
            starts, least = chunk.candidates(at, keys, status[owner])
            out = []
            odd = (least & np.uint64(1)).astype(bool)
            hashed = starts[odd]
            if len(hashed):
                one = hashes.of(match, hashed)
                two = Hashes(chunk.data, 2).of(match, hashed)
                order = np.lexsort((two, one, (one % np.uint64(n_buckets)).astype(np.int64)))
                one, two, hashed = one[order], two[order], hashed[order]
                new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
                first = np.flatnonzero(new)
                counts = np.diff(np.append(first, len(one)))
                bucket = (one[first] % np.uint64(n_buckets)).astype(np.int64)
                cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))
                ends = np.append(first, len(one))
                for b, i, j in zip(range(n_buckets), cuts, cuts[1:]):
                    if i < j:
                        pairs = np.column_stack([one[first[i:j]], two[first[i:j]]])
                        out.append((b, name, 0, packed(pairs), packed(counts[i:j]), packed(hashed[ends[i] : ends[j]]), None, None))
            plain, key = starts[~odd], least[~odd]
            first, sizes = _runs(plain, key)
            places_of: dict[int, list[int]] = {}
            for place, k in zip(at.tolist(), keys.tolist()):
                places_of.setdefault(k, []).append(place)
            dealt: dict[int, dict[bytes, tuple[int, list[int]]]] = {}
            for begin, size, k in zip(plain[first].tolist(), sizes.tolist(), key[first].tolist()):
                string = chunk.raw[begin : begin + size - 1 + match]
                # Odd if the anchor comes up more than once in the string.
                known = places_of[k]
                end = begin + size - 1 + match - chunk.gram
                several = bisect_right(known, end) - bisect_left(known, begin) > 1
                strings = dealt.setdefault(k // 2 % n_buckets, {})
                strings.setdefault(string, (k | several, []))[1].append(begin)
            for b, strings in dealt.items():
                places = np.array([p for _, some in strings.values() for p in some], np.int64)
                counts = np.array([len(some) for _, some in strings.values()], np.int64)
                owners = np.array([k for k, _ in strings.values()], np.uint64)
                lengths = np.array([len(s) for s in strings], np.int64)
                whole = np.frombuffer(b"".join(strings), np.uint8)
                out.append((b, name, 1, packed(whole), packed(counts), packed(places), packed(lengths), packed(owners)))
            return pd.DataFrame(out, columns=_ASKED)

        def answer(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            hashed = rows[rows["kind"] == 0]
            if len(hashed):
                pairs = [unpacked(b, np.uint64).reshape(-1, 2) for b in hashed["a"]]
                counts = [unpacked(b, np.int64) for b in hashed["b"]]
                both = np.concatenate(pairs)
                order = np.lexsort((both[:, 1], both[:, 0]))
                ordered = both[order]
                new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(1)])
                owner = np.empty(len(both), np.int64)
                owner[order] = new.cumsum() - 1
                often = np.bincount(owner, np.concatenate(counts)) > 1
                ends = np.cumsum([len(p) for p in pairs])[:-1]
                for chunk, mine, n, places in zip(hashed["chunk"], np.split(owner, ends), counts, hashed["c"]):
                    places = np.sort(unpacked(places, np.int64)[np.repeat(often[mine], n)])
                    first, sizes = _runs(places, np.zeros(len(places)))
                    if len(first):
                        out.append((chunk, packed(places[first]), packed(sizes)))
            owned: dict[bytes, list] = {}
            anchor_of: dict[bytes, int] = {}
            for row in rows[rows["kind"] == 1].itertuples():
                lengths = unpacked(row.d, np.int64)
                whole, ends = unpacked(row.a, np.uint8).tobytes(), np.cumsum(lengths)
                counts, places = unpacked(row.b, np.int64), unpacked(row.c, np.int64)
                split = np.split(places, np.cumsum(counts)[:-1])
                keys = unpacked(row.e, np.uint64).tolist()
                for begin, end, some, k in zip((ends - lengths).tolist(), ends.tolist(), split, keys):
                    owned.setdefault(whole[begin:end], []).append((row.chunk, some))
                    anchor_of[whole[begin:end]] = k
            if owned:
                # A string alone with its anchor shares windows with no other string.
                strings_of = Counter(k // 2 for k in anchor_of.values())
                compared = sorted(s for s, k in anchor_of.items() if k % 2 or strings_of[k // 2] > 1)
                found = dict(zip(compared, repeated_windows(compared, match))) if compared else {}
                marks: dict[int, list] = {}
                for string, places in owned.items():
                    if sum(len(some) for _, some in places) > 1:
                        windows = np.ones(len(string) - match + 1, bool)
                    elif string in found:
                        windows = found[string]
                    else:
                        continue
                    hits = np.flatnonzero(windows)
                    first, sizes = _runs(hits, np.zeros(len(hits)))
                    for chunk, some in places:
                        for begin in some.tolist():
                            marks.setdefault(chunk, []).append((hits[first] + begin, sizes))
                for chunk, some in marks.items():
                    out.append((chunk, packed(np.concatenate([s for s, _ in some])), packed(np.concatenate([n for _, n in some]))))
            return pd.DataFrame(out, columns=["chunk", "starts", "sizes"])

        asked = texts.groupBy("_chunk").cogroup(known.groupBy("chunk")).applyInPandas(ask, ASKED)
        return self._replied(asked, answer, "chunk long, starts binary, sizes binary", "repeats-found")

    def _cover(self, handle, source: DataFrame, schema) -> DataFrame:
        """``handle`` gets a chunk's rows, their bytes, and for each the bytes to remove."""
        match = self.match

        def cover(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(_ROW)
            chunk = Chunk(rows, match)
            gone: list = [None] * len(rows)
            if len(found):
                edges = np.zeros(len(chunk.data) + 1, np.int64)
                for starts, sizes in zip(found["starts"], found["sizes"]):
                    starts, sizes = unpacked(starts, np.int64), unpacked(sizes, np.int64)
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + sizes - 1 + match, -1)
                hit = edges.cumsum()[:-1] > 0
                for i, begin, end in zip(chunk.long, chunk.begins, chunk.ends):
                    if hit[begin:end].any():
                        gone[i] = hit[begin:end]
            return handle(rows, chunk.texts, gone)

        sides = source.groupBy("_chunk").cogroup(self.found.groupBy("chunk"))
        return sides.applyInPandas(cover, schema)

    def digests(self) -> DataFrame:
        def handle(rows: pd.DataFrame, texts: list[bytes], gone: list) -> pd.DataFrame:
            out = []
            for doc, text, hit in zip(rows["doc_id"], texts, gone):
                removed = spans = 0
                left = text
                if hit is not None:
                    removed = int(hit.sum())
                    spans = int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum())
                    left = np.frombuffer(text, np.uint8)[~hit].tobytes()
                digest = hashlib.sha256(left).hexdigest()
                out.append((doc, len(text), removed, spans, digest, removed > 0))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeated"]
            return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

        schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeated boolean"
        return self._cover(handle, self.chunks.select("_chunk", _ROW, "doc_id", "text"), schema)

    def kept(self) -> DataFrame:
        """All columns, ``text`` without the repeated bytes; cut characters go whole."""
        names = self.names

        def handle(rows: pd.DataFrame, texts: list[bytes], gone: list) -> pd.DataFrame:
            new = [
                old if hit is None
                else np.frombuffer(text, np.uint8)[~hit].tobytes().decode(errors="ignore")
                for old, text, hit in zip(rows["text"], texts, gone)
            ]
            return rows.assign(text=new)[names]

        return self._cover(handle, self.chunks, self.chunks.select(*names).schema)


def repeated_bytes(docs: DataFrame, match: int = MATCH, frequent: int = FREQUENT) -> DataFrame:
    """Counts of every row's repeated bytes, and the digest of the others.

    Takes ``doc_id`` and ``text``; other columns are ignored. A byte goes if a string
    of ``match`` bytes over it also starts anywhere else; ``repeated`` says whether any
    goes. Very long texts are handled in a chunk of their own. Null and empty texts have
    nothing to remove; repeated rows repeat each other; a null doc_id stays null.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return Repeats(source, match, frequent).digests()


def remove_repeats(docs: DataFrame, match: int = MATCH) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``; no row goes.

    Other columns stay as they are, whatever their names. A null text stays null, an
    empty one empty; of repeated rows each is a document, so their whole texts go; very
    long texts are handled in parts of a chunk of their own.
    """

    def run(rows: DataFrame) -> DataFrame:
        # Whole numbers pass the tasks as text, for with nulls they would become doubles.
        whole = {c: k for c, k in rows.dtypes if k in ("bigint", "int", "smallint", "tinyint")}
        kept = Repeats(rows.withColumns({c: F.col(c).cast("string") for c in whole}), match).kept()
        return kept.withColumns({c: F.col(c).cast(k) for c, k in whole.items()})

    return under_safe_names(docs, ("text",), run)
