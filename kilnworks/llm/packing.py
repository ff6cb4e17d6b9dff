"""Packs tokenised documents into windows of fixed length.

Bounded-space online packing: every task keeps a fixed number of open windows. A
document goes to the open window it fills best. If none has room, the fullest window
is topped up with the head of the document and emitted, and the rest is placed in
turn. What is open when a task ends is merged afterwards, a few tasks to a group.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts_of

WINDOW = 2048
OPEN_WINDOWS = 8
TASKS_PER_MERGE = 16
END_ID = 1
# Words that a worker keeps with their ids, and the longest word kept. The first ones
# met stay, which are the common ones.
CACHED_WORDS = 1_000_000
CACHED_WORD_CHARS = 40

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
    " sequence_id long, offset long, ids binary"
)
_NAMES = [part.split()[0] for part in PIECES.split(",")]


class WordEncoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    The tokenizer never merges across a space or line end, and its special strings hold
    neither, so words are encoded apart and kept for the next time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        ends = self.tokenizer.encode_batch_fast(["", ".", ","], add_special_tokens=False)
        self.ends = {
            end: struct.pack(f"<{len(one.ids)}I", *one.ids) for end, one in zip(("", ".", ","), ends)
        }

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        known = self.known
        parts = list(map(known.get, words))
        if None in parts:
            new = {}
            missing = []
            for word in {word for word, part in zip(words, parts) if part is None}:
                # Letters are split from what follows them, and case is dropped.
                base, end = (word[:-1], word[-1]) if word[-1:] in (".", ",") else (word, "")
                if base.isascii() and base.isalpha():
                    part = known.get(base.lower())
                    if part is not None:
                        new[word] = part + self.ends[end]
                        continue
                missing.append(word)
            found = self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)
            for word, one in zip(missing, found):
                new[word] = struct.pack(f"<{len(one.ids)}I", *one.ids)
            parts = [new[w] if part is None else part for w, part in zip(words, parts)]
            if len(known) < CACHED_WORDS:
                known.update((w, p) for w, p in new.items() if len(w) <= CACHED_WORD_CHARS)
        return b"".join(parts)

    def shown(self) -> list[str]:
        """What each id decodes to."""
        return [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One for all tasks of a worker process, with the words it knows by then."""
    return WordEncoder(path)


@dataclass
class Window:
    length: int = 0
    pieces: list[tuple] = field(default_factory=list)


class Packer:
    """The open windows of one task; pieces are (doc, start, ids, doc tokens)."""

    def __init__(self, window: int, open_windows: int, first_sequence: int):
        self.window, self.most = window, open_windows
        self.open: list[Window] = []
        self.sequence = first_sequence
        self.rows: list[tuple] = []

    def emit(self, window: Window, ids_too: bool = False) -> None:
        offset = 0
        for doc, start, ids, total in window.pieces:
            n = len(ids) // 4
            self.rows.append(
                (doc, start, n, zlib.crc32(ids), total, self.sequence, offset,
                 ids if ids_too else None)
            )
            offset += n
        self.sequence += 1

    def put(self, window: Window, doc, start: int, ids: bytes, total: int) -> None:
        window.pieces.append((doc, start, ids, total))
        window.length += len(ids) // 4

    def add(self, doc, start: int, ids: bytes, total: int, ids_too: bool = False) -> None:
        size, at, n = self.window, 0, len(ids) // 4

        def take(most: int) -> tuple:
            nonlocal at
            part = ids if at == 0 and most >= n else ids[4 * at : 4 * (at + most)]
            piece = (doc, start + at, part, total)
            at += len(part) // 4
            return piece

        while n - at >= size:
            self.emit(Window(size, [take(size)]), ids_too)
        while at < n:
            fits = [w for w in self.open if w.length + n - at <= size]
            if fits:
                best = max(fits, key=lambda w: w.length)
            elif len(self.open) < self.most:
                best = Window()
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w.length)
            self.put(best, *take(size - best.length))
            if best.length == size:
                self.open.remove(best)
                self.emit(best, ids_too)


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document: where it lies in which sequence.

    Takes ``doc_id`` and ``text``; other columns are ignored. A null or empty text is
    the end id alone; a null doc_id stays null; repeated rows are packed as often as
    they come; no documents give no pieces. ``with_ids`` also returns the ids of each
    piece as little-endian unsigned 32-bit bytes. A very long text is cut into full
    windows one by one. The tokenizer's special strings in a text become their ids. Every sequence but the last of each
    merged group is full.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()

    def rows_of(packer: Packer, level: int | None) -> pa.RecordBatch:
        columns = list(zip(*packer.rows)) if packer.rows else [[]] * len(_NAMES)
        packer.rows = []
        arrays = [pa.array(list(c), pa.int64()) for c in columns[:-1]]
        arrays.append(pa.array(list(columns[-1]), pa.binary()))
        arrays.append(pa.array([level] * len(arrays[0]), pa.int64()))
        return pa.RecordBatch.from_arrays(arrays, [*_NAMES, "waits_for"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer = Packer(window, open_windows, task << 32)
        encoder = word_encoder(path)
        for batch in batches:
            texts = texts_of(batch.column(1))
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                ids = encoder.encode(text) + end
                packer.add(doc, 0, ids, len(ids) // 4, with_ids)
            yield rows_of(packer, None)
        for left in packer.open:
            packer.emit(left, True)
        yield rows_of(packer, task // TASKS_PER_MERGE)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        group = int(rows["waits_for"].iloc[0])
        packer = Packer(window, 1, (1 << 62) | (group << 32))
        ordered = rows.sort_values(["sequence_id", "offset"])
        for doc, start, ids, total in zip(
            ordered["doc_id"], ordered["start"], ordered["ids"], ordered["doc_tokens"]
        ):
            packer.add(None if pd.isna(doc) else int(doc), start, ids, total, with_ids)
        for left in packer.open:
            packer.emit(left, with_ids)
        merged = pd.DataFrame(packer.rows, columns=_NAMES)
        return merged.astype({"doc_id": "Int64"})

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    placed = stored(source.mapInArrow(place, f"{PIECES}, waits_for long"), "packed")
    done = placed.where(F.col("waits_for").isNull()).drop("waits_for")
    left = placed.where(F.col("waits_for").isNotNull())
    pieces = done.unionByName(left.groupBy("waits_for").applyInPandas(merge, PIECES))
    return pieces if with_ids else pieces.drop("ids")
