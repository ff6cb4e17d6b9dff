"""Repair of conversations by least edits, reconstructed by divide and conquer.

Role initials have to read ``(s?(ua)+)?``, which four states follow: nothing yet, after
the system's turn, after the user's, after the assistant's. A stretch of rows turns a
vector of four costs into another. Hirschberg's scheme meets in the middle: the forward
vector of the first half and the backward vector of the second give the states in which
a cheapest repair can cross. With its costs the forward vector carries the order of the
cheapest audits that lead to its states, which picks the least of those crossings; both
halves are then solved alike, so only the rows and the audit take space.

The same scheme spreads a long conversation over tasks. Rows are range-partitioned by
conversation and turn; every partition sums its part of a conversation up as four
vectors, one for each state it may be entered in. A few such summaries per conversation
give the states at the borders of partitions, and each partition then reconstructs its
own part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, stored, stored_by, unpacked

# Fixed values of the contract: costs of an edit, and of leaving a row cut short.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL = {"su", "ua", "au"}

# States, and the role that a new or changed row gets in each.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT_STATE = (USER, USER, ASSISTANT, USER)
FAR = 1 << 60
# Rows and bytes that a partition holds at most, by their mean.
SLICE_ROWS = 200_000
SLICE_BYTES = 64 << 20

# A row's code: its initial's place in INITIALS (others last) and what is wrong with it.
INITIALS = "sua"
SOUND, CUT_SHORT, DOOMED = range(3)


def code(initial: str, fault: int) -> int:
    place = INITIALS.find(initial) if initial else -1
    return 3 * (place if place >= 0 else 3) + fault


@lru_cache(maxsize=None)
def moves(row: int) -> tuple[tuple[tuple[int, int, str], ...], ...]:
    """From each state: (state, cost, edits) of taking in one row, with inserts before it.

    Of several ways to a state the cheapest stays, then the least in ASCII order.
    """
    initial, fault = divmod(row, 3)
    out = []
    for begin in range(4):
        ways: dict[int, tuple[int, str]] = {}
        state, inserted = begin, 0
        while inserted < 3:
            paid, made = INSERT * inserted, "I" * inserted
            steps = [(state, DELETE, "D")]
            if fault != DOOMED:
                more = TRUNCATED if fault == CUT_SHORT else 0
                steps.append((NEXT_STATE[state], REROLE + more, "R"))
                if initial == 0 and state == NONE:
                    steps.append((SYSTEM, KEEP + more, "K"))
                if initial < 3 and NEXT_ROLE[state][0] == INITIALS[initial]:
                    steps.append((NEXT_STATE[state], KEEP + more, "K"))
            for end, cost, edit in steps:
                way = (paid + cost, made + edit)
                ways[end] = min(ways.get(end, way), way)
            state, inserted = NEXT_STATE[state], inserted + 1
        out.append(tuple((end, *way) for end, way in sorted(ways.items())))
    return tuple(out)


def closing(state: int) -> int:
    """Inserts after the last row."""
    return {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}[state]


Vector = tuple[tuple[int, ...], tuple[int, ...]]  # costs above the least, order of audits


def _start(state: int) -> Vector:
    return tuple(0 if s == state else FAR for s in range(4)), (0, 0, 0, 0)


def _lowered(costs: list[int]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(c - least if c < FAR else FAR for c in costs), least


# From any state two inserts lead to where the repair goes on as from any other, but for
# a system's turn, which can be deleted. A state that costs more than that above another
# is on no cheapest way and is left out, so that few vectors occur.
@lru_cache(maxsize=100_000)
def forward(vector: Vector, row: int) -> tuple[Vector, int]:
    """The vector after one more row, and what its least cost grew by."""
    costs, order = vector
    best: list[tuple | None] = [None] * 4
    for begin, ways in enumerate(moves(row)):
        if costs[begin] < FAR:
            for end, cost, edits in ways:
                way = (costs[begin] + cost, order[begin], edits)
                if best[end] is None or way < best[end]:
                    best[end] = way
    most = min(way[0] for way in best if way) + 2 * INSERT + DELETE
    best = [way if way and way[0] <= most else None for way in best]
    sorted_audits = sorted(way[1:] for way in best if way)
    lowered, least = _lowered([way[0] if way else FAR for way in best])
    return (lowered, tuple(sorted_audits.index(way[1:]) if way else 0 for way in best)), least


@lru_cache(maxsize=100_000)
def backward(costs: tuple[int, ...], row: int) -> tuple[int, ...]:
    """Costs to go before a row, above the least of them."""
    return _lowered(
        [min(min(FAR, cost + costs[end]) for end, cost, _ in ways) for ways in moves(row)]
    )[0]


def _crossing(ahead: Vector, to_go: tuple[int, ...]) -> int:
    costs, order = ahead
    return min(range(4), key=lambda s: (costs[s] + to_go[s], order[s]) if costs[s] < FAR > to_go[s] else (2 * FAR, s))


def reconstruct(rows: bytes, begin: int, end: int) -> list[str]:
    """Edits of each row on the cheapest way between two states, the least in ASCII order."""
    out = []
    todo = [(0, len(rows), begin, end)]
    while todo:
        low, high, enter, leave = todo.pop()
        if high - low == 1:
            out.append(next(edits for state, _, edits in moves(rows[low])[enter] if state == leave))
            continue
        if high == low:
            continue
        middle = (low + high) // 2
        ahead = _start(enter)
        for i in range(low, middle):
            ahead, _ = forward(ahead, rows[i])
        to_go = tuple(0 if s == leave else FAR for s in range(4))
        for i in range(high - 1, middle - 1, -1):
            to_go = backward(to_go, rows[i])
        state = _crossing(ahead, to_go)
        todo.append((middle, high, state, leave))
        todo.append((low, middle, enter, state))
    return out


def summed_up(rows: bytes) -> np.ndarray:
    """Costs and audit orders of all ways through a stretch: [cost or order, from, to]."""
    out = np.empty((2, 4, 4), np.int64)
    for state in range(4):
        vector, paid = _start(state), 0
        for row in rows:
            vector, more = forward(vector, row)
            paid += more
        out[0, state] = [c + paid if c < FAR else FAR for c in vector[0]]
        out[1, state] = vector[1]
    return out


def borders(summaries: list[np.ndarray]) -> tuple[list[int], int]:
    """States before each stretch and after the last, and the cost of all with closing."""
    to_go = [[INSERT * closing(s) for s in range(4)]]
    for costs, _ in reversed(summaries):
        to_go.append([min(int(costs[s, t]) + to_go[-1][t] for t in range(4)) for s in range(4)])
    to_go.reverse()
    states = [NONE]
    for (costs, order), rest in zip(summaries, to_go[1:]):
        here = states[-1]
        states.append(min(range(4), key=lambda t: (int(costs[here, t]) + rest[t], int(order[here, t]))))
    return states, to_go[0][NONE]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage, equal ones counted in ``n``; a conversation left empty has n 0."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat_ws(":", conv, turn)) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), kind.alias("kind"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    kind, dropped = F.col("kind"), F.col("kind") == 0
    return rows.select(
        "conv_id",
        F.when(~dropped, F.col("turn")).alias("turn"),
        F.when(dropped, "").when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(dropped | (kind == 1), "")
        .when(kind == 2, F.translate("text", ENDS, ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(dropped, 0).when(kind == 3, 2).otherwise(1).alias("n"),
    )


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def in_slices(rows: DataFrame) -> DataFrame:
    """Counted rows in order, in partitions that also part long conversations.

    Within a turn the order is that of the role, then of the text, for which its first
    characters and its digest stand; equal rows are one, so that any two can be parted.
    """
    spark = rows.sparkSession
    held = stored(rows.withColumn("bytes", F.octet_length("text").cast("long")), "conversation-rows")
    size = held.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    wanted = max(size["n"] // SLICE_ROWS, (size["bytes"] or 0) // SLICE_BYTES) + 1
    n_slices = max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = held.select(
        "conv_id", "turn", "role", "text", "n",
        F.substring("text", 1, 64).alias("begins"), F.md5("text").alias("digest"),
    )
    keys = ["conv_id", "turn", "role", "begins", "digest"]
    ordered = keyed.repartitionByRange(n_slices, *keys).sortWithinPartitions(*keys)
    placed = ordered.select(
        F.spark_partition_id().alias("slice"),
        F.monotonically_increasing_id().alias("place"),
        F.coalesce("conv_id", F.lit(0)).alias("conv"),
        F.col("conv_id").isNotNull().alias("has_conv"),
        F.coalesce("turn", F.lit(0)).alias("turn"),
        F.col("turn").isNotNull().alias("has_turn"),
        "role", "text", "n", F.unhex("digest").alias("digest"),
    )
    return stored_by(placed, "conversation-slices", "slice")


def _by_conversation(rows: pd.DataFrame) -> Iterator[tuple[tuple, list[tuple]]]:
    ordered = rows.sort_values("place")
    columns = ["conv", "has_conv", "place", "turn", "has_turn", "role", "text", "n"]
    return groupby(zip(*(ordered[c].tolist() for c in columns)), key=lambda row: row[:2])


FOUND = (
    "conv long, has_conv boolean, slice int, rows binary, ways binary, blank long, duplicate long,"
    " truncated long, illegal long, first string, last string, turns long, least_turn long, last_turn long"
)
BORDERS = (
    "conv long, has_conv boolean, slice int, rows binary, enter int, leave int, alone boolean, closes boolean,"
    " gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
)
PARTS = (
    "conv long, has_conv boolean, slice int, alone boolean, gaps long, blank long, duplicate long, truncated long,"
    " illegal long, cost long, audit string, repaired string, n_repaired long, repaired_sha256 string"
)
RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long,"
    " audit string, repaired_sha256 string"
)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def find_faults(rows: pd.DataFrame, firsts: pd.DataFrame) -> pd.DataFrame:
    """What each conversation of a slice holds; ``firsts`` are places of new turns."""
    new, out = set(firsts["place"].tolist()), []
    for (conv, has_conv), some in _by_conversation(rows):
        codes, blank, duplicate, truncated, illegal = bytearray(), 0, 0, 0, 0
        first = last = None
        turns, least_turn, last_turn = 0, None, None
        for _, _, place, turn, has_turn, role, text, n in some:
            if not n:
                continue
            if has_turn and turn != last_turn:
                turns, last_turn = turns + 1, turn
                least_turn = turn if least_turn is None else least_turn
            initial, written = role[:1], text.rstrip(SPACE)
            fault = DOOMED
            if not written:
                blank += n
            elif place not in new:
                duplicate += n
            else:
                duplicate += n - 1
                fault = SOUND if written[-1] in ENDS else CUT_SHORT
                truncated += fault == CUT_SHORT
            codes.append(code(initial, fault))
            codes += bytes([code(initial, DOOMED)]) * (n - 1)
            illegal += n - 1 + (last is not None and last + initial not in LEGAL)
            last, first = initial, initial if first is None else first
        ways = summed_up(bytes(codes)).tobytes() if codes else b""
        out.append(
            (conv, has_conv, int(rows["slice"].iloc[0]), packed(np.frombuffer(codes, np.uint8)), ways, blank, duplicate,
             truncated, illegal, first, last, turns, least_turn, last_turn)
        )
    table = pd.DataFrame(out, columns=_names(FOUND))
    return table.astype({"least_turn": "Int64", "last_turn": "Int64"})


def _wrapped(number: int) -> int:
    return (number + (1 << 63)) % (1 << 64) - (1 << 63)


def _streamed(df: DataFrame, by: list[str], then: str, handle, schema: str) -> DataFrame:
    """Apply a function to all rows of each key, in order, without a task per key."""
    names, out = df.columns, _names(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(batch.to_pylist() for batch in batches)
        made = chain.from_iterable(
            handle(list_) for _, list_ in groupby(rows, key=lambda row: [row[c] for c in by])
        )
        kinds = pa.schema([(n, _KINDS[part.split()[1]]) for n, part in zip(out, schema.split(", "))])
        part = []
        for row in made:
            part.append(dict(zip(out, row)))
            if len(part) == 1000:
                yield pa.RecordBatch.from_pylist(part, schema=kinds)
                part = []
        yield pa.RecordBatch.from_pylist(part, schema=kinds)

    return df.select(*names).repartition(*by).sortWithinPartitions(*by, then).mapInArrow(run, schema)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def meet(slices: Iterator[dict]) -> Iterator[tuple]:
    """States at the borders of a conversation's slices, and what holds for all of it."""
    slices = list(slices)
    filled = [s for s in slices if s["ways"]]
    states, cost = borders([np.frombuffer(s["ways"], np.int64).reshape(2, 4, 4) for s in filled])
    illegal = sum(s["illegal"] for s in filled)
    illegal += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(filled, filled[1:]))
    timed = [s for s in filled if s["turns"]]
    turns = sum(s["turns"] for s in timed)
    turns -= sum(a["last_turn"] == b["least_turn"] for a, b in zip(timed, timed[1:]))
    gaps = _wrapped(timed[-1]["last_turn"] - timed[0]["least_turn"] + 1 - turns) if timed else 0
    sums = [sum(s[c] for s in filled) for c in ("blank", "duplicate", "truncated")]
    kept = filled or slices[:1]
    for i, (s, enter, leave) in enumerate(zip(kept, states, states[1:] or states)):
        yield (
            s["conv"], s["has_conv"], s["slice"], s["rows"], enter, leave, len(kept) == 1, i == len(kept) - 1,
            gaps, *sums, illegal, cost,
        )


def repair(rows: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
    """Audit and repaired rows of each part of a conversation in a slice."""
    told = {(g.conv, g.has_conv): g for g in given.itertuples()}
    out = []
    for key, some in _by_conversation(rows):
        one = told.get(key)
        if one is None:
            continue
        edits = reconstruct(unpacked(one.rows, np.uint8).tobytes(), int(one.enter), int(one.leave))
        if one.closes:
            edits.append("I" * closing(int(one.leave)))
        copies = chain.from_iterable([(role, text)] * n for *_, role, text, n in some)
        state, lines = int(one.enter), []
        for edit, (role, text) in zip(edits, chain(copies, [("", "")])):
            for letter in edit:
                if letter == "K":
                    lines.append(f"{role}:{text}")
                    state = SYSTEM if role[:1] == "s" else NEXT_STATE[state]
                elif letter != "D":
                    lines.append(f"{NEXT_ROLE[state]}:{text if letter == 'R' else ''}")
                    state = NEXT_STATE[state]
        repaired = "\n".join(lines)
        digest = hashlib.sha256(repaired.encode()).hexdigest() if one.alone else None
        out.append(
            (*key, one.slice, one.alone, one.gaps, one.blank, one.duplicate, one.truncated, one.illegal, one.cost,
             "".join(edits), repaired, len(lines), digest)
        )
    return pd.DataFrame(out, columns=_names(PARTS))


def put_together(parts: Iterator[dict]) -> Iterator[tuple]:
    """One row of a conversation's parts in order; the digest takes them one by one."""
    digest, audit, lines, one = hashlib.sha256(), [], 0, None
    for one in parts:
        audit.append(one["audit"])
        if one["n_repaired"]:
            digest.update((("\n" if lines else "") + one["repaired"]).encode())
            lines += one["n_repaired"]
    counts = [one[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    yield (one["conv"] if one["has_conv"] else None, *counts, "".join(audit), digest.hexdigest())


def repaired_parts(rows: DataFrame) -> DataFrame:
    """Counts, audit and repaired text of every conversation, in one part per slice.

    Takes ``conv_id``, ``turn``, ``role``, ``text`` and the number ``n`` of equal rows.
    """
    slices = in_slices(rows)
    firsts = (
        slices.where("n > 0")
        .groupBy("conv", "has_conv", "role", "digest")
        .agg(F.min("place").alias("place"))
        .select("place", F.shiftright("place", 33).cast("int").alias("slice"))
    )
    found = stored(
        slices.drop("digest").groupBy("slice").cogroup(firsts.groupBy("slice")).applyInPandas(find_faults, FOUND),
        "conversation-faults",
    )
    met = stored(_streamed(found, ["conv", "has_conv"], "slice", meet, BORDERS), "conversation-borders")
    return slices.drop("digest").groupBy("slice").cogroup(met.groupBy("slice")).applyInPandas(repair, PARTS)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """Damages conversations, finds their faults and repairs them at the least cost.

    Takes ``conv_id``, ``turn``, ``role`` and ``text``; other columns, whatever their
    names, are ignored. A null role or text is one space, as is a null conv_id or turn
    in what decides the damage; rows without conv_id are one conversation, whose id
    stays null. Rows of one turn are ordered by role, then text; equal rows count as
    often as they come. A conversation without rows after damage has zeros, an empty
    audit and the digest of the empty string; no rows give no rows. Long conversations
    and texts are repaired in parts; only the audit of one is put into one row, and its
    text is read part by part for its digest. ``gaps`` wraps at 64 bits.
    """
    parts = stored(repaired_parts(counted(damaged(conversations))), "conversation-parts")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    whole = parts.where("alone").select(F.when(F.col("has_conv"), F.col("conv")).alias("conv_id"), *counts)
    split = parts.where("not alone").drop("alone", "repaired_sha256")
    return whole.unionByName(_streamed(split, ["conv", "has_conv"], "slice", put_together, RESULT))
