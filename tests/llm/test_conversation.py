"""Conversation repair against all edit sequences and a plain loop, with the odd cases."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from kilnworks.llm import conversation as C

GRAMMAR = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kept = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        written = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not written else "duplicate" if (role, text) in seen else "truncated" if written[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(rows, faults):
    """Least (cost, audit) with its repaired lines, by trying every edit at every row."""

    @lru_cache(maxsize=None)
    def to_go(i, tail, began, inserts):
        # tail: last initial; began: any turn so far
        best = None
        if i == len(rows) and tail in ("", "a"):
            best = (0, "", ())
        options = []
        ready = ("a",) if tail == "u" else ("u",)
        if inserts < 3:
            options += [(C.INSERT, "I", i, r, "") for r in ("user", "assistant") if r[0] in ready]
        if i < len(rows):
            _, role, text = rows[i]
            options.append((C.DELETE, "D", i + 1, None, ""))
            if faults[i] not in ("blank", "duplicate"):
                more = C.TRUNCATED if faults[i] else 0
                options += [(C.REROLE + more, "R", i + 1, r, text) for r in ("user", "assistant") if r[0] in ready]
                if role[:1] in (*ready, *("" if began else "s")) and role:
                    options.append((more, "K", i + 1, role, text))
        for cost, letter, j, role, text in options:
            rest = to_go(j, tail if role is None else role[0], began or role is not None, inserts + 1 if letter == "I" else 0)
            if rest is not None:
                line = () if role is None else (f"{role}:{text}",)
                way = (cost + rest[0], letter + rest[1], line + rest[2])
                if best is None or way[:2] < best[:2]:
                    best = way
        return best

    return to_go(0, "", False, 0)


def plain_repair(rows):
    out = []
    for conv, kept in plain_damage(rows).items():
        faults = plain_faults(kept)
        turns = {t for t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = cheapest(tuple(kept), tuple(faults))
        assert GRAMMAR.fullmatch("".join(line[0] for line in lines))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=str)


def made(seed, n_convs=60):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "User", "", None, "ux"]
    texts = ["Yes.", "no", "What?", "", " \n", None, " ", "Ja! ", "long " * 50 + ".", "x.\t", ".", "日本"]
    rows = []
    for conv in range(n_convs):
        for turn in range(rng.randint(1, 9)):
            turn = rng.choice([turn, turn, turn, turn + 1, None, -turn])
            text = rng.choice(texts)
            text = f"{text}{rng.randint(0, 5)}." if text and rng.random() < 0.5 else text
            rows.append((conv, turn, rng.choice(roles), text))
    rows += [(None, t, "user", f"a{t}.") for t in range(5)] + [(None, None, "assistant", "b.")] * 3
    rows += [rows[7]] * 4
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_halves_meet_at_the_cheapest_and_least_audit(seed, monkeypatch):
    monkeypatch.setattr(C, "INSERT", [5, 1, 2, 1][seed])
    monkeypatch.setattr(C, "DELETE", [2, 3, 2, 1][seed])
    for cached in (C.moves, C.forward, C.backward):
        cached.cache_clear()
    rng = random.Random(seed)
    for _ in range(250):
        rows = tuple(
            (0, rng.choice(["system", "user", "assistant", "tool", ""]), "t") for _ in range(rng.randint(0, 9))
        )
        faults = tuple(rng.choice(["", "", "", "truncated", "blank", "duplicate"]) for _ in rows)
        codes = bytes(
            C.code(role[:1], {"": C.SOUND, "truncated": C.CUT_SHORT}.get(fault, C.DOOMED))
            for (_, role, _), fault in zip(rows, faults)
        )
        wanted = cheapest(rows, faults)
        cuts = sorted(rng.choices(range(len(codes) + 1), k=rng.randint(0, 3)))
        parts = [codes[i:j] for i, j in zip([0, *cuts], [*cuts, len(codes)])]
        states, cost = C.borders([C.summed_up(part) for part in parts])
        edits = [e for part, a, b in zip(parts, states, states[1:]) for e in C.reconstruct(part, a, b)]
        assert (cost, "".join(edits) + "I" * C.closing(states[-1])) == wanted[:2]
    monkeypatch.undo()
    for cached in (C.moves, C.forward, C.backward):
        cached.cache_clear()


def test_a_very_long_conversation_takes_few_vectors():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 12, 200_000).astype(np.uint8).tobytes()
    states, _ = C.borders([C.summed_up(codes)])
    assert len(C.reconstruct(codes, *states)) == len(codes)
    assert C.forward.cache_info().currsize < 20_000


@pytest.mark.parametrize("slice_rows", [C.SLICE_ROWS, 5])
def test_conversations_are_repaired_as_the_loop_does(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(C, "SLICE_ROWS", slice_rows)
    rows = made(slice_rows)
    names = "conv_id long, turn long, role string, text string, n string, place string, slice double"
    wide = [(*row, "clash", "clash", 0.5) for row in rows]
    df = spark.createDataFrame(wide, names).repartition(3)
    got = C.repair_conversations(df)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_repair(rows)
    if slice_rows == 5:
        parts = C.repaired_parts(C.counted(C.damaged(df)))
        assert parts.where("not alone").count() > 20
    assert C.repair_conversations(df.limit(0)).count() == 0


def test_the_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, C.repair_conversations(df).collect()), key=str) == plain_repair(rows)
