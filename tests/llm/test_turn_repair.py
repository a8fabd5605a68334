"""Repaired conversations against a search of all repairs."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from ruleloom.llm.repair_tables import SYMBOLS, tables
from ruleloom.llm.turn_repair import conversation_digests, repair_pieces, repaired_turns

KIND = "conv_id long, turn long, role string, text string, part int, seq long, key string, audit string, copies int"


def table(spark, rows):
    return spark.createDataFrame([(*r, None, None, "clash", "x", 5) for r in rows], KIND)


def hurt(rows):
    found = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = found.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, own in found.items()}


def by_search(conv, turns):
    """The contract, trying all edits of all turns."""
    seen, faults = set(), []
    for _, role, text in turns:
        body = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "sound" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))

    def put(role, state):
        """The state after a turn of this role, None if it is not allowed there."""
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, role[:1]))

    @lru_cache(maxsize=None)
    def least(n, state, inserted):
        found = []
        if n == len(turns):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            _, role, text = turns[n]
            cost, audit, rest = least(n + 1, state, 0)
            found.append((cost + 2, "D" + audit, rest))
            if faults[n] in ("sound", "truncated"):
                more = 5 * (faults[n] == "truncated")
                for new, edit, paid in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                    after = put(new, state)
                    if after:
                        cost, audit, rest = least(n + 1, after, 0)
                        found.append((cost + paid + more, edit + audit, ((new, text), *rest)))
        if inserted < 3:
            for new in ("user", "assistant"):
                after = put(new, state)
                if after:
                    cost, audit, rest = least(n, after, inserted + 1)
                    found.append((cost + 5, "I" + audit, ((new, ""), *rest)))
        return min(found, default=(10**9, "", ()))

    cost, audit, rest = least(0, "", 0)
    numbers = [t for t, _, _ in turns if t is not None]
    initials = [r[:1] for _, r, _ in turns]
    return {
        "conv_id": conv, "gaps": min(2**63 - 1, max(numbers) - min(numbers) + 1 - len(set(numbers))) if numbers else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rest).encode()).hexdigest(),
    }, rest


def conversations(seed, count, longest):
    dice = random.Random(seed)
    rows = []
    for conv in range(count):
        texts = [f"text {dice.randint(0, 9)}{dice.choice(['.', '!', '', '? ', ''])}" for _ in range(6)] + ["", " \t", None]
        for turn in range(dice.randint(1, longest)):
            if dice.random() < 0.1:
                continue
            role = dice.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "sys", "unknown"])
            rows.append((conv, dice.choice([turn] * 9 + [None]), role, dice.choice(texts)))
            if dice.random() < 0.05:
                rows.append(rows[-1])
    return rows


def check(spark, rows, **more):
    pieces = repair_pieces(table(spark, rows).repartition(3), **more)
    got = sorted((r.asDict() for r in conversation_digests(pieces).collect()), key=str)
    want = {c: by_search(c, turns) for c, turns in hurt(rows).items()}
    assert got == sorted((w for w, _ in want.values()), key=str)
    return pieces, {c: rest for c, (_, rest) in want.items()}


def test_against_search(spark):
    check(spark, conversations(1, 60, 12))


@pytest.mark.parametrize("piece_turns", [1, 3])
def test_conversations_over_several_pieces_and_tasks(spark, piece_turns):
    rows = conversations(2, 3, 90) + conversations(5, 25, 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces, want = check(spark, rows, piece_turns=piece_turns)
        assert pieces.filter("NOT whole").count() > 20
        turns = repaired_turns(pieces).filter("conv_id = 1").orderBy("part", "seq", "at").collect()
        assert tuple((t["role"], t["text"]) for t in turns) == want[1]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_awkward_rows(spark):
    rows = [
        (None, 1, "user", "a."), (None, None, None, None), (7, None, "assistant", "b."), (7, None, "assistant", "b."),
        (8, 5, "", "no role."), (8, 9, "user", "x" * 200_000 + "."), (9, -(2**63), "user", "a."), (9, 2**62, "assistant", "."),
    ]
    rows += [(10, 3, r, t) for r in ("user", "assistant", "system") for t in ("é.", "z", "é.")]
    check(spark, rows)
    check(spark, rows[:7], piece_turns=1)


def test_dropped_conversations_and_none(spark):
    gone = [n for n in range(500) if zlib.crc32(f"{n}:0".encode()) % 20 == 0][:4]
    check(spark, [(n, 0, "user", "a.") for n in gone])
    check(spark, [])


def test_blocks_agree_with_single_steps():
    found = tables()
    dice = random.Random(4)
    for _ in range(200):
        symbols = np.array([dice.randrange(SYMBOLS) for _ in range(dice.randint(0, 21))], dtype=np.int64)
        front, _ = found.summary(symbols)
        for v in range(len(found.vectors)):
            w = v
            for s in symbols[::-1]:
                w = found.step_to[w, s]
            assert front[v] == w
