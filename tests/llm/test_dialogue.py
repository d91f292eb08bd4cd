"""Conversation repair against plain dynamic programming and against all ways of editing."""

import hashlib
import random
import zlib
from itertools import product

import pytest

from twinsieve.llm.dialogue import MOVES, TOKENS, conversation_digests, crossings, damaged, last_state, repair_conversations, repair_report, run_matrix, turn_matrix

SCHEMA = "conv_id long, turn long, role string, text string, number int, edit string, _c string, audit long"
SPACE = " \t\n\v\f\r"


def faults_of(turns):
    seen, out = set(), []
    for _, role, text in turns:
        stripped = text.strip(SPACE)
        out.append("blank" if not stripped else "duplicate" if (role, text) in seen else None if stripped[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(turns):
    """(cost, audit, repaired lines) by keeping the best way into every state after every turn."""
    best = {0: (0, "", ())}

    def offer(table, state, way):
        if state is not None and (state not in table or way[:2] < table[state][:2]):
            table[state] = way

    def insert(table):
        for _ in range(3):
            for x, (c, a, o) in list(table.items()):
                role = "assistant" if x == 2 else "user"
                offer(table, MOVES[x, role[0]], (c + 2, a + "I", (*o, role + ":")))

    for (_, role, text), fault in zip(turns, faults_of(turns)):
        insert(best)
        new = {}
        for x, (c, a, o) in best.items():
            offer(new, x, (c + 3, a + "D", o))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                offer(new, MOVES.get((x, role[:1])), (c + extra, a + "K", (*o, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    offer(new, MOVES.get((x, other[0])), (c + 2 + extra, a + "R", (*o, f"{other}:{text}")))
        best = new
    insert(best)
    return min(best[x] for x in (0, 3) if x in best)


def expected(turns, bad=("su", "ua", "au")):
    """The whole report on damaged turns (turn, role, text)."""
    turns = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in turns), key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
    if not turns:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    known = [t for t, _, _ in turns if t is not None]
    faults = faults_of(turns)
    cost, audit, lines = cheapest(turns)
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in bad for a, b in zip(turns, turns[1:]))
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
            out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def reports(spark, rows, bits):
    df = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA)
    _, found = repair_conversations(df, bits)
    return {r.conv_id: tuple(r)[1:] for r in repair_report(df, df, bits).collect()}, found


def by_conversation(rows):
    out = {}
    for c, *t in rows:
        out.setdefault(c, []).append(tuple(t))
    return out


def test_kernel_against_all_ways():
    """The audit-least of all ways with up to two inserts before a turn, for all short conversations."""
    rnd = random.Random(5)
    for n in (1, 2, 3, 4):
        for codes in ([tuple(p) for p in product(range(9), repeat=n)] if n < 3 else [tuple(rnd.randrange(9) for _ in range(n)) for _ in range(120)]):
            steps = [turn_matrix(c) for c in codes]
            ways = [(0, "", 0)]
            for m in steps:
                ways = [(c + (m[4 * x + y] >> 4), a + TOKENS[m[4 * x + y] & 15], y) for c, a, x in ways for y in range(4) if m[4 * x + y] < 1 << 50]
            want = min((c + (0, 4, 2, 0)[y], a + "I" * (0, 2, 1, 0)[y]) for c, a, y in ways)
            y = last_state(steps)
            path = [0, *crossings(steps, 0, y)]
            got = "".join(TOKENS[m[4 * a + b] & 15] for m, a, b in zip(steps, path, path[1:]))
            assert got + "I" * (0, 2, 1, 0)[y] == want[1], codes


def test_runs_as_steps():
    rnd = random.Random(6)
    codes = [rnd.randrange(9) for _ in range(700)]
    steps = [turn_matrix(c) for c in codes]
    runs = [run_matrix(steps[i:i + 16]) for i in range(0, 700, 16)]
    y = last_state(steps)
    assert last_state(runs) == y
    fine, coarse = crossings(steps, 0, y), crossings(runs, 0, y)
    assert [fine[min(i + 15, 699)] for i in range(0, 700, 16)] == coarse


@pytest.mark.parametrize("bits", [1, 10])
def test_awkward_conversations(spark, bits):
    rnd = random.Random(7)
    say = lambda: rnd.choice(["Yes.", "No", "Why?", "", " \t", None, "ok ok. ", "\U0001f600!", "x" * 50])
    role = lambda: rnd.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "ünique"])
    rows = [(c, rnd.choice([None, *range(12)]), role(), say()) for c in [None, -1, 2**60, 2**60 + 1, *range(30)] for _ in range(rnd.randrange(1, 9))]
    rows += [(77, i % 40 if i % 3 else None, rnd.choice(["user", "assistant"]), f"t{rnd.randrange(30)}" + rnd.choice([".", ""])) for i in range(150)]  # a long one
    rows += [(78, 5, "user", "Same.")] * 70 + [(79, i, "user", "long " * 40_000 + ".") for i in range(2)] + [(80, 1, "system", "Alone.")]
    got, _ = reports(spark, rows, bits)
    for conv, turns in by_conversation(rows).items():
        assert got[conv] == expected(turns), conv


def test_damage_on_documents(spark):
    conversations = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()] + [(None, None, None, None), (None, 3, "user", None)]
    df = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA)
    assert sorted(map(str, (tuple(r)[:4] for r in damaged(df).collect()))) == sorted(map(str, after_damage(rows)))
    want = by_conversation(after_damage(rows))
    got = {r.conv_id: tuple(r)[1:] for r in repair_report(df, damaged(df)).collect()}
    assert got == {c: expected(want.get(c, [])) for c in {r[0] for r in rows}}


def test_repaired_turns_have_legal_roles(spark):
    rows = [(c, t, ("user", "system", "assistant")[(c * t) % 3], f"{c} {t}.") for c in range(20) for t in range(9)]
    repaired, _ = repair_conversations(spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA), 2)
    roles = {}
    for r in repaired.orderBy("conv_id", "number", "step").collect():
        roles[r.conv_id] = roles.get(r.conv_id, "") + r.role[0]
    assert all(r.removeprefix("s") == "ua" * (len(r) // 2) for r in roles.values())


def test_no_turns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    repaired, found = repair_conversations(empty)
    assert repaired.count() == found.count() == conversation_digests(repaired).count() == repair_report(empty, empty).count() == 0
    some = spark.createDataFrame([(1, 1, "user", "x", 1, "x", "y", 2)], SCHEMA)
    assert [tuple(r) for r in repair_report(some, empty).collect()] == [(1, *expected([]))]
