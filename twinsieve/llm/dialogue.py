"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.llm.common import stored

#: Legal role initials are ``(s?(ua)+)?``. States: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = ("user", "user", "assistant", "user")  # what an inserted or re-roled turn becomes in each state
AFTER = (2, 2, 3, 2)
KEEP, INSERT, REROLE, DELETE, TRUNCATED = 0, 2, 2, 3, 1
#: What may happen at one turn, inserts before it first, in ASCII order. None is the beginning of another, so the order
#: of two audits up to a turn never changes by what follows.
TOKENS = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
ENDING = (0, 2, 1, 0)  # inserts that bring each state to an end
INITIALS = "sua"  # code 3: any other
FINE, CUT, GONE = 0, 1, 2  # nothing wrong or only a wrong role; truncated; blank or duplicate
NONE = 1 << 60
SPREAD = 16  # any state catches up with any other for less: costlier ones never lie on a cheapest way

Matrix = tuple[int, ...]


def _walk(code: int, token: str, x: int) -> tuple[int, int] | None:
    """State and cost after a token at a turn of this code, from state ``x``."""
    fault, initial = divmod(code, 4)
    cost = 0
    for op in token[:-1]:
        x, cost = AFTER[x], cost + INSERT
    if token[-1] == "D":
        return x, cost + DELETE
    if fault == GONE:
        return None
    cost += TRUNCATED if fault == CUT else 0
    if token[-1] == "R":
        return AFTER[x], cost + REROLE
    to = MOVES.get((x, INITIALS[initial])) if initial < 3 else None
    return None if to is None else (to, cost + KEEP)


@lru_cache(None)
def turn_matrix(code: int) -> Matrix:
    """Packed (cost, place of the token) from each state to each state by one turn."""
    out = [NONE] * 16
    for rank, token in enumerate(TOKENS):
        for x in range(4):
            end = _walk(code, token, x)
            if end:
                out[4 * x + end[0]] = min(out[4 * x + end[0]], end[1] << 4 | rank)
    return tuple(out)


@lru_cache(1 << 16)
def _forward(v: Matrix, m: Matrix) -> tuple[Matrix, int]:
    """Four packed (cost, order of the audits) one step on, costs from the least; and the least."""
    found = [NONE] * 4
    for x, a in enumerate(v):
        if a < NONE:
            for y in range(4):
                b = m[4 * x + y]
                if b < NONE:
                    found[y] = min(found[y], ((a >> 2) + (b >> 4)) << 6 | (a & 3) << 4 | (b & 15))
    least = min(found) >> 6
    order = sorted(f & 63 for f in found if f < NONE)
    return tuple(NONE if f >= NONE or (f >> 6) - least > SPREAD else ((f >> 6) - least) << 2 | order.index(f & 63) for f in found), least


@lru_cache(1 << 16)
def _backward(w: Matrix, m: Matrix) -> Matrix:
    """Four costs of reaching the end, one step earlier, from the least."""
    new = [min((w[y] + (m[4 * x + y] >> 4) for y in range(4) if w[y] < NONE and m[4 * x + y] < NONE), default=NONE) for x in range(4)]
    return tuple(c if c >= NONE else c - min(new) for c in new)


def _from(x: int, steps: Sequence[Matrix]) -> tuple[Matrix, int]:
    v: Matrix = tuple(0 if i == x else NONE for i in range(4))
    total = 0
    for m in steps:
        v, least = _forward(v, m)
        total += least
    return v, total


def run_matrix(steps: Sequence[Matrix]) -> Matrix:
    """A run of turns, or of runs, as one step."""
    out: list[int] = []
    for x in range(4):
        v, total = _from(x, steps)
        out += [NONE if a >= NONE else ((a >> 2) + total) << 4 | (a & 3) for a in v]
    return tuple(out)


def last_state(steps: Sequence[Matrix]) -> int:
    """The state after the last turn on the cheapest way of a whole conversation, the audit-least of them."""
    v, _ = _from(0, steps)
    return min((y for y in range(4) if v[y] < NONE), key=lambda y: ((v[y] >> 2) + INSERT * ENDING[y], v[y] & 3))


def crossings(steps: Sequence[Matrix], x: int, y: int) -> list[int]:
    """The state after every step on the audit-least of the cheapest ways from ``x`` to ``y``.

    Forward vectors of the first half and backward vectors of the second meet in the middle. Of the states with the
    least sum the one whose audit so far is least is crossed; both halves are then solved on their own.
    """
    states = [y] * len(steps)

    def solve(lo: int, hi: int, x: int, y: int) -> None:
        if hi - lo == 1:
            states[lo] = y
            return
        mid = (lo + hi) // 2
        v, _ = _from(x, steps[lo:mid])
        w: Matrix = tuple(0 if i == y else NONE for i in range(4))
        for m in reversed(steps[mid:hi]):
            w = _backward(w, m)
        z = min((s for s in range(4) if v[s] < NONE and w[s] < NONE), key=lambda s: ((v[s] >> 2) + w[s], v[s] & 3))
        solve(lo, mid, x, z)
        solve(mid, hi, z, y)

    if steps:
        solve(0, len(steps), x, y)
    return states


def edits(codes: Sequence[int], x: int, y: int | None, ends: bool) -> dict:
    """Edits of a run of turns from state ``x`` to ``y`` (None: to the best end of the conversation)."""
    steps = [turn_matrix(c) for c in codes]
    if y is None:
        y = last_state(steps)
    lead, edit, to, cost = [], [], [], 0
    for code, m, z in zip(codes, steps, crossings(steps, x, y)):
        cost += m[4 * x + z] >> 4
        token = TOKENS[m[4 * x + z] & 15]
        before = []
        for _ in token[:-1]:
            before.append(WANTED[x])
            x = AFTER[x]
        lead.append(before)
        edit.append(token[-1])
        to.append(WANTED[x] if token[-1] == "R" else None)
        x = z
    trail = []
    for _ in range(ENDING[y] if ends else 0):
        trail.append(WANTED[x])
        x = AFTER[x]
    known = [INITIALS[c % 4] if c % 4 < 3 else "-" for c in codes]
    return {
        "lead": lead, "edit": edit, "new_role": to, "trail": trail, "cost": cost + INSERT * len(trail),
        "audit": "".join("I" * len(b) + e for b, e in zip(lead, edit)) + "I" * len(trail),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(known, known[1:])), "head": known[0], "tail": known[-1],
    }


_EDITS = pa.schema([
    ("id", pa.int64()), ("lead", pa.list_(pa.list_(pa.string()))), ("edit", pa.list_(pa.string())), ("new_role", pa.list_(pa.string())),
    ("trail", pa.list_(pa.string())), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string()),
])
_EDITS_DDL = ("id long, lead array<array<string>>, edit array<string>, new_role array<string>, trail array<string>, cost long, "
              "audit string, illegal long, head string, tail string")


def _edit_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [{"id": r["id"], **edits(r["codes"], r["x"], r["y"], r["ends"])} for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(rows, schema=_EDITS)


def _summarise_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[turn_matrix(c) for c in codes] for codes in batch.column("codes").to_pylist()]
        yield _with_matrix(batch, ["id", "last"], found)


def _summarise_children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[tuple(c["matrix"]) for c in children] for children in batch.column("children").to_pylist()]
        yield _with_matrix(batch, ["id", "last"], found)


def _with_matrix(batch: pa.RecordBatch, keep: list[str], steps: list[list[Matrix]]) -> pa.RecordBatch:
    matrices = pa.array([list(run_matrix(s)) for s in steps], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), matrices], names=[*keep, "matrix"])


def _cross_children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every child with the states before and after it."""
    schema = pa.schema([("id", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("ends", pa.bool_())])
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            steps = [tuple(c["matrix"]) for c in r["children"]]
            states = crossings(steps, r["x"], last_state(steps) if r["y"] is None else r["y"])
            for i, (child, x, y) in enumerate(zip(r["children"], [r["x"], *states], states)):
                rows.append({"id": child["id"], "x": x, "y": y, "ends": r["ends"] and i + 1 == len(steps)})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with their place in the order of conversation and turn, gapless over the whole table."""
    order = ["conv_id", "turn", "role", "text", "_tie"]
    plain = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("_tie"))
    by = [F.col(c).asc_nulls_first() for c in order]
    rows = plain.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(rows.drop("_tie"), "turns")
    part = F.shiftright("_at", 33)
    totals = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row per partition of the shuffle
    ahead = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    totals = F.broadcast(totals.select("_part", ahead.alias("_ahead")))
    return rows.join(totals, part == F.col("_part")).select(
        "conv_id", "turn", "role", "text", (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_ahead")).alias("number"))


def _faults(rows: DataFrame) -> DataFrame:
    """Per turn, without its text: number, conversation, fault and code."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    said = F.md5(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), "UTF-8"))
    narrow = rows.select("number", "conv_id", "turn", said.alias("said"), blank.alias("blank"), whole.alias("whole"),
                         F.when((F.length("role") > 0) & (initial > 0), initial - 1).otherwise(3).alias("initial"))
    first = narrow.groupBy("conv_id", "said").agg(F.min("number").alias("_first")).select("_first")
    marked = narrow.join(first, F.col("number") == F.col("_first"), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(~F.col("whole"), "truncated")
    kind = F.when(fault.isin("blank", "duplicate"), GONE).when(fault == "truncated", CUT).otherwise(FINE)
    return marked.select("number", "conv_id", "turn", fault.alias("fault"), (kind * 4 + F.col("initial")).alias("code"))


def _solved(runs: DataFrame, spans: DataFrame, bits: int) -> DataFrame:
    """Edits of every run: conversations of one run at once, longer ones over a tree of runs."""
    def spanned(df: DataFrame) -> DataFrame:
        marked = df.join(spans, F.col("id") == F.col("span_first"), "left")
        return marked.withColumn("whole", F.col("span_last").eqNullSafe(F.col("last"))).drop("span_first", "span_last")

    runs = stored(spanned(runs), "runs")
    start = {"x": F.lit(0), "y": F.lit(None).cast("int"), "ends": F.lit(True)}
    short = runs.filter("whole").select("id", "codes", *[v.alias(k) for k, v in start.items()])
    long = runs.filter(~F.col("whole"))
    summed = long.select("id", "last", "codes").mapInArrow(_summarise_runs, "id long, last long, matrix array<long>")
    level = stored(summed.join(long.select("id", "conv_id", "slot"), "id"), "runs")
    levels = []
    while not level.isEmpty():
        child = F.struct("id", "matrix", "last")
        up = level.groupBy("conv_id", F.shiftright("slot", bits).alias("slot")).agg(F.sort_array(F.collect_list(child)).alias("children"))
        up = stored(spanned(up.withColumns({"id": F.col("children")[0]["id"], "last": F.element_at("children", -1)["last"]})), "runs")
        levels.append(up)
        rest = up.filter(~F.col("whole"))
        level = stored(rest.select("id", "last", "children").mapInArrow(_summarise_children, "id long, last long, matrix array<long>")
                       .join(rest.select("id", "conv_id", "slot"), "id"), "runs")
    states = None
    for up in reversed(levels):
        tops = up.filter("whole").select("id", "children", *[v.alias(k) for k, v in start.items()])
        if states is not None:
            tops = tops.unionByName(up.filter(~F.col("whole")).select("id", "children").join(states, "id"))
        states = stored(tops.mapInArrow(_cross_children, "id long, x int, y int, ends boolean"), "runs-states")
    if states is not None:
        short = short.unionByName(long.select("id", "codes").join(states, "id"))
    return stored(short.mapInArrow(_edit_runs, _EDITS_DDL).join(runs.select("id", "conv_id"), "id"), "runs-edits")


def repair_conversations(turns: DataFrame, bits: int = 10) -> tuple[DataFrame, DataFrame]:
    """Repaired turns and one report per conversation, from ``conv_id, turn, role, text``.

    A conversation's turns are taken by ``turn`` (nulls first; ties by role, then text). The first fault of a turn
    counts: blank, duplicate (role and text seen earlier) or truncated (it does not end in ``.``, ``!`` or ``?``). Kept
    turns cost 0, a new role or an inserted empty turn 2, a deletion 3 (a must for blank and duplicate turns), and a
    truncated turn that stays 1. The cheapest edits that give role initials ``(s?(ua)+)?`` are made; of equally cheap
    ones those whose initials, in order, come first in ASCII.

    Runs of at most ``2**bits`` turns are one task's work. A longer conversation is a tree of runs: each run, then each
    group of ``2**bits`` runs, is summed up as its costs between the four states, and from the top down every group
    is solved by Hirschberg's scheme for the states between its members. So no task sees more than ``2**bits`` members,
    and a conversation with a third of all turns is as many tasks as it has runs. Its audit, one character a
    turn, is put together in one row, as it is one value.

    The first frame has ``conv_id, number, step, role, text, edit`` (K, R or I) in order of number and step; the second
    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``. A null role or text is one space, a null
    ``conv_id`` a conversation of its own. Repeated rows are duplicates. A very long text stays on the JVM and only its
    digest and its end are looked at. An empty table gives two empty frames; other columns are ignored.
    """
    rows = _numbered(turns)
    faults = stored(_faults(rows), "turns-faults")
    count = lambda kind: F.count(F.when(F.col("fault") == kind, 1)).alias(kind)
    wide = F.col("turn").cast("decimal(20,0)")
    stats = stored(faults.groupBy("conv_id").agg(
        F.min("number").alias("first"), F.max("number").alias("last"), (F.max(wide) - F.min(wide) + 1).alias("range"), F.count_distinct("turn").alias("known"),
        count("blank"), count("duplicate"), count("truncated")), "turns-stats")
    spans = stats.select(F.col("first").alias("span_first"), F.col("last").alias("span_last"))
    member = F.struct("number", "code")
    runs = faults.groupBy("conv_id", F.shiftright("number", bits).alias("slot")).agg(F.sort_array(F.collect_list(member)).alias("m"))
    runs = runs.select("conv_id", "slot", F.col("m")[0]["number"].alias("id"), F.element_at("m", -1)["number"].alias("last"), F.col("m.code").alias("codes"))
    solved = _solved(runs, spans, bits)

    piece = F.struct("id", "audit", "cost", "illegal", "head", "tail")
    pieces = solved.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    between = F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda p, i: F.concat(F.element_at("p", i + 1)["tail"], p["head"]))
    audits = pieces.select(
        F.col("conv_id").alias("_conv"), F.array_join("p.audit", "").alias("audit"), F.aggregate("p.cost", F.lit(0).cast("long"), lambda a, b: a + b).alias("cost"),
        (F.aggregate("p.illegal", F.lit(0).cast("long"), lambda a, b: a + b) + F.size(F.filter(between, lambda b: ~b.isin("su", "ua", "au")))).alias("illegal"))
    gaps = F.coalesce((F.col("range") - F.col("known")).cast("long"), F.lit(0).cast("long")).alias("gaps")
    reports = stats.join(audits, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    ends = F.col("at") + 1 == F.size("edit_of")
    placed = solved.select("id", F.col("edit").alias("edit_of"), "trail", F.posexplode(F.arrays_zip("lead", "edit", "new_role")).alias("at", "e")).select(
        (F.col("id") + F.col("at")).alias("number"), "e.lead", "e.edit", "e.new_role", F.when(ends, F.col("trail")).otherwise(F.array().cast("array<string>")).alias("after"))
    turn = lambda role, text, edit: F.struct(role.alias("role"), text.alias("text"), edit.alias("edit"))
    put_in = lambda c: F.transform(c, lambda r: turn(r, F.lit(""), F.lit("I")))
    own = turn(F.coalesce("new_role", "role"), F.col("text"), F.col("edit"))
    kept = F.when(F.col("edit") != "D", F.array(own)).otherwise(F.array().cast("array<struct<role:string,text:string,edit:string>>"))
    repaired = rows.join(placed, "number").select("conv_id", "number", F.posexplode(F.concat(put_in("lead"), kept, put_in("after"))).alias("step", "t"))
    return repaired.select("conv_id", "number", "step", "t.role", "t.text", "t.edit"), reports


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: SHA-256 of the turns as ``role:text``, newline-joined.

    A SHA-256 is one chain, so a conversation is one stream: its task sorts it (with spill) and keeps one batch and
    the hash in memory, never the conversation.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chain, started = None, None, False
        done: list[tuple[object, str]] = []
        typ = None
        for batch in batches:
            typ = batch.schema.field("conv_id").type
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line")):
                if not started or conv != current:
                    if started:
                        done.append((current, chain.hexdigest()))
                    current, chain, started = conv, hashlib.sha256(), True
                else:
                    chain.update(b"\n")
                chain.update(line.as_buffer())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], typ), pa.array([d for _, d in done])], names=["conv_id", "repaired_sha256"])
                done = []
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([current], typ), pa.array([chain.hexdigest()])], names=["conv_id", "repaired_sha256"])

    line = F.encode(F.concat("role", F.lit(":"), "text"), "UTF-8").alias("line")
    rows = repaired.select("conv_id", "number", "step", line).repartition("conv_id").sortWithinPartitions("conv_id", "number", "step")
    kind = repaired.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns damaged by the CRC of ``conv_id:turn``: dropped, emptied, without end marks, twice, or given to the user.

    Nulls are one space, also where the CRC is taken. One turn in twenty meets with each damage.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.encode(F.concat(name("conv_id"), F.lit(":"), name("turn")), "UTF-8")) % 20
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), fate.alias("fate")).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fate") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("_")).drop("_")


def repair_report(conversations: DataFrame, turns: DataFrame, bits: int = 10) -> DataFrame:
    """One row for each ``conv_id`` of ``conversations``: the report on its repaired ``turns``, and their digest.

    A conversation without turns has zeros, an empty audit and the digest of nothing.
    """
    repaired, reports = repair_conversations(turns, bits)
    digests = conversation_digests(repaired).select(F.col("conv_id").alias("_d"), "repaired_sha256")
    out = conversations.select(F.col("conv_id").alias("_c")).distinct().join(reports, F.col("_c").eqNullSafe(F.col("conv_id")), "left")
    out = out.join(digests, F.col("_c").eqNullSafe(F.col("_d")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_c").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
