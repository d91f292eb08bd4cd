"""Preference pairs of conversations: one prompt, two masked completions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, TAIL = "<|{role}|>\n", "<|end|>\n"
TRAINED = ("assistant",)

PAIRS = ("pair_id long, n_prompt_turns long, prompt string, chosen string, chosen_mask array<struct<start:long,end:long>>, "
         "rejected string, rejected_mask array<struct<start:long,end:long>>, identical boolean")


def render(turns: list[tuple[str | None, str | None]], head: str = HEAD, tail: str = TAIL) -> tuple[str, list[dict[str, int]]]:
    """The turns as one text, and the spans (code points, end exclusive) that are trained on: what an assistant says, with its end mark."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        opening = head.replace("{role}", role if role is not None else "unknown")
        body = (text or "") + tail
        if role in TRAINED:
            spans.append({"start": at + len(opening), "end": at + len(opening) + len(body)})
        parts += [opening, body]
        at += len(opening) + len(body)
    return "".join(parts), spans


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mask = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), mask, pa.string(), mask, pa.bool_()]
    names = ["pair_id", "n_prompt_turns", "prompt", "chosen", "chosen_mask", "rejected", "rejected_mask", "identical"]
    for batch in batches:
        rows = []
        for pair, chosen, rejected in zip(*(batch.column(c) for c in ("pair_id", "chosen", "rejected"))):
            a, b = ([(t["role"], t["text"]) for t in x.as_py()] for x in (chosen, rejected))
            same = sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(a, b)))
            prompt, _ = render(a[:same])
            rows.append((pair.as_py(), same, prompt, *render(a[same:]), *render(b[same:]), a == b))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, types)], names=names)


def preference_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair: the common turns as ``prompt``, the rest of both sides as masked completions.

    ``turns``: ``pair_id, rejected`` (false: the chosen side), ``turn, role, text``. Turns are compared by role and
    text, nulls alike; the longest common prefix is rendered once. A mask lists the spans of its completion that
    carry loss: each assistant turn's text and end mark, never a role header or another speaker.

    Both sides of a pair meet in one shuffle on the pair. A null text renders empty, a null role as ``unknown``. A
    side without turns is an empty completion; ``identical`` marks pairs with nothing to prefer. Turns with
    one number are ordered by role and text; null numbers come first; repeated turns stay. Turns without a pair
    belong to no conversation and are left out. An empty table gives an empty result; other columns are ignored.
    """
    turn = F.struct("turn", "role", "text")
    side = lambda r: F.sort_array(F.collect_list(F.when(F.col("rejected") == F.lit(r), turn)))
    pairs = turns.filter(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(side(False).alias("chosen"), side(True).alias("rejected"))
    return pairs.select(F.col("pair_id").cast("long").alias("pair_id"), "chosen", "rejected").mapInArrow(_format, PAIRS)


def neighbours(conversations: DataFrame) -> DataFrame:
    """Conversations 2k and 2k + 1 as the chosen and the rejected side of pair k."""
    c = F.col("conv_id").cast("long")
    return conversations.select(F.shiftright(c, 1).alias("pair_id"), (F.pmod(c, F.lit(2)) == 1).alias("rejected"), "turn", "role", "text")
