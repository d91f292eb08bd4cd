"""Phrase lists as tables: an automaton over a bounded block of phrases, run over the texts in one pass."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHRASE_BYTES = 8 << 20  # of phrases in one broadcast list


def _blocks(phrases: DataFrame, limit: int) -> Iterator[list[str]]:
    """Distinct phrases in lists of about ``limit`` bytes; null and empty ones can occur nowhere."""
    p = phrases.select(F.col("phrase").cast("string").alias("phrase")).filter(F.length("phrase") > 0).distinct()
    size = p.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    n = -(-size // limit)
    for i in range(n):
        own = [r.phrase for r in p.filter(F.pmod(F.xxhash64("phrase"), F.lit(n)) == i).collect()]
        if own:
            yield own


def _automaton(phrases: Sequence[str]) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        auto.add_word(p, (i, len(p)))
    auto.make_automaton()
    return auto


def occurrences_by(df: DataFrame, text: str, key: str, phrases: DataFrame, limit: int = PHRASE_BYTES) -> DataFrame:
    """``phrase, key, n``: non-overlapping occurrences of every phrase in the texts of each slice, where there are any.

    A phrase is counted from the left, as a replacement would find it, and whatever other phrases it crosses. One pass
    over the texts for about ``limit`` bytes of phrases, however many phrases these are; a larger table is done in
    blocks with one pass each, so what is broadcast stays bounded. ``key`` is cast to string. Null texts hold nothing.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).filter(F.length("text") > 0)
    out = None
    for block in _blocks(phrases, limit):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            auto = _automaton(shared.value)
            for batch in batches:
                counts: dict[tuple[str | None, int], int] = defaultdict(int)
                for k, x in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                    taken: dict[int, int] = {}
                    for end, (i, size) in auto.iter(x):
                        if end - size >= taken.get(i, -1):
                            taken[i] = end
                            counts[k, i] += 1
                cols = zip(*((i, k, n) for (k, i), n in counts.items())) if counts else ((), (), ())
                place, keys, n = cols
                names = [shared.value[i] for i in place]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys, pa.string()), pa.array(n, pa.int64())], names=["phrase", "key", "n"])

        part = rows.mapInArrow(run, "phrase string, key string, n long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "phrase string, key string, n long")
    return out.groupBy("phrase", "key").agg(F.sum("n").alias("n"))


def first_present(df: DataFrame, ident: str, text: str, phrases: Sequence[str], other: str) -> DataFrame:
    """``ident, marker``: the phrase listed first among those a text holds, else ``other``, in one pass for any number."""
    listed = list(dict.fromkeys(p for p in phrases if p))
    if not listed:
        return df.select(ident, F.lit(other).alias("marker"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(listed)
        names = np.array([*listed, other], dtype=object)
        for batch in batches:
            at = [min((i for _, (i, _) in auto.iter(x or "")), default=len(listed)) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names[np.array(at, np.int64)].tolist(), pa.string())], names=["id", "marker"])

    kind = df.schema[ident].dataType.simpleString()
    out = df.select(F.col(ident).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, marker string")
    return out.withColumnRenamed("id", ident)


def longest_suffix(df: DataFrame, ident: str, text: str, phrases: DataFrame, limit: int = PHRASE_BYTES) -> DataFrame:
    """``ident, payload``: the longest phrase a text ends with, else null. The text is taken as it is.

    A text looks up its ends of the lengths that occur among the phrases in a set, so the cost of a row does not grow
    with the number of phrases. Blocks of about ``limit`` bytes are passed one after another and the longest end found
    so far goes along with its row, so nothing is shuffled and a row comes out as often as it went in.
    """
    spark = df.sparkSession
    kind = df.schema[ident].dataType.simpleString()
    out = df.select(F.col(ident).alias("id"), F.col(text).alias("text"), F.lit(None).cast("string").alias("payload"))
    for block in _blocks(phrases, limit):
        shared = spark.sparkContext.broadcast(frozenset(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            sizes = sorted({len(p) for p in known}, reverse=True)
            for batch in batches:
                best = []
                for x, old in zip(batch.column("text").to_pylist(), batch.column("payload").to_pylist()):
                    ends = (x[-s:] for s in sizes if s > len(old or "") and x is not None and s <= len(x))
                    best.append(next((e for e in ends if e in known), old))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(best, pa.string())], names=["id", "text", "payload"])

        out = out.mapInArrow(run, f"id {kind}, text string, payload string")
    return out.select(F.col("id").alias(ident), "payload")
