"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.common import stored, text_of
from twinsieve.llm.components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
CROWD = 1024  # members of a bucket that are compared in one task


def fingerprint(text: bytes) -> int:
    """SimHash of the 4-word shingles of a lower-cased text; 0 without words."""
    found = text.lower().split()
    if not found:
        return 0
    joined, h = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum([len(x) + 1 for x in found])
    if len(found) <= SHINGLE:
        hashes = [h(joined, SEED)]
    else:
        hashes = [h(joined[i:j], SEED) for i, j in zip([0, *ends[:-SHINGLE].tolist()], (ends[SHINGLE - 1:] - 1).tolist())]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at: at + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, fp`` and the columns of longs to carry; the texts do not leave the task that reads them."""
    kept = ["doc_id", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(fp, pa.int64())], names=[*kept, "fp"])

    rows = docs.select(*(F.col(c).cast("long").alias(c) for c in kept), F.encode(text_of(), "UTF-8").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*kept, "fp"]))


def _half(fp: Column, part: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if part else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _half_balls(nodes: DataFrame) -> DataFrame:
    """Every fingerprint under all variants of each 32-bit half with at most one bit flipped."""
    masks = [0, *(1 << i for i in range(32))]
    keys = [(_half(F.col("fp"), part).bitwiseXOR(F.lit(m)) + F.lit(part << 32)).alias("k") for part in (0, 1) for m in masks]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("key"))


def _full_balls(nodes: DataFrame) -> DataFrame:
    """Every fingerprint under all 2081 variants of its 64 bits with at most two bits flipped."""
    bits = [1 << i for i in range(63)] + [-(1 << 63)]
    masks = [0, *bits, *(a ^ b for i, a in enumerate(bits) for b in bits[:i])]
    ball = nodes.sparkSession.createDataFrame([(m,) for m in masks], "mask long")  # 2081 rows
    return nodes.join(F.broadcast(ball), F.lit(True)).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("key"))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links of each bucket, no more than join its members: a spanning forest."""
    for batch in batches:
        a, b = [], []
        for members in batch.column("members"):
            rest = np.unique(np.array(members.values.to_numpy(), np.int64))
            while len(rest) > 1:
                front, rest = rest[:1], rest[1:]
                while len(front) and len(rest):
                    near = np.bitwise_count((front[:, None] ^ rest[None, :]).view(np.uint64)) <= RADIUS
                    hit = near.any(0)
                    b.append(rest[hit])
                    a.append(front[near.argmax(0)[hit]])
                    front, rest = rest[hit], rest[~hit]
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([cat(a), cat(b)], names=["a", "b"])


def near_links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links ``a, b`` whose components are those of all pairs of fingerprints that differ in at most 4 bits.

    Of two such fingerprints one 32-bit half differs in at most 2 bits, so they meet under a variant of it that is
    one bit from both. Every fingerprint emits the 33 variants of each half; variants that only one fingerprint
    has are dropped by their counts. In a bucket of at most ``crowd`` members the pairs are verified, and the
    links of a spanning forest leave it. Members of a larger bucket emit the full ball of 2081 variants within two
    bits of all 64; all who share one of those differ in at most 4 bits by the triangle inequality, so each is
    linked to the smallest without looking at pairs, and a bucket holds 2081 members at most.
    """
    balls = _half_balls(nodes)
    sizes = balls.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    # Never broadcast: Spark takes the exploded side to be as small as the table it comes from.
    met = stored(balls.join(sizes.hint("merge"), "key"), "simhash-met")
    buckets = met.filter(F.col("size") <= crowd).groupBy("key").agg(F.collect_list("fp").alias("members"))
    few = buckets.select("members").mapInArrow(_forest, "a long, b long")
    many = _full_balls(met.filter(F.col("size") > crowd).select("fp").distinct())
    stars = many.groupBy("key").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1)
    stars = stars.select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
    return few.unionByName(stars)


def _rooted(nodes: DataFrame, crowd: int) -> DataFrame:
    """``nodes`` with the root of each fingerprint's component."""
    roots = components(near_links(nodes.select("fp"), crowd))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Fingerprint and component of every document.

    Words are runs of anything but ASCII white space, lower-cased in A-Z; shingles are 4 words joined by one space,
    repeats included; a bit is set if it is set in over half of the shingles' XXH64 (seed 42). Documents with equal
    fingerprints are one node, so a group of copies of any size is one row from there on. Components come from
    ``components``.

    Returns ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links of
    at most 4 bits. A null or blank text has fingerprint 0 and is linked like any other. Fewer than 4 words are one
    shingle. A null id is never the smallest; a component without any id gets null. Repeated rows stay repeated
    rows; an empty table gives an empty result; other columns are ignored.
    """
    rows = stored(fingerprints(docs), "simhash")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-nodes")
    rooted = _rooted(nodes, crowd)
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(rooted.join(names, "root").select("fp", "n", "component_id"), "simhash-named")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * 1000 > total  # fewer than a thousand fingerprints, so they may be broadcast
    return (
        rows.join(F.broadcast(named.filter(hot)), "fp")
        .unionByName(rows.join(named.filter(~hot), "fp"))
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    )


def first_rows(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The ``number`` of one row of each group of ``near_duplicates``: the first by id (null last), text, number.

    ``docs`` has ``doc_id, text`` and ``number``, distinct longs that are written down. Rows are told apart by it
    alone, so several may share an id or have none; texts are ordered by a hash. The first row of each fingerprint is
    found before components are joined, so a group of copies of any size is one row from there on.
    """
    rows = fingerprints(docs.select("doc_id", "text", "number", F.xxhash64(text_of()).alias("hash")), ["number", "hash"])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash", "number")).alias("first")
    nodes = stored(rows.groupBy("fp").agg(first), "simhash-firsts")
    return _rooted(nodes, crowd).groupBy("root").agg(F.min("first").alias("first")).select("first.number")
