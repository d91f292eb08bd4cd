"""Removal of stretches of text that stand earlier in the corpus, by exact windows.

1. Every text is cut into runs of windows that share an anchor (``windows.py``). A run travels as one tuple: the
   hash of what follows its anchor, the hash of all it spans, document and place. A bucket holds one anchor hash;
   sorting it shows which runs stand earlier as a whole: all their windows are repeats.
2. What is left are the first runs of each kind in buckets with several kinds: the edges of shared passages. They
   travel to their bucket as one packed string each, where all their windows are sorted. A bucket with very many
   kinds is split: its windows are dealt one by one, by 128-bit hashes.
3. The marked windows come back to their texts, which are cut.

Equal tuples of one task collapse before the shuffle, so a passage that a third of the corpus holds sends one
tuple per task and not one per document. Texts are shuffled once, for steps 2 and 3 together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.llm import windows as w
from twinsieve.llm.common import stored, text_of

TUPLES = "x long, y long, did long, tid long, size long, pos long, n long, done boolean"
TEXT = ["did", "tid", "size"]  # id, 64-bit hash and bytes of a text; rows that agree in all three are repeated rows
NULL_ID = -(2**63)
CROWD = 4096  # kinds of runs up to which a bucket is sorted in one task


def _rows(x, y, did, tid, size, pos, n, done) -> pa.RecordBatch:
    cols = [pa.array(np.ascontiguousarray(c)) for c in (x, y, did, tid, size, pos.astype(np.int64), n.astype(np.int64), done)]
    return pa.RecordBatch.from_arrays(cols, names=["x", "y", *TEXT, "pos", "n", "done"])


def _settled(did, tid, size, text, pos, n) -> pa.RecordBatch:
    """Windows already known to be repeats; dealt by document, never compared again."""
    text, pos, n = w.spans(text, pos, n)
    d, t, s = did[text], tid[text], size[text]
    x = w.mixed(d.view(np.uint64) * np.uint64(3) + t.view(np.uint64)).view(np.int64)
    return _rows(x, x, d, t, s, pos, n, np.ones(len(x), bool))


def _run_tuples(scheme: w.Scheme) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, did, tid, size, data, offsets = w.texts_of(batch)
            symbols, offsets = scheme.symbols(data, offsets)
            for piece in w.pieces(offsets, scheme.k):
                text, pos, n, key, full = w.runs(scheme, symbols, piece)
                pos = pos - offsets[text]
                again = w.later_copies(full, key)
                t = text[~again]
                yield _rows(key[~again], full[~again], did[t], tid[t], size[t], pos[~again], n[~again], np.zeros(len(t), bool))
                yield _settled(did, tid, size, text[again], pos[again], n[again])

    return run


def _packed(scheme: w.Scheme) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, did, tid, size, data, offsets = w.texts_of(batch)
            offsets, pack = scheme.packer(data, offsets)
            asked = batch.column("asked").take(pa.array(rows))
            parts, owner = asked.flatten(), np.repeat(np.arange(len(rows)), asked.value_lengths().to_numpy(zero_copy_only=False))
            pos, n, x = (parts.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "n", "x"))
            start = pos + offsets[owner]
            for lo in range(0, len(pos), 1 << 15):
                cut = slice(lo, lo + (1 << 15))
                packed = [pack(a, b) for a, b in zip(start[cut].tolist(), (start[cut] + n[cut] - 1 + scheme.k).tolist())]
                cols = [pa.array(x[cut]), pa.array(did[owner[cut]]), pa.array(tid[owner[cut]]), pa.array(size[owner[cut]]), pa.array(pos[cut]), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["x", *TEXT, "pos", "packed"])

    return run


def _sorted_windows(scheme: w.Scheme) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows of each bucket's packed strings that an earlier place of the bucket has too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            parts, bucket = members.flatten(), np.repeat(np.arange(len(members)), members.value_lengths().to_numpy(zero_copy_only=False))
            did, tid, size, pos = (parts.field(c).to_numpy(zero_copy_only=False) for c in (*TEXT, "pos"))
            order = np.lexsort((pos, size, tid, did, bucket))
            bucket, did, tid, size, pos = bucket[order], did[order], tid[order], size[order], pos[order]
            new = np.ones(len(order), bool)  # a repeated row is there once
            new[1:] = np.any([c[1:] != c[:-1] for c in (bucket, did, tid, size, pos)], 0)
            order, bucket, did, tid, size, pos = order[new], bucket[new], did[new], tid[new], size[new], pos[new]
            symbols, offsets = scheme.symbols(*w.bytes_of(parts.field("packed").take(pa.array(order))))
            m = np.diff(offsets) - scheme.k + 1
            # whole buckets, about CHUNK windows at a time
            total, lo = np.concatenate([[0], np.cumsum(m)]), 0
            while lo < len(m):
                hi = int(np.searchsorted(total, total[lo] + (w.CHUNK >> 2), "right")) - 1
                hi = int(np.searchsorted(bucket, bucket[min(max(hi, lo), len(m) - 1)], "right"))
                owner = np.repeat(np.arange(lo, hi), m[lo:hi])
                inside = np.arange(len(owner)) - (total[owner] - total[lo])
                x, y = w.window_hashes(scheme, symbols, offsets[owner] + inside)
                x = w.mixed(x.view(np.uint64) + bucket[owner].astype(np.uint64) * np.uint64(w.BASE))
                again = w.later_copies(x, y)
                o, at, n = w.spans(owner[again], (pos[owner] + inside)[again], np.ones(int(again.sum()), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (did[o], tid[o], size[o], at.astype(np.int64), n.astype(np.int64))], names=[*TEXT, "pos", "n"])
                lo = hi

    return run


def _window_tuples(scheme: w.Scheme) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, did, tid, size, data, offsets = w.texts_of(batch)
            symbols, offsets = scheme.symbols(data, offsets)
            asked = batch.column("asked").take(pa.array(rows))
            parts, owner = asked.flatten(), np.repeat(np.arange(len(rows)), asked.value_lengths().to_numpy(zero_copy_only=False))
            pos, n = parts.field("pos").to_numpy(zero_copy_only=False), parts.field("n").to_numpy(zero_copy_only=False)
            for lo in range(0, len(pos), 1 << 15):  # runs of windows are short, so this bounds the chunk
                p, m, o = pos[lo: lo + (1 << 15)], n[lo: lo + (1 << 15)], owner[lo: lo + (1 << 15)]
                at = np.repeat(p + offsets[o] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                order = np.argsort(at, kind="stable")
                at, text = at[order], np.repeat(o, m)[order]
                x, y = w.window_hashes(scheme, symbols, at)
                place = at - offsets[text]
                again = w.later_copies(x, y)
                t = text[~again]
                yield _rows(x[~again], y[~again], did[t], tid[t], size[t], place[~again], np.ones(len(t), np.int64), np.zeros(len(t), bool))
                yield _settled(did, tid, size, text[again], place[again], np.ones(int(again.sum()), np.int64))

    return run


def _merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of intervals; touching ones become one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return list(zip(start[first].tolist(), end[np.append(first[1:], len(start)) - 1].tolist()))


def _cut(scheme: w.Scheme, cut: Callable[[bytes, list[tuple[int, int]], bool], tuple[int, int, int, bytes]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["did", "is_null", "n_symbols", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            marks = batch.column("marks")
            parts, bounds = marks.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False))])
            pos, n = parts.field("pos").to_numpy(zero_copy_only=False), parts.field("n").to_numpy(zero_copy_only=False)
            ids, nulls, copies, texts = (batch.column(c) for c in ("did", "is_null", "copy", "text"))
            for i in range(len(batch)):
                lo, hi = bounds[i], bounds[i + 1]
                covered = _merged(pos[lo:hi], pos[lo:hi] + n[lo:hi] - 1 + scheme.k) if hi > lo else []
                count, removed, n_spans, kept = cut(texts[i].as_py(), covered, copies[i].as_py() > 1)
                for column, value in zip(out, (ids[i].as_py(), nulls[i].as_py(), count, removed, n_spans, hashlib.sha256(kept).hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=names)

    return run


def _first_kept(x: DataFrame) -> DataFrame:
    """Marks each tuple: ``nth`` 1 for the earliest of its kind; places are ranked, so a repeated row never marks itself."""
    return x.withColumn("nth", F.rank().over(Window.partitionBy("x", "y").orderBy(*TEXT, "pos")))


def without_repeats(docs: DataFrame, scheme: w.Scheme, cut, crowd: int = CROWD) -> DataFrame:
    """Cut every document where a window of it starts earlier. See ``repeated_bytes`` and ``repeated_words``."""
    t = text_of()
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.col("doc_id").isNull().alias("is_null"),
        F.xxhash64(t).alias("tid"), F.octet_length(t).cast("long").alias("size"), F.encode(t, "UTF-8").alias("text"),
    )
    tuples = base.select(*TEXT, "text").mapInArrow(_run_tuples(scheme), TUPLES).repartition("x")
    kinds = F.count_if(F.col("nth") == 1).over(Window.partitionBy("x"))
    judged = _first_kept(tuples).withColumn("kinds", kinds).withColumn("repeat", F.col("done") | (F.col("nth") > 1)).filter("repeat or kinds > 1")
    found = stored(judged.select(*TEXT, "pos", "n", "repeat", F.when(~F.col("repeat"), F.col("x")).alias("x"), (F.col("kinds") > crowd).alias("crowded")), "repeats")

    dealt = base.repartition(*TEXT)
    asked = lambda which, *cols: dealt.join(
        found.filter("not repeat").filter(which).groupBy(*TEXT).agg(F.collect_list(F.struct(*cols)).alias("asked")), TEXT).select(*TEXT, "text", "asked")
    packed = asked("not crowded", "pos", "n", "x").mapInArrow(_packed(scheme), "x long, did long, tid long, size long, pos long, packed binary")
    buckets = packed.groupBy("x").agg(F.collect_list(F.struct(*TEXT, "pos", "packed")).alias("members"))  # crowd members at most
    edges = buckets.select("members").mapInArrow(_sorted_windows(scheme), "did long, tid long, size long, pos long, n long")
    single = asked("crowded", "pos", "n").mapInArrow(_window_tuples(scheme), TUPLES)
    single = _first_kept(single.repartition("x", "y")).filter(F.col("done") | (F.col("nth") > 1)).select(*TEXT, "pos", "n")
    marks = found.filter("repeat").select(*TEXT, "pos", "n").unionByName(edges).unionByName(single)
    marks = marks.groupBy(*TEXT).agg(F.collect_list(F.struct("pos", "n")).alias("marks"))
    copy = F.row_number().over(Window.partitionBy(*TEXT, "text").orderBy("is_null"))  # equal texts, not equal hashes
    whole = dealt.join(marks, TEXT, "left").withColumn("copy", copy).select("did", "is_null", "copy", "text", "marks")
    out = whole.mapInArrow(_cut(scheme, cut), "did long, is_null boolean, n_symbols long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("did", F.when(~F.col("is_null"), F.col("did"))).withColumnRenamed("did", "doc_id").drop("is_null")


def _cut_bytes(text: bytes, covered, copy: bool) -> tuple[int, int, int, bytes]:
    n = len(text)
    if copy and n >= w.BYTES.k:
        covered = [[0, n]]
    kept, at = [], 0
    for a, b in covered:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return n, sum(b - a for a, b in covered), len(covered), b"".join(kept)


def _cut_words(text: bytes, covered, copy: bool) -> tuple[int, int, int, bytes]:
    found = text.split()  # at the same six characters
    n = len(found)
    if copy and n >= w.WORDS.k:
        covered = [[0, n]]
    kept, at = [], 0
    for a, b in covered:
        kept += found[at:a]
        at = b
    kept += found[at:]
    return n, sum(b - a for a, b in covered), len(covered), b" ".join(kept)


def repeated_bytes(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Remove bytes covered by a string of 100 bytes that also starts earlier in the corpus.

    The anchors of step 1 are S* places, the ones that induced sorting samples: a byte smaller than the one
    before and followed by a rise. Of those in a window's first 64 bytes the one with the smallest name stands for the
    window. Nothing else is taken from induced sorting: no suffix is sorted, buckets hold hashes, which have no suffix
    order, and a tuple's second hash says whether its whole run stands earlier. ``repeated_words`` has the same scheme
    with another anchor.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``. Earlier means a smaller document id, then an
    earlier start; null ids come first. A null text is empty. Rows that share an id are ordered by a hash of the
    text; the second of two equal rows loses everything if it has 100 bytes. Texts of fewer bytes stay whole, an
    empty table gives an empty result, and other columns are ignored.
    """
    return without_repeats(docs, w.BYTES, _cut_bytes, crowd).withColumnRenamed("n_symbols", "n_bytes")


def repeated_words(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Remove words covered by a window of 20 words that also starts earlier in the corpus.

    Consecutive windows with one minimiser form a super-k-mer. It goes to the bucket of its minimiser, first as
    the hash of its words, which settles equal super-k-mers and those that are alone in their bucket. The others
    travel as one packed string to the bucket, where sorting tells which windows come twice.

    Returns ``doc_id, n_words, n_removed, kept_sha256`` with the kept words joined by one space, and ``n_spans``.
    Earlier means a smaller document id, then an earlier start; null ids come first. A null text has no words. Rows
    that share an id are ordered by a hash of the text; the second of two equal rows loses everything if it has
    20 words. An empty table gives an empty result, and other columns are ignored.
    """
    return without_repeats(docs, w.WORDS, _cut_words, crowd).withColumnRenamed("n_symbols", "n_words")
