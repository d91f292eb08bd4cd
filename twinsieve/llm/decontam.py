"""Benchmark decontamination: BM25 retrieval of test items with block-max bounds, then shingle overlap."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.common import stored, text_of

TOKEN = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"[.!?\n]+\s*")
SHINGLE = 5
OVERLAP = 0.8
EPS = 1e-9
K1, B = 1.2, 0.75
BLOCK = 16  # items under one bound
FLOOR = 0.05  # items whose threshold is a lower share of their own score are not left to BM25
INDEX_BYTES = 4 << 20  # of item texts in one broadcast index
PASSES = 4  # indexes that a task holds at once

PAIRS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, overlap double"


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def answer_start(text: str) -> int:
    """Number of tokens before the last sentence, which is taken for the answer when overlaps are told apart."""
    ends = [m.end() for m in SENTENCE_END.finditer(text) if tokens(text[m.end():])]
    return len(tokens(text[: ends[-1]])) if ends else 0


def _slices(starts: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Places of all postings of some terms."""
    lo, n = starts[terms], starts[terms + 1] - starts[terms]
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Codes(dict):
    """Numbers of terms; -1 for one that no item has."""

    def __missing__(self, term: str) -> int:
        return -1


class Index:
    """BM25 weights and shingles of a bounded set of items.

    A text that holds OVERLAP of an item's S shingles, wherever they stand, misses at most (1 - OVERLAP) S of its words,
    whatever they are. So its score is at least the item's own less that many of its largest weights: the threshold
    of the item. Retrieval above it misses no pair that the overlap test would report. Weights are kept as shares of
    what an item must score, so that its threshold is 1, with a bound per (term, block of items). An item whose
    threshold is below FLOOR is verified for every text that has one of its words.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], df: dict[str, int], n_items: int, mean_length: float):
        items = [(i, t) for i, t in items if tokens(t)]
        self.ids = [i for i, _ in items]
        found = [tokens(t) for _, t in items]
        self.terms = Codes()
        for ts in found:
            for t in ts:
                self.terms.setdefault(t, len(self.terms))
        self.coded = [np.array([self.terms[t] for t in ts], np.int64) for ts in found]
        self.split = [answer_start(t or "") for _, t in items]
        idf = np.zeros(len(self.terms))
        for t, k in self.terms.items():
            idf[k] = np.log1p((n_items - df[t] + 0.5) / (df[t] + 0.5))
        if self.ids:
            self._weigh(idf, mean_length)
            self._file()

    def _weigh(self, idf: np.ndarray, mean_length: float) -> None:
        """Postings of term t: starts[t] .. starts[t + 1]; least is what each item must score, as a share of its own score."""
        rows, self.least, self.always = [], np.ones(len(self.ids)), np.zeros(len(self.ids), bool)
        for n, code in enumerate(self.coded):
            tf = Counter(code.tolist())
            w = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(code) / mean_length)) for t, f in tf.items()}
            total = sum(w.values())
            shingles = max(1, len(code) - SHINGLE + 1)
            missed = shingles - math.ceil(OVERLAP * shingles - EPS)
            least = 1 - sum(sorted(w.values(), reverse=True)[:missed]) / total
            self.always[n], self.least[n] = least < FLOOR, max(FLOOR, least)
            rows += [(t, n, x / total / self.least[n]) for t, x in w.items()]
        rows.sort()
        term, self.posting_item, self.posting_weight = (np.array(c) for c in zip(*rows))
        blocks: dict[tuple[int, int], float] = {}
        for t, n, x in rows:
            blocks[t, n // BLOCK] = max(x, blocks.get((t, n // BLOCK), 0.0))
        b_term, self.block_no = (np.array(c) for c in zip(*blocks))
        self.block_weight = np.array(list(blocks.values()))
        self.always_blocks = np.unique(np.flatnonzero(self.always) // BLOCK)
        edge = np.arange(len(self.terms) + 1)
        self.starts, self.block_starts = np.searchsorted(term, edge), np.searchsorted(b_term, edge)

    def _file(self) -> None:
        """Numbers for all runs of 1 to SHINGLE words in the items, and the items that have a run as a shingle.

        A run is the number of the run without its last word, and that word; so equal numbers are equal words.
        """
        size = np.array([len(c) for c in self.coded])
        code, owner = np.concatenate(self.coded), np.repeat(np.arange(len(size)), size)
        rest = np.repeat(np.cumsum(size), size) - np.arange(len(code))
        self.length = np.minimum(size, SHINGLE)  # words of an item's shingles
        self.n_shingles = size - self.length + 1
        self.grams: list[np.ndarray] = [np.zeros(0, np.int64)] * len(size)  # shingles of each item, in order
        self.runs, self.filed = [], []
        number = code.copy()
        for k in range(1, SHINGLE + 1):
            at = np.flatnonzero(rest >= k)
            if k > 1:
                run, inverse = np.unique(number[at] * len(self.terms) + code[at + k - 1], return_inverse=True)
                self.runs.append(run)
                number[at] = inverse
            own = at[self.length[owner[at]] == k]
            for i, g in zip(np.unique(owner[own]).tolist(), np.split(number[own], np.flatnonzero(np.diff(owner[own])) + 1)):
                self.grams[i] = g
            pair, n = np.unique(np.stack([number[own], owner[own]], 1), axis=0, return_counts=True)
            n_runs = len(self.terms) if k == 1 else len(self.runs[-1])
            self.filed.append((np.searchsorted(pair[:, 0], np.arange(n_runs + 1)), pair[:, 1], n))

    def _above(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """Items that reach their threshold for a set of terms. Blocks whose bound is lower are skipped."""
        at = _slices(self.block_starts, terms)
        bound = np.bincount(self.block_no[at], self.block_weight[at])
        own = self.always_blocks[self.always_blocks < len(bound)]
        bound[own] = np.where(bound[own] > 0, np.maximum(1, bound[own]), 0)
        if not (bound >= 1 - EPS).any():
            return []
        at = _slices(self.starts, terms)
        at = at[bound[self.posting_item[at] // BLOCK] >= 1 - EPS]
        score = np.bincount(self.posting_item[at], self.posting_weight[at])
        ask = (score >= 1 - EPS) | (self.always[: len(score)] & (score > 0))
        return [(int(i), float(score[i] * self.least[i])) for i in np.flatnonzero(ask)]

    def _present(self, code: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
        """Numbers of the items' runs of 1 to SHINGLE words that a text holds."""
        number, out = code[place], []
        for k in range(1, SHINGLE + 1):
            if k > 1:
                fits = place + k - 1 < len(code)
                place, number = place[fits], number[fits]
                key, run = number * len(self.terms) + code[place + k - 1], self.runs[k - 2]
                if not len(run):
                    place, number = place[:0], number[:0]
                else:
                    number = np.minimum(np.searchsorted(run, key), len(run) - 1)
                    known = (code[place + k - 1] >= 0) & (run[number] == key)
                    place, number = place[known], number[known]
            out.append(np.unique(number))
        return out

    def _overlaps(self, i: int, present: np.ndarray) -> tuple[float, float, float]:
        """Shares of an item's shingles in a text: those before the answer, those that end in it, all."""
        hits = np.isin(self.grams[i], present)
        in_answer = np.arange(len(hits)) + self.length[i] > self.split[i]
        share = lambda h: float(h.mean()) if len(h) else 1.0
        return share(hits[~in_answer]), share(hits[in_answer]), share(hits)

    def matches(self, text: str | None) -> dict[int, tuple[float, float, float, float]]:
        """Leaked items of a text: score and overlaps.

        The query is the set of words of the whole text, so no copy is lost at the edge of a passage, however many
        words stand between its parts. What it retrieves is verified by looking up the text's runs of words, whose
        cost does not depend on the number of items retrieved.
        """
        code = np.array(list(map(self.terms.__getitem__, tokens(text))), np.int64)
        out: dict[int, tuple[float, float, float, float]] = {}
        place = np.flatnonzero(code >= 0)
        if not len(place):
            return out
        above = self._above(np.unique(code[place]))
        if not above:
            return out
        present, count = self._present(code, place), np.zeros(len(self.ids))
        for there, (starts, item, n) in zip(present, self.filed):
            at = _slices(starts, there)
            count += np.bincount(item[at], n[at], len(count))
        for i, score in above:
            if count[i] / self.n_shingles[i] >= OVERLAP:
                # sums of scores may differ in the last digits
                out[i] = (round(score, 6), *self._overlaps(i, present[self.length[i] - 1]))
        return out


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The items as one index, or several of about INDEX_BYTES each; document frequencies are those of all items.

    Tasks build the indexes and write them to the shared folder, one row each. The driver takes one at a time, so it
    holds a bounded part of the benchmark however large this is.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).distinct()
    items = stored(items, "items")
    size, n_items = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    if not n_items:
        return
    n_blocks = max(1, -(-size // INDEX_BYTES))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))

    def distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(b.as_py(), t, len(ts)) for b, x in zip(batch.column("block"), batch.column("text")) for ts in [tokens(x.as_py())] for t in dict.fromkeys(ts)]
            block, term, length = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(term, pa.string()), pa.array(length, pa.int64())], names=["block", "term", "length"])

    terms = stored(items.mapInArrow(distinct_terms, "block long, term string, length long"), "item-terms")
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    lengths = items.select(F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("n"))
    mean_length = max(1.0, lengths.agg(F.avg("n")).first()[0])

    def build(key: tuple, own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["item_id", "text"])
        rows = [(None if pd.isna(i) else int(i), t) for i, t in zip(own["item_id"], own["text"])]
        index = Index(rows, dict(zip(known["term"], known["df"].tolist())), n_items, mean_length)
        return pd.DataFrame({"block": [key[0]], "index": [cloudpickle.dumps(index)]})

    known = terms.select("block", "term").distinct().join(df, "term")
    named = items.withColumn("item_id", F.col("item_id").cast("string"))  # no detour through doubles where an id is null
    built = stored(named.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(build, "block long, index binary"), "item-indexes")
    for block in range(n_blocks):
        row = built.filter(F.col("block") == block).first()
        if row is not None:
            yield cloudpickle.loads(row["index"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds.

    The words of every text are a query to the index of items. It retrieves the items whose threshold its BM25
    score reaches (see ``Index``); bounds per block of items rule out the rest unseen. A pair is reported if the
    text holds 0.8 or more of the item's 5-word shingles, wherever they stand. The shares of the question and of the
    answer (the shingles that end in the last sentence) are told, but decide nothing. Words are runs of letters and
    digits, case ignored.

    Returns ``doc_id, item_id, score, question_overlap, answer_overlap, overlap``, the score being that of the whole
    text, one row per document row and item. The texts do not move: each task reads its documents against the broadcast index,
    whose size is bounded; a larger benchmark gives several indexes and as many scans. Null texts and items
    without words match nothing; an item shorter than 5 words is one shingle; a null id stays null; repeated items
    count once, repeated documents as often as they come; an empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    out = None
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = []
                for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                    found += [(doc.as_py(), index.ids[i], *m) for i, m in index.matches(text.as_py()).items()]
                cols = zip(*found) if found else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n < 2 else pa.float64()) for n, c in enumerate(cols)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "overlap"])

        part = rows.mapInArrow(run, PAIRS)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], PAIRS)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item."""
    for n, index in enumerate(indexes(benchmark), 1):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index("text")
                yield batch.filter(pa.array([not shared.value.matches(t.as_py()) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if n % PASSES == 0:
            docs = stored(docs, "clean")
    return docs
