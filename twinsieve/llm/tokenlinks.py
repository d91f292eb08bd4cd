"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.common import stored

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
CHUNK = 2 << 20  # characters of texts that are aligned at once
SLICE = 1 << 18  # characters of a text that a tokenizer gets at once
#: Between an ASCII letter and a space before another one, no token of either kind reaches across.
JOINT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


class Csr(NamedTuple):
    """A sparse matrix by rows: row i has ones in columns ``indices[indptr[i]:indptr[i + 1]]``."""

    indptr: np.ndarray
    indices: np.ndarray
    n_columns: int


def rows_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def byte_incidence(lengths: np.ndarray) -> Csr:
    """Tokens x bytes for tokens that follow one another."""
    ends = rows_of(lengths)
    return Csr(ends, np.arange(ends[-1]), int(ends[-1]))


def transposed(m: Csr) -> Csr:
    """Columns become rows; within a row the old rows stay in order."""
    row = np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr))
    if (m.indices[1:] < m.indices[:-1]).any():
        row = row[np.argsort(m.indices, kind="stable")]
    return Csr(rows_of(np.bincount(m.indices, minlength=m.n_columns)), row, len(m.indptr) - 1)


def row_products(a: Csr, b: Csr) -> tuple[Csr, np.ndarray]:
    """A·B and its values by Gustavson's row products: row i is the sum of the rows of B that row i of A names."""
    sizes = np.diff(b.indptr)[a.indices]
    at = np.repeat(b.indptr[a.indices] - rows_of(sizes)[:-1], sizes) + np.arange(int(sizes.sum()))
    row = np.repeat(np.repeat(np.arange(len(a.indptr) - 1), np.diff(a.indptr)), sizes)
    key = row * b.n_columns + b.indices[at]
    if len(key) and (key[1:] < key[:-1]).any():
        key = np.sort(key, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    values = np.diff(np.append(first, len(key)))
    row, column = np.divmod(key[first], max(1, b.n_columns))
    return Csr(rows_of(np.bincount(row, minlength=len(a.indptr) - 1)), column, b.n_columns), values


class Vocabulary(NamedTuple):
    encode: Callable[[list[str]], list[list[int]]]  # of texts, a space put before each
    token_bytes: list[bytes]
    lengths: np.ndarray
    cuts: bool  # a long text may be cut at JOINT


#: What splits a text before the merges, as byte-level vocabularies of this family have it. Fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside the plain Latin ranges, whose classes could differ between versions of Unicode.
OTHER = re.compile("[^\t-\r -~\u00a1-\u017f]")
LONG_GAP = re.compile(r"\s{300}")


def _plain(text: str) -> bool:
    """Whether both encoders of a vocabulary surely agree and the fast one is fast: Latin letters, no very long runs."""
    return not OTHER.search(text) and max(map(len, text.split()), default=0) < 300 and not LONG_GAP.search(text)


def _ranked(path: str, table: list[bytes]) -> Callable[[str], list[int]] | None:
    """An encoder of the same vocabulary that goes by ranks, if its merges make the ids in order and it splits alike."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    in_order = all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    single = sorted(i for i, b in enumerate(table) if len(b) == 1) == list(range(256))
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or not in_order or not single:
        return None
    ranks = {table[i]: i for i in range(256 + len(merges))}
    return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(None)
def byte_vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE in a JSON file; characters of its entries stand for bytes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes are written as themselves, the others from 256 on
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    entries = t.get_vocab(with_added_tokens=False)
    table = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        table[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else b""

    slow = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    fast = _ranked(path, table)

    def encode(texts: list[str]) -> list[list[int]]:
        spaced = [" " + x for x in texts]
        if fast is None:
            return slow(spaced)
        plain = [_plain(x) for x in spaced]
        rest = iter(slow([x for x, p in zip(spaced, plain) if not p]))
        return [fast(x) if p else next(rest) for x, p in zip(spaced, plain)]

    return Vocabulary(encode, table, np.array([len(b) for b in table], np.int64), type(t.pre_tokenizer).__name__ == "ByteLevel")


@lru_cache(None)
def piece_vocabulary(path: str) -> Vocabulary:
    """A sentence-piece model with byte pieces; U+2581 stands for a space, and the model puts one before a text."""
    import sentencepiece

    t = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [t.id_to_piece(i) for i in range(t.get_piece_size())]
    table = [bytes([int(p[3:5], 16)]) if t.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Vocabulary(lambda texts: t.encode(texts, num_threads=1), table, np.array([len(b) for b in table], np.int64),
                      not any("▁" in p.lstrip("▁") for p in pieces))


def slices(text: str, size: int = SLICE) -> list[str]:
    """The text cut at joints, without the space of each joint: every tokenizer puts one before a slice."""
    out, at = [], 0
    while len(text) - at > size:
        joint = JOINT.search(text, at + size)
        if joint is None:
            break
        out.append(text[at: joint.start()])
        at = joint.end()
    return [*out, text[at:]]


def tokens_of(vocabulary: Vocabulary, texts: list[str]) -> list[list[int]]:
    """Ids of the space and the text, none where their bytes are not those."""
    parts = [slices(t) if vocabulary.cuts else [t] for t in texts]
    found = iter(vocabulary.encode([p for ps in parts for p in ps]))
    out = []
    for text, ps in zip(texts, parts):
        ids = next(found) if len(ps) == 1 else [i for _ in ps for i in next(found)]
        out.append(ids if b"".join(map(vocabulary.token_bytes.__getitem__, ids)) == b" " + text.encode() else [])
    return out


class Alignment(NamedTuple):
    """Texts one after another as one run of bytes, so that all products are taken at once."""

    ids: tuple[np.ndarray, np.ndarray]
    starts: tuple[np.ndarray, np.ndarray]  # first token of every text, and the end
    links: Csr  # A tokens x B tokens
    overlap: np.ndarray  # bytes that each link shares
    groups: tuple[Csr, Csr]  # A tokens x groups, groups x B tokens
    group_starts: np.ndarray


def aligned(a: Vocabulary, b: Vocabulary, ids_a: list[list[int]], ids_b: list[list[int]]) -> Alignment:
    sides = []
    for vocabulary, ids in ((a, ids_a), (b, ids_b)):
        flat = np.fromiter(chain.from_iterable(ids), np.int64)
        starts = rows_of(np.array([len(x) for x in ids], np.int64))
        sides.append((flat, starts, byte_incidence(vocabulary.lengths[flat])))
    (flat_a, starts_a, bytes_a), (flat_b, starts_b, bytes_b) = sides
    links, overlap = row_products(bytes_a, transposed(bytes_b))
    ends_a, ends_b = bytes_a.indptr[1:], bytes_b.indptr[1:]
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    in_a = Csr(np.arange(len(ends_a) + 1), np.searchsorted(cuts, ends_a), len(cuts))
    in_b = Csr(np.arange(len(ends_b) + 1), np.searchsorted(cuts, ends_b), len(cuts))
    group_starts = np.searchsorted(cuts, bytes_a.indptr[starts_a], side="right")
    return Alignment((flat_a, flat_b), (starts_a, starts_b), links, overlap, (in_a, transposed(in_b)), group_starts)


@lru_cache(None)
def _labels(n_a: int, n_b: int) -> np.ndarray:
    """Ids as text with what follows: A within a group, A at its end, B within, B at the end."""
    return np.array([f"{i}{s}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for s in marks for i in range(n)], object)


def group_texts(m: Alignment, n_a: int, n_b: int) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for every text."""
    (a, b), (in_a, by_group) = m.ids, m.groups
    in_b = np.repeat(np.arange(len(by_group.indptr) - 1), np.diff(by_group.indptr))  # groups follow the tokens' order
    last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
    labels = np.concatenate((a + n_a * last(in_a.indices), b + 2 * n_a + n_b * last(in_b)))
    order = np.argsort(np.concatenate((2 * in_a.indices, 2 * in_b + 1)), kind="stable")
    said = _labels(n_a, n_b)[labels[order]].tolist()
    ends = (m.starts[0] + m.starts[1]).tolist()
    return ["".join(said[i:j])[:-1] for i, j in zip(ends, ends[1:])]


def _texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of about ``size`` characters; a longer text comes alone."""
    keys, texts, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = text.as_py() or ""
            if texts and held + len(text) > size:  # so a longer text comes alone
                yield keys, texts
                keys, texts, held = [], [], 0
            keys.append(key)
            texts.append(text)
            held += len(text) + 16
            if held > size:
                yield keys, texts
                keys, texts, held = [], [], 0
    if texts:
        yield keys, texts


def _both(a: Vocabulary, b: Vocabulary, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
    ids_a, ids_b = tokens_of(a, texts), tokens_of(b, texts)
    for i, text in enumerate(texts):
        if not (text and ids_a[i] and ids_b[i]):
            ids_a[i], ids_b[i] = [], []
    return ids_a, ids_b


_DOC = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                  ("n_group_links", pa.int64()), ("groups_sha256", pa.string()), ("n_pairs", pa.int64())])
_DOC_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, n_pairs long"


def _packed(values: np.ndarray) -> bytes:
    """Small numbers as four planes of bytes, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class _Chunk(NamedTuple):
    numbers: np.ndarray  # texts x (A tokens, B tokens, groups, links, links of a common group)
    digests: list[str]
    pairs: np.ndarray  # the distinct pairs linked, and the links of each
    counts: np.ndarray
    text: np.ndarray  # by text and pair: which, and how many links
    place: np.ndarray
    times: np.ndarray


def _numbers(m: Alignment) -> np.ndarray:
    shared = rows_of(np.diff(m.groups[1].indptr)[m.groups[0].indices])  # A·Bᵀ over groups, counted row by row
    return np.stack([np.diff(m.starts[0]), np.diff(m.starts[1]), np.diff(m.group_starts), np.diff(m.links.indptr[m.starts[0]]), np.diff(shared[m.starts[0]])], axis=1)


def _pairs(m: Alignment, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of ids, and per text which of them it links how often."""
    per_token = np.diff(m.links.indptr)
    pairs, place = np.unique(np.repeat(m.ids[0], per_token) * n_b + m.ids[1][m.links.indices], return_inverse=True)
    text = np.repeat(np.repeat(np.arange(len(m.starts[0]) - 1), np.diff(m.starts[0])), per_token)
    cell, times = np.unique(text * max(1, len(pairs)) + place, return_counts=True)
    return pairs, *np.divmod(cell, max(1, len(pairs))), times


def _digest(said: str) -> str:
    return hashlib.sha256(said.encode()).hexdigest() if said else ""


def _chunk(a: Vocabulary, b: Vocabulary, texts: list[str]) -> _Chunk:
    m = aligned(a, b, *_both(a, b, texts))
    pairs, text, place, times = _pairs(m, len(b.token_bytes))
    counts = np.bincount(place, times, len(pairs)).astype(np.int64)
    return _Chunk(_numbers(m), [_digest(s) for s in group_texts(m, len(a.token_bytes), len(b.token_bytes))], pairs, counts, text, place, times)


def _long_text(a: Vocabulary, b: Vocabulary, text: str) -> _Chunk:
    """One text slice by slice; both kinds of tokens end at a joint, so slices share no token, link or group."""
    nothing = np.zeros(0, np.int64)
    numbers, chain, pairs, counts = np.zeros((1, 5), np.int64), hashlib.sha256(), nothing, nothing
    for n, part in enumerate(slices(text)):
        ids_a, ids_b = _both(a, b, [part])
        if not ids_a[0]:
            return _Chunk(numbers * 0, [""], nothing, nothing, nothing, nothing, nothing)
        m = aligned(a, b, ids_a, ids_b)
        numbers = numbers + _numbers(m)
        chain.update((";" * (n > 0) + group_texts(m, len(a.token_bytes), len(b.token_bytes))[0]).encode())
        found, _, _, times = _pairs(m, len(b.token_bytes))
        pairs, place = np.unique(np.concatenate((pairs, found)), return_inverse=True)
        counts = np.bincount(place, np.concatenate((counts, times))).astype(np.int64)
    return _Chunk(numbers, [chain.hexdigest()], pairs, counts, np.zeros(len(pairs), np.int64), np.arange(len(pairs)), counts)


def _align_chunks(path_a: str, path_b: str, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_vocabulary(path_a), piece_vocabulary(path_b)
        part = TaskContext.get().partitionId() << 33
        for n, (keys, texts) in enumerate(_texts(batches, size)):
            long = len(texts) == 1 and len(texts[0]) > size and a.cuts and b.cuts
            c = _long_text(a, b, texts[0]) if long else _chunk(a, b, texts)
            bounds = np.searchsorted(c.text, np.arange(len(texts) + 1))
            docs = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), *map(pa.array, c.numbers.T.copy()), pa.array(c.digests, pa.string()), pa.array(np.diff(bounds))], fields=list(_DOC))
            whole = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            steps, begins = np.diff(c.place, prepend=0), bounds[:-1][np.diff(bounds) > 0]
            steps[begins] = c.place[begins]  # every text starts anew
            yield pa.RecordBatch.from_arrays(
                [pa.array([part + n]), whole(docs), whole(pa.array(c.pairs)), whole(pa.array(c.counts)), pa.array([_packed(steps)], pa.binary()), pa.array([_packed(c.times)], pa.binary())],
                names=["chunk", "docs", "pairs", "counts", "steps", "times"])

    return run


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text the links whose pair is its B id's most frequent one, and the sum of their pairs' counts."""
    for batch in batches:
        for i in range(batch.num_rows):
            docs, totals = batch.column("docs")[i].values, batch.column("totals")[i]
            per_text = docs.field("n_pairs").to_numpy()
            ends = rows_of(per_text)
            steps, times = (_unpacked(batch.column(c)[i].as_py()) for c in ("steps", "times"))
            run = np.cumsum(steps)
            place = run - np.repeat(np.concatenate(([0], run))[ends[:-1]], per_text)
            if totals.is_valid:
                total, best = (totals.values.field(c).to_numpy(zero_copy_only=False) for c in ("total", "best"))
                weighted, most = rows_of(times * total[place]), rows_of(times * best[place])
            else:  # no text of the chunk has a token
                weighted = most = np.zeros(len(times) + 1, np.int64)
            kept = [docs.field(f.name) for f in _DOC if f.name != "n_pairs"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(np.diff(most[ends])), pa.array(np.diff(weighted[ends]))],
                names=[*(f.name for f in _DOC if f.name != "n_pairs"), "n_best", "count_sum"])


def align_tokens(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, chunk_chars: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """How the tokens of a byte-level BPE (A) and a piece BPE (B) lie over each other, per text and for the corpus.

    A space and the text are encoded by A, the text by B, which adds the space. Both give tokens x bytes matrices in
    CSR; the row products A·Bᵀ are the links of overlapping tokens. Offsets where both end cut the tokens into groups;
    the products of tokens x groups are the links of a common group, counted per text.

    The first frame has ``doc_id, n_a, n_b, n_groups, n_links, n_group_links, groups_sha256, n_best, count_sum``;
    the second, one row per pair of ids, ``a_id, b_id, total, best`` (its links in all texts; whether no pair of its B
    id has more). Texts are aligned once, in chunks of about ``chunk_chars``: a chunk keeps its pairs and, per text,
    how often each of them is linked. Only pairs summed by chunk are shuffled to be counted; the counts come back
    to the chunk, so that a pair in every text is one row a chunk. The files of the vocabularies must be on every
    machine.

    A null or empty text has no tokens, and neither has one whose bytes one of the vocabularies does not give back.
    Such rows have zeros and an empty digest. A long text is tokenized in slices, cut where no token can reach across
    (if the vocabularies tell that), and is a chunk of its own,
    aligned slice by slice. Repeated rows and null ids stay as they are. An empty
    table gives empty frames; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = stored(rows.mapInArrow(_align_chunks(byte_bpe, piece_bpe, chunk_chars),
                                    f"chunk long, docs array<struct<{_DOC_DDL.replace(' ', ':').replace(',:', ',')}>>, pairs array<long>, counts array<long>, steps binary, times binary"), "aligned")
    n_b = len(piece_vocabulary(piece_bpe).token_bytes)
    b_id = F.pmod("pair", F.lit(n_b))
    mine = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p")).select("chunk", "place", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    totals = stored(mine.groupBy("pair").agg(F.sum("n").alias("total")), "aligned-pairs")
    most = totals.groupBy(b_id.alias("b_id")).agg(F.max("total").alias("most"))
    pairs = stored(totals.join(most, b_id == F.col("b_id")).select("pair", "b_id", "total", (F.col("total") == F.col("most")).alias("best")), "aligned-pairs")
    told = mine.join(pairs, "pair").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("place", "total", F.col("best").cast("long").alias("best")))).alias("totals"))
    per_text = chunks.select("chunk", "docs", "steps", "times").join(told, "chunk", "left").drop("chunk").mapInArrow(
        _sum_chunks, f"{_DOC_DDL.rsplit(',', 1)[0]}, n_best long, count_sum long")
    return per_text, pairs.select(F.expr(f"pair div {n_b}").alias("a_id"), F.col("b_id").cast("long").alias("b_id"), "total", "best")


def overlap_links(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, shared_group: bool = False) -> DataFrame:
    """The links themselves: ``doc_id, a_at, a_id, b_at, b_id, n_bytes``, tokens counted from 0.

    With ``shared_group`` all A and B tokens of a group are linked, and ``n_bytes`` is the number of groups they share.
    Nulls, empty texts and repeated rows as in ``align_tokens``.
    """
    names = ["doc_id", "a_at", "a_id", "b_at", "b_id", "n_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_vocabulary(byte_bpe), piece_vocabulary(piece_bpe)
        for keys, texts in _texts(batches, SLICE):
            m = aligned(a, b, *_both(a, b, texts))
            links, values = row_products(*m.groups) if shared_group else (m.links, m.overlap)
            at_a = np.repeat(np.arange(len(m.ids[0])), np.diff(links.indptr))
            text = np.repeat(np.arange(len(texts)), np.diff(m.starts[0]))[at_a]
            columns = [at_a - m.starts[0][text], m.ids[0][at_a], links.indices - m.starts[1][text], m.ids[1][links.indices], values]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()).take(pa.array(text)), *map(pa.array, columns)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))
