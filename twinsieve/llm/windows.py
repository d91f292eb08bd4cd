"""Numeric work of the repeat operators inside a task: runs of windows and their hashes, for one chunk of texts.

A text is a sequence of symbols (bytes, or words given by their hashes). All windows of K symbols that choose
the same anchor form a run. The anchor is the candidate place with the smallest rank inside the window; rank and
place depend on the window's own symbols only, so equal windows choose the same anchor wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 22  # symbols handled at a time
U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be divided out again
BYTE_CODES = np.random.Generator(np.random.PCG64(7)).integers(1, 2**64 - 1, 256, dtype=U)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n or more."""
    if len(_tables.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            t = np.full(n, base, U)
            t[0] = 1
            _tables[name] = np.cumprod(t, dtype=U)
    return _tables["up"], _tables["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


class Hashes:
    """Hashes of any stretch of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


@dataclass(frozen=True)
class Scheme:
    """Windows of ``k`` symbols; the anchor is one of ``width`` places from ``first`` on; ``key`` symbols from the anchor are in every window that chose it."""

    k: int
    width: int
    first: int
    key: int
    gram: int  # symbols in one hashed value

    def values(self, symbols: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def ranks(self, symbols: np.ndarray, values: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts and where each text's begin."""
        raise NotImplementedError

    def packer(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Callable[[int, int], bytes]]:
        """Where each text's symbols begin, and a function that packs the symbols from a place up to another."""
        raise NotImplementedError


class Bytes(Scheme):
    """Anchors are S* places (a smaller byte than before, rising after it), ranked by the name of the eight bytes there."""

    def symbols(self, data, offsets):
        return data, offsets

    def packer(self, data, offsets):
        return offsets, lambda a, b: data[a:b].tobytes()

    def values(self, symbols):
        padded = np.zeros(len(symbols) + 8, np.uint8)
        padded[: len(symbols)] = symbols
        return mixed(np.ndarray(len(symbols), "<u8", padded, strides=(1,)).astype(U))

    def ranks(self, symbols, values):
        b = np.zeros(len(symbols) + 2, np.uint8)
        b[: len(symbols)] = symbols
        here, then, after = b[:-2], b[1:-1], b[2:]
        star = (here < then) | ((here == then) & (then < after))
        star[1:] &= here[:-1] > here[1:]
        star[:1] = False
        return np.where(star, values >> U(33), U(0xFFFFFFFF))


class Words(Scheme):
    """Anchors are any places, ranked by the hash of three words: minimisers."""

    def symbols(self, data, offsets):
        starts, ends = word_bounds(data, offsets)
        out = np.empty(len(starts), U)
        i = 0
        while i < len(starts):  # whole words, about CHUNK bytes at a time
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK)))
            lo, hi = int(starts[i]), int(ends[j - 1])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mixed(Hashes(BYTE_CODES[data[lo:hi]]).of(s, e) + (e - s).astype(U))
            i = j
        return out, np.searchsorted(starts, offsets)

    def packer(self, data, offsets):
        starts, ends = word_bounds(data, offsets)
        return np.searchsorted(starts, offsets), lambda a, b: b" ".join(data[starts[a]: ends[b - 1]].tobytes().split())

    def values(self, symbols):
        return symbols

    def ranks(self, symbols, values):
        v = np.zeros(len(values) + 2, U)
        v[: len(values)] = values
        return mixed(v[:-2] + v[1:-1] * U(3) + v[2:] * U(0x100000001B3)) >> U(32)


BYTES = Bytes(k=100, width=64, first=1, key=36, gram=8)
WORDS = Words(k=20, width=14, first=0, key=7, gram=1)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; words end with their text."""
    full = ~SPACE[data]
    first, last = full.copy(), full.copy()
    first[1:] &= ~full[:-1]
    last[:-1] &= ~full[1:]
    some = offsets[:-1][np.diff(offsets) > 0]
    first[some] = full[some]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends] = full[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def pieces(offsets: np.ndarray, k: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, from, to) of about CHUNK symbols in all; the pieces of a long text overlap by k - 1."""
    batch, size = [], 0
    for t, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while hi - lo >= k:
            end = min(hi, lo + CHUNK)
            batch.append((t, lo, end))
            size += end - lo
            lo = end - k + 1 if end < hi else hi
            if size >= CHUNK:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


def joined(symbols: np.ndarray, batch: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([hi - lo for _, lo, hi in batch])
    if all(a[2] == b[1] for a, b in zip(batch, batch[1:])):  # neighbours: no copy
        return symbols[batch[0][1]: batch[-1][2]], np.concatenate([[0], np.cumsum(lens)])
    return np.concatenate([symbols[lo:hi] for _, lo, hi in batch]), np.concatenate([[0], np.cumsum(lens)])


def runs(scheme: Scheme, symbols: np.ndarray, batch: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
    """Of every run in the batch: text, first window, number of windows, hash from the anchor, hash of all it spans."""
    s, ends = joined(symbols, batch)
    values = scheme.values(s)
    best = (scheme.ranks(s, values) << U(32)) | np.arange(len(s), dtype=U)
    step = 1
    while step < scheme.width:  # smallest of the next ``width``, doubling the reach
        reach = min(step, scheme.width - step)
        best = np.concatenate([np.minimum(best[:-reach], best[reach:]), best[len(best) - reach:]])
        step += reach
    anchor = (best & U(0xFFFFFFFF)).astype(np.int64)
    anchor = np.concatenate([anchor[scheme.first:], np.zeros(scheme.first, np.int64)])
    valid = np.ones(len(s) + 1, bool)
    valid[-1] = False
    for e in ends[1:].tolist():
        valid[e - scheme.k + 1: e] = False
    change = np.ones(len(s) + 1, bool)
    change[1:-1] = (anchor[1:] != anchor[:-1]) | ~valid[:-2]
    start = np.flatnonzero(change[:-1] & valid[:-1])
    stop = np.flatnonzero(valid[:-1] & (change[1:] | ~valid[1:])) + 1
    a, tail = anchor[start], scheme.gram - 1
    h = Hashes(values)
    key = h.of(a, a + scheme.key - tail)
    full = mixed(h.of(start, stop + (scheme.k - 1 - tail)) + (stop - start).astype(U) * U(0x9FB21C651E98DF25) + (a - start).astype(U) * U(0xA24BAED4963EE407))
    which = np.searchsorted(ends, start, "right") - 1
    text = np.array([b[0] for b in batch])[which]
    base = np.array([b[1] for b in batch])[which] - ends[which]
    return text, start + base, stop - start, key.view(np.int64), full.view(np.int64)


def window_hashes(scheme: Scheme, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each window that starts at one of the ascending places."""
    out = np.empty((2, len(at)), np.int64)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK)))
        lo, hi = int(at[i]), int(at[j - 1]) + scheme.k
        values = scheme.values(symbols[lo:hi])
        p, end = at[i:j] - lo, at[i:j] - lo + scheme.k - scheme.gram + 1
        out[0, i:j] = Hashes(values).of(p, end).view(np.int64)
        out[1, i:j] = Hashes(mixed(values ^ U(0xC2B2AE3D27D4EB4F))).of(p, end).view(np.int64)
        i = j
    return out[0], out[1]


def later_copies(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs (x, y) equal an earlier one."""
    order = np.lexsort((y, x))  # stable
    same = (x[order][1:] == x[order][:-1]) & (y[order][1:] == y[order][:-1])
    out = np.zeros(len(x), bool)
    out[order[1:][same]] = True
    return out


def bytes_of(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column and where each value begins, whether its offsets have 32 or 64 bits."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]: offsets[-1]], offsets - offsets[0]


def texts_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in (did, tid, size) order without repeats of the three: their places in the batch, the three, bytes and offsets."""
    did, tid, size = (batch.column(c).to_numpy() for c in ("did", "tid", "size"))
    order = np.lexsort((size, tid, did))
    keep = np.ones(len(order), bool)
    keep[1:] = np.any([c[order][1:] != c[order][:-1] for c in (did, tid, size)], 0)
    order = order[keep]
    column = batch.column("text")
    if len(order) != len(column) or (np.diff(order) != 1).any():
        column = column.take(pa.array(order))
    return order, did[order], tid[order], size[order], *bytes_of(column)


def spans(text: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring runs of one text joined."""
    if not len(at):
        return text, at, n
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (at[1:] != at[:-1] + n[:-1])
    i = np.flatnonzero(new)
    last = np.append(i[1:], len(at)) - 1
    return text[i], at[i], at[last] + n[last] - at[i]
