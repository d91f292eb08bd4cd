"""Seeded, partition-independent pseudo-randomness from md5.

A seeded shuffle is an order by ``order_key``; a seeded coin is ``fraction``. Neither depends on how
the rows are laid out, so a lost task that is run again draws the same values.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 4294967296.0


def order_key(seed: int, *cols: Column | str) -> Column:
    """32 hex digits that order rows as a shuffle under ``seed`` would."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.md5(text.cast("binary"))


def u32(seed: int, *cols: Column | str) -> Column:
    """The first 32 bits of the seeded digest as a long."""
    return F.conv(F.substring(order_key(seed, *cols), 1, 8), 16, 10).cast("long")


def pick(seed: int, n: int | Column, *cols: Column | str) -> Column:
    """A seeded choice in ``0 .. n-1``."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(u32(seed, *cols), n.cast("long"))


def fraction(seed: int, *cols: Column | str) -> Column:
    """A seeded number in (0, 1)."""
    return (u32(seed, *cols) + F.lit(0.5)) / F.lit(U32)


# Cumulative probabilities of Poisson(1) for 0, 1, 2, ...
POISSON1 = [
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253,
    0.999998874797402, 0.9999998885745217, 0.9999999899522336,
]


def draws_of(seed: int, group: Column, key: Column) -> Column:
    """A digest that holds four independent 32-bit draws for (seed, group, key)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), group.cast("string"), key.cast("string")).cast("binary"))


def poisson1(digest: str, lane: Column) -> Column:
    """Poisson(1) count from draw 0 to 3 of a digest: the draw's hex digits are compared with the steps' digits."""
    x = F.substring(F.col(digest), lane * 8 + 1, F.lit(8))
    step = lambda p: f"{math.ceil(p * U32 - 0.5):08x}"  # noqa: E731  the first draw whose middle reaches p
    count = F.when(x < step(POISSON1[0]), 0)
    for n, p in enumerate(POISSON1[1:], 1):
        count = count.when(x < step(p), n)
    return count.otherwise(len(POISSON1)).cast("long")


_BATCH = 1 << 15  # digests made at once, so that they stay in the cache
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_STEPS = [np.uint32(math.ceil(p * U32 - 0.5)) for p in POISSON1]


def _md5(words: Sequence[np.ndarray | int], shape: tuple[int, int]) -> list[np.ndarray]:
    """MD5 of messages of one block each, word by word: a digest by itself costs a call, and a row has hundreds.

    A word that is the same along a side of ``shape`` is given once: as a number, a row or a column.
    """
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, low = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            at = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        word = words[at]
        f += np.uint32((_ADDED[i] + word) % 2**32) if isinstance(word, int) else word + np.uint32(_ADDED[i])
        np.left_shift(f, np.uint32(_TURNS[i]), out=low)
        f >>= np.uint32(32 - _TURNS[i])
        f |= low
        f += b
        a, d, c, b, f = d, c, b, f, a
    return [x + np.uint32(s) for x, s in zip((a, b, c, d), _START)]


def draws_in(seed: int, groups: int, keys: Sequence[bytes | None]) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """The draws of ``draws_of`` for all groups of a batch of keys: some groups, and four arrays (groups, keys) of 32 bits."""
    n = len(keys)
    tails = [b"" if k is None else b":" + k for k in keys]  # a key that is null is left out of the text
    heads = [f"{seed}:{g}".encode() for g in range(groups)]
    sizes = np.array([len(x) for x in tails])
    longer = np.flatnonzero(sizes + max(map(len, heads)) > 55).tolist()  # more than one block
    if longer:
        sizes[longer] = 0
    flat = np.array([b"" if 0 == s else x for s, x in zip(sizes.tolist(), tails)], "S56").view(np.uint8).reshape(n, 56)
    at_once, g = max(1, _BATCH // n), 0
    while g < groups:
        size = len(heads[g])
        end = min(g + at_once, groups)
        some = [h for h in heads[g:end] if len(h) == size]
        m = len(some)
        if not g or size != len(heads[g - 1]):  # the words of the keys are the same for all heads of one size
            text = np.zeros((n, 64), np.uint8)
            text[:, size:56] = flat[:, : 56 - size]
            text[np.arange(n), size + sizes] = 0x80
            base = np.ascontiguousarray(text.view("<u4").T)
            base[14] = 8 * (size + sizes)
            base = [w if w.any() else 0 for w in base]
        words: list[np.ndarray | int] = list(base)
        head = np.array(some, f"S{-(-size // 4) * 4}").view("<u4").reshape(m, -1)
        for i in range(head.shape[1]):
            words[i] = words[i] | head[:, i : i + 1]
        out = [x.byteswap(inplace=True) for x in _md5(words, (m, n))]
        for i in longer:
            for k, h in enumerate(some):
                for x, v in zip(out, np.frombuffer(hashlib.md5(h + tails[i], usedforsecurity=False).digest(), ">u4")):
                    x[k, i] = v
        yield slice(g, g + m), out
        g += m


def poisson1_in(x: np.ndarray) -> np.ndarray:
    """The counts of ``poisson1`` for an array of draws."""
    count, more = np.zeros(x.shape, np.uint8), np.empty(x.shape, bool)
    for step in _STEPS:
        np.greater_equal(x, step, out=more)
        count += more.view(np.uint8)
    return count
