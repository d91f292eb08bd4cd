"""Repeated bytes and words against a set of all windows."""

import hashlib
import random

import pytest
import xxhash

from tests.llm import brute
from twinsieve.llm import windows
from twinsieve.llm.repeats import repeated_bytes, repeated_words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, did string, n int, marks string"


def digest(b):
    return hashlib.sha256(b).hexdigest()


def expect(rows, words):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    if words:
        seqs = [(i, (t or "").encode().split()) for i, t in rows]
        got = brute.repeats(seqs, 20, tuple, b" ".join)
    else:
        seqs = [(i, (t or "").encode()) for i, t in rows]
        got = brute.repeats(seqs, 100, bytes, bytes)
    return [(i, n, r, s, digest(k)) for (i, _), (n, r, s, k) in zip(rows, got)]


def run(spark, rows, words, parts=3, crowd=4096):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(parts)
    out = (repeated_words if words else repeated_bytes)(df, crowd)
    n = "n_words" if words else "n_bytes"
    return sorted([(r.doc_id, r[n], r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()], key=lambda r: (r[0] is not None, r[0] or 0))


def cases():
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage, line = text(40), text(21)
    docs = [None, "", " ", "short", "a" * 99, "a" * 100, "a" * 350, "ab" * 300, " " * 500, "the " * 400]
    for i in range(60):
        docs.append(rnd.choice(["\n", " ", "  "]).join([text(rnd.randint(0, 80)), rnd.choice([passage, line, text(30), passage[13:200]]), text(rnd.randint(0, 30))]))
    near = text(200).split()
    for _ in range(25):
        copy = list(near)
        copy[rnd.randrange(200)] = "edit"
        docs.append(" ".join(copy))
    docs += [docs[20]] * 7 + [text(3000) + passage + text(2000)]
    rnd.shuffle(docs)
    return [(i * 3, t) for i, t in enumerate(docs)] + [(None, passage + " null id")]


@pytest.mark.parametrize("crowd", [4096, 3])  # 3: most buckets are split
@pytest.mark.parametrize("words", [False, True])
def test_against_all_windows(spark, words, crowd):
    rows = cases()
    assert run(spark, rows, words, crowd=crowd) == expect(rows, words)


@pytest.mark.parametrize("words", [False, True])
def test_long_texts_in_pieces(spark, words, monkeypatch):
    rows = cases()[:50]
    # in-process: the chunk size must not change a single run's windows
    scheme = windows.WORDS if words else windows.BYTES
    import numpy as np

    data = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8)
    offsets = np.cumsum([0] + [len((t or "").encode()) for _, t in rows])
    symbols, offsets = scheme.symbols(data, offsets)

    def covered():
        out = set()
        for piece in windows.pieces(offsets, scheme.k):
            text, pos, n, key, full = windows.runs(scheme, symbols, piece)
            for t, p, m, k in zip(text.tolist(), pos.tolist(), n.tolist(), key.tolist()):
                out |= {(t, p + j, k) for j in range(m)}
        return out

    whole = covered()
    monkeypatch.setattr(windows, "CHUNK", 700)
    assert covered() == whole
    assert len(whole) == sum(max(0, b - a - scheme.k + 1) for a, b in zip(offsets[:-1], offsets[1:]))


@pytest.mark.parametrize("words", [False, True])
def test_repeated_rows_and_empty(spark, words):
    t = " ".join(f"w{i}" for i in range(60))
    got = run(spark, [(1, t)] * 3 + [(2, "x")] * 2, words)
    assert sorted(r[2] for r in got if r[0] == 1)[0] == 0 and [r[2] for r in got if r[0] == 2] == [0, 0]
    assert sum(r[1] == r[2] for r in got if r[0] == 1) == 2
    assert run(spark, [], words) == []


@pytest.mark.parametrize("words", [False, True])
def test_documents(spark, words):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert run(spark, rows, words, 5) == expect(rows, words)


@pytest.mark.parametrize("words", [False, True])
def test_short_hash_collision(spark, words):
    """Two texts of one id whose 64-bit hashes agree in the lower half are two texts."""
    seen, pair = {}, None
    for i in range(400_000):
        t = " ".join(f"{i}x{j}" for j in range(24))
        other = seen.setdefault(xxhash.xxh64_intdigest(t.encode(), 42) & 0xFFFFFFFF, i)
        if other != i:
            pair = [" ".join(f"{n}x{j}" for j in range(24)) for n in (other, i)]
            break
    for key in (None, 4):
        rows = [(key, t) for t in pair] + [(key, pair[0]), (9, pair[1])]
        got = run(spark, rows, words, parts=1)
        assert sorted(r[1] == r[2] for r in got if r[0] == key) == [False, False, True]
        assert sorted(r[2] for r in got if r[0] == key)[:2] == [0, 0]
        assert [r[1] == r[2] for r in got if r[0] == 9] == [True]  # the second text is offered to later ones


@pytest.mark.parametrize("words", [False, True])
@pytest.mark.parametrize("large", ["true", "false"])
def test_both_widths_of_arrow_offsets(spark, words, large):
    rows = [(1, " ".join(f"word{i}" for i in range(60))), (2, " ".join(f"word{i}" for i in range(60))), (3, "alone")]
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", large)
    try:
        assert run(spark, rows, words) == expect(rows, words)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.useLargeVarTypes")
