"""Candidates that share no band with a few reference texts are settled before they are sketched."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsieve.functions import sketches as sk
from twinsieve.functions import text as t
from twinsieve.operators import neardup as nd

WORDS = ["".join(x) for x in np.random.default_rng(2).choice(list("abcdefghijklmnopqrstuvwxyz"), (3000, 7))]


def made(rng, n, size):
    return [" ".join(rng.choice(WORDS, rng.integers(1, size))) for _ in range(n)]


def changed(rng, text, share):
    return " ".join(str(rng.choice(WORDS)) if rng.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(11)
    refs = made(rng, 40, 60) + ["", "a", "four", "x" * 5000]
    cands = made(rng, 150, 700) + [changed(rng, x, s) for x in refs[:40] for s in (0.02, 0.1, 0.3)]
    cands += [f"{x} {y}" for x, y in zip(refs[:40], made(rng, 40, 200))] + ["", "a", "b", "four", "x" * 9, "x" * 20000]
    return cands, refs


def test_meeting_is_a_shared_band(texts):
    cands, refs = texts
    a, b = sk.permutations(3131)
    low = lambda x: sk.minima(sk.gram_hashes(x), a, b)
    listed = np.stack([low(x) for x in refs if x])
    keys = {(band, k) for x in listed for band, k in enumerate(sk.band_keys(x).tolist())}
    want = [bool(x) and any((band, k) in keys for band, k in enumerate(sk.band_keys(low(x)).tolist())) for x in cands]
    meets = sk.Meeting(listed)
    assert [meets(sk.gram_codes(x)) for x in cands] == want
    assert 20 < sum(want) < len(cands) - 20


def test_only_meeting_candidates_are_sketched(spark, texts, monkeypatch):
    cands, refs = texts
    frame = lambda x: spark.createDataFrame([*enumerate(x), (None, x[0]), (len(x), None)], "id bigint, text string")
    seen = []
    real = nd.lsh_best
    monkeypatch.setattr(nd, "lsh_best", lambda c, r, *a, **k: seen.append(c.count()) or real(c, r, *a, **k))
    rows = {}
    for few in (nd.FEW_TEXTS, 0):
        monkeypatch.setattr(nd, "FEW_TEXTS", few)
        rows[few] = [sorted(map(str, nd.near_duplicates(frame(cands), frame(refs), x).collect())) for x in (0.0, 0.5)]
    assert rows[nd.FEW_TEXTS] == rows[1024] and len(rows[1024][0]) > len(rows[1024][1]) > 10
    assert seen[0] == seen[1] < seen[2] - 20, "candidates without a shared band are sketched"


def test_no_reference_text(spark):
    some = spark.createDataFrame([(1, "one two three"), (2, "")], "id bigint, text string")
    for refs in (some.limit(0), some.filter("id = 2")):
        assert nd.near_duplicates(some, refs, 0.0).count() == 0


def test_normal_form_in_one_step(spark):
    odd = ["  A-b__c​D\t\n é ß!? 1²½ ", "ÀḈ \U0001d4d0 \U0001f600x", "", "...", "İI_\x0b\x1f9", "数字 一，二"]
    df = spark.createDataFrame([(x,) for x in odd], "text string")
    old = F.lower(F.replace(F.col("text"), F.lit(t.ZERO_WIDTH), F.lit("")))
    old = F.trim(F.regexp_replace(F.regexp_replace(old, t.PUNCT, " "), t.SPACE, " "))
    assert all(r.a == r.b for r in df.select(old.alias("a"), t.norm_neardup(F.col("text")).alias("b")).collect())
