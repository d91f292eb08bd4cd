"""SimHash groups against all pairs."""

import random

import pytest

from tests.llm import brute
from twinsieve.llm.components import components
from twinsieve.llm.simhash import near_duplicates, near_links

SF = "/root/testdata/sf0.001"


def groups(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("crowd", [1024, 3, 1])
def test_links_join_the_same_fingerprints(spark, crowd):
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) - (1 << 63) for _ in range(150)} | {0, -1}
    for f in list(fps)[:40]:
        for _ in range(6):
            for _ in range(rnd.randint(1, 6)):
                b = rnd.randrange(64)
                f ^= (1 << b) if b < 63 else -(1 << 63)
            fps.add(f)
    fps = sorted(fps)
    want = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    got = [tuple(r) for r in near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), crowd).collect()]
    assert set(map(frozenset, got)) - {frozenset((a,)) for a in fps} <= set(map(frozenset, want))
    assert groups(got, fps) == groups(want, fps)


def test_components_of_a_long_chain(spark):
    pairs = [(i * 7919 % 3001, (i + 1) * 7919 % 3001) for i in range(2500)] + [(9000, 9001), (9001, 9002)]
    nodes = {x for p in pairs for x in p}
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = groups(pairs, nodes)
    assert {frozenset(n for n in got if got[n] == r) for r in got.values()} == {frozenset(n for n in want if want[n] == r) for r in want.values()}


def test_rounds_on_ordered_chains(spark, monkeypatch):
    """Ascending, descending and zigzag chains of 3,000 links side by side, whose numbers are as bad as can be."""
    from twinsieve.llm import components as module

    n, rounds = 3000, []
    up = [(i, i + 1) for i in range(n)]
    down = [(10**6 - i, 10**6 - i - 1) for i in range(n)]
    ends = [2 * 10**6 + (i // 2 if i % 2 else n - i // 2) for i in range(n + 1)]
    pairs = up + down + list(zip(ends, ends[1:])) + [(5 * 10**6, 5 * 10**6 + i) for i in range(1, 500)]
    stored = module.stored
    monkeypatch.setattr(module, "stored", lambda df, tag: (rounds.append(tag), stored(df.coalesce(2), tag))[1])
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert rounds.count("links-to") <= 25
    want = groups(pairs, {x for p in pairs for x in p})
    assert len(set(got.values())) == 4 and {(want[x], r) for x, r in got.items()} == {(want[r], r) for r in set(got.values())}


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, fp string")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    fp = {t: brute.simhash(t) for _, t in rows}
    least = {}
    for i, t in rows:
        if i is not None:
            least[fp[t]] = min(i, least.get(fp[t], i))
    comp = groups([(a, b) for a in fp.values() for b in fp.values() if (a ^ b).bit_count() <= 4], set(fp.values()))
    names = {}
    for f, r in comp.items():
        if f in least:
            names[r] = min(least[f], names.get(r, least[f]))
    assert got == sorted([(i, f"{fp[t]:016x}", names.get(comp[fp[t]])) for i, t in rows], key=str)


def test_awkward_rows(spark):
    t = "one two three four five six seven eight nine ten"
    check(spark, [(5, None), (3, ""), (9, " \n"), (1, "a b"), (2, "A B"), (4, t), (8, t.upper()), (8, t.upper()), (None, "only here without id"), (None, t), (7, "w " * 50_000), (6, "é É " * 9)])
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
