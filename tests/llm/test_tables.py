"""Quality rules, mixing and shards against plain Python, with the awkward rows."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from twinsieve.llm.mixing import mix
from twinsieve.llm.quality import quality_rules
from twinsieve.llm.shards import contiguous_shards

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, size int, shard string, kept int, _id string"
LONG = " ".join(f"w{i % 997}" for i in range(60_000))
TEXTS = [None, "", " \t\n", "one", "a b c d e a b c d e", "x y z\nx y z\n\n\nx y z", "été là \U0001f600 ***", LONG, "# $ % a" * 9, "\n".join(["same line here"] * 7 + ["other"]), "a a a a a a a a a a a a"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 0, "y") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, [None, "b", "a", "Z", "é"][i % 5]) for i, t in enumerate(TEXTS * 2)] + [(None, "null id words here", None)]
    return rows, frame(spark, rows)


def test_quality_counts(awkward):
    rows, df = awkward
    got = sorted((r.asDict() for r in quality_rules(df).collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert len(got) == len(rows)
    for (i, t, _), g in zip(rows, got):
        want = brute.quality(t)
        assert {k: g[k] for k in want} == want, (i, t and t[:40])
        assert not (g["base_failed"] and g["kept"])


def test_quality_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for g in quality_rules(docs).collect():
        want = brute.quality(texts[g.doc_id])
        assert {k: g[k] for k in want} == want


def test_shards(spark, awkward):
    rows, df = awkward
    for n in (1, 3, 16):
        got = {r.doc_id: (r["size"], r.text_crc32, r.shard, r.slot) for r in contiguous_shards(df, n).collect()}
        assert got == brute.shards([(i, t) for i, t, _ in rows], n)


def test_shards_of_repeated_rows_and_documents(spark):
    twice = frame(spark, [(7, "same text", "a")] * 40 + [(None, None, None)] * 10)
    got = contiguous_shards(twice, 5).collect()
    assert len(got) == 50
    for k in range(5):
        own = [r for r in got if r.shard == k]
        assert sorted(r.slot for r in own) == list(range(len(own)))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = Counter()
    for r in contiguous_shards(docs.repartition(7), 16).collect():
        sizes[r.shard] += r["size"]
    largest = docs.agg(F.max(F.octet_length("text"))).first()[0]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    assert contiguous_shards(twice.limit(0), 4).count() == 0


def test_targets_and_taken(spark, awkward):
    rows, df = awkward
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for data in (rows, [(r.doc_id, r.text, r.source) for r in docs.collect()]):
        sizes, taken, target = defaultdict(int), defaultdict(int), {}
        for _, t, s in data:
            sizes[s] += len(brute.words(t))
        want = brute.targets(dict(sizes))
        got = mix(frame(spark, data)).collect()
        assert len(got) == len(data)
        largest = defaultdict(int)
        for r in got:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
            assert r.taken == r["size"] * r.times and 0 <= r.times <= 3
            taken[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r["size"])
        for s in sizes:  # half of the largest run of equal hashes at most; equal rows share a hash
            assert abs(taken[s] - want[s]) <= 2 * largest[s]


def test_mix_is_stable_and_takes_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = sorted(map(tuple, mix(docs).collect()), key=str)
    assert a == sorted(map(tuple, mix(docs.repartition(5)).collect()), key=str)
    assert mix(docs.limit(0)).count() == 0
    assert quality_rules(docs.limit(0)).count() == 0


def test_mix_beyond_the_broadcast_limit(spark, monkeypatch):
    from twinsieve.llm import common, mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, mix(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "lookup", lambda r, t, k, s: common.lookup(r, t, k, s, limit=0))
    assert sorted(map(tuple, mix(docs).collect()), key=str) == want
