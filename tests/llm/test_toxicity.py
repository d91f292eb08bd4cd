"""Toxicity by compression: held-out accuracy, what may be learned from, and awkward texts."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from twinsieve.llm.toxicity import Scorer, fit_model, fit_toxicity, score_toxicity, windows_of

DOCS, LABELS = "doc_id long, text string, toxic int, score string, _id int, held_out string", "doc_id long, quality int, toxic int, text string"


def invented(seed, n):
    """Texts of syllables; every third text is toxic and has words of its own, one in thirty."""
    rnd = random.Random(seed)
    syllables = ["ba", "do", "ne", "ri", "tu", "ka", "lo", "mi", "sha", "ver", "ion", "est"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4)))
    bad = ["grumpf", "zwockel", "pfuiteufel"]
    out = []
    for i in range(n):
        ws = [word() for _ in range(rnd.randint(40, 400))]
        if i % 3 == 0:
            for at in rnd.sample(range(len(ws)), 2 + len(ws) // 30):
                ws[at] = rnd.choice(bad)
        out.append((i, " ".join(ws), int(i % 3 == 0)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = invented(1, 900)
    docs = spark.createDataFrame([(i, t, 7, "x", 1, "y") for i, t, _ in rows], DOCS).repartition(4)
    labels = spark.createDataFrame([(i, 1, toxic, "z") for i, _, toxic in rows], LABELS)
    return rows, docs, labels, fit_toxicity(docs, labels)


def test_held_out_accuracy(tables):
    rows, docs, _, model = tables
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    assert len(got) == len(rows)
    held = [(i, toxic) for i, _, toxic in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    right = sum(got[i].predicted == toxic for i, toxic in held)
    assert right >= 0.95 * len(held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs, fit_toxicity(docs, labels)).join(labels, "doc_id").filter("held_out")
    by = {r.toxic: r.p for r in scored.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert by[1] > 0.4 and by[0] < 0.05


def test_held_out_labels_are_not_used(tables):
    _, docs, labels, model = tables
    turned = labels.withColumn("toxic", F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert fit_toxicity(docs.repartition(7), turned.repartition(3)) == model


def test_sample_is_bounded(tables):
    _, docs, labels, model = tables
    small = fit_toxicity(docs, labels, sample_toxic=60, sample_ordinary=80)
    assert small != model and len(small.ordinary) == len(small.toxic)
    assert fit_toxicity(docs, labels, sample_bytes=0).prior == 0.0  # no text is short enough


def test_whole_texts_count(tables):
    rows, *_, model = tables
    scorer = Scorer(model)
    clean = " ".join(t for _, t, toxic in rows if not toxic)[:400_000]
    bad = " grumpf zwockel pfuiteufel" * 8
    assert scorer.score(clean)[0] < 0.5 < scorer.score(clean + bad)[0]
    assert len(windows_of(clean)) > 1000 and scorer.score("x" * 300_000)[1] > 100


def test_awkward_texts(spark, tables):
    model = tables[3]
    texts = [None, "", " \t\n", "grumpf", "\U0001f600 \x00 é", "x" * 100_000, "word " * 50_000, "same", "same"]
    df = spark.createDataFrame([(i if i % 4 else None, t, 7, "x", 1, "y") for i, t in enumerate(texts)] + [(3, "grumpf", 7, "x", 1, "y")], DOCS)
    rows = score_toxicity(df, model).collect()
    assert len(rows) == len(texts) + 1 and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {True}
    same = [r.score for r in rows if r.doc_id == 7 or r.doc_id is None and r.n_windows == 1]
    assert rows[1].score == rows[2].score == rows[0].score and rows[7].score == rows[8].score and len(same) >= 2
    assert score_toxicity(df.limit(0), model).count() == 0


def test_missing_classes(spark, tables):
    _, docs, labels, _ = tables
    assert fit_toxicity(docs, labels.limit(0)).prior == 0.0
    assert fit_toxicity(docs.limit(0), labels).prior == 0.0
    assert fit_toxicity(docs, labels.filter("toxic = 1")).prior == 1.0
    odd = labels.withColumn("toxic", F.when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise(F.lit(0)))
    assert {r.score for r in score_toxicity(docs, fit_toxicity(docs, odd)).collect()} == {0.0}
    few = fit_model(["bad bad text here", "bad words again"], ["good text", "fine text", "more text"], 0.3)
    assert 0 <= Scorer(few).score("bad")[0] <= 1
