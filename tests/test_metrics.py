import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsieve.operators import metrics as m
from twinsieve.operators.ranks import number_by_value, quantiles


def frame(spark, rows, schema="label bigint, s double"):
    return spark.createDataFrame(rows, schema)


def test_confusion_known_answer(spark):
    rows = [(1, 1)] * 3 + [(0, 1)] + [(1, 0)] + [(0, 0)] * 2
    r = m.confusion(frame(spark, rows, "label bigint, pred int"), "pred").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (3, 1, 1, 2)
    assert r.precision == r.recall == r.f1 == 0.75
    assert r.fpr == pytest.approx(1 / 3) and r.accuracy == pytest.approx(5 / 7)


def test_confusion_undefined_is_null(spark):
    r = m.confusion(frame(spark, [(0, 0), (0, 0)], "label bigint, pred int"), "pred").first()
    assert r.precision is None and r.recall is None and r.f1 is None and r.fpr == 0.0


@pytest.mark.parametrize("rows,want", [([(0, 0.5), (1, 0.5)], 0.0), ([(1, 0.5), (1, 0.5)], 0.5), ([(0, 1.0), (0, 1.0)], 1.0), ([], None)])
def test_ece_known_answers(spark, rows, want):
    assert m.ece(frame(spark, rows), "s").first()["ece"] == (want if want is None else pytest.approx(want))


def naive_dr(y, s, t):
    b, a = np.sort(s[y == 0]), s[y == 1]
    thr = b[math.ceil((len(b) - 1) * (1.0 - t))]
    return thr, (a > thr).mean(), (b > thr).mean()


def test_dr_at_fpr_matches_naive_with_heavy_ties(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(3000) < 0.3).astype(int)
    s = np.where(rng.random(3000) < 0.35, 0.25, np.round(rng.random(3000) + 0.3 * y, 3))  # one score holds a third of the rows
    got = {r.fpr_target: r for r in m.dr_at_fpr(frame(spark, list(zip(y.tolist(), s.tolist()))), "s").collect()}
    for t in m.FPR_TARGETS:
        thr, dr, fpr = naive_dr(y, s, t)
        assert got[t].threshold == thr and got[t].dr == pytest.approx(dr) and got[t].achieved_fpr == pytest.approx(fpr)
        assert got[t].achieved_fpr <= t
    assert got[0.001].threshold >= got[0.005].threshold >= got[0.01].threshold


def test_dr_at_fpr_drops_missing_scores_and_keeps_empty_classes(spark):
    r = m.dr_at_fpr(frame(spark, [(1, 0.9), (1, None), (1, 0.1)]), "s", (0.01,)).first()
    assert r.threshold is None and r.dr is None and r.n_injection == 2 and r.resolvable is False
    r = m.dr_at_fpr(frame(spark, [(0, 0.9), (0, None), (0, 0.1)]), "s", (0.01,)).first()
    assert r.threshold == 0.9 and r.dr is None and r.achieved_fpr == 0.0 and r.n_benign == 2


def test_auroc_ties_and_missing_class(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(2), rng.randrange(20) / 10) for _ in range(500)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert m.auroc(frame(spark, rows), "s").first()["auroc"] == pytest.approx(want)
    assert m.auroc(frame(spark, [(1, 0.2), (1, 0.3)]), "s").first()["auroc"] is None


def test_thr_scan_matches_naive(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), rng.randrange(200) / 100) for _ in range(800)]
    ben = [s for y, s in rows if not y]
    want = min(t for t in set(ben) if sum(b >= t for b in ben) / len(ben) <= 0.05)
    assert m.thr_scan(frame(spark, rows), "s", 0.05).first()["threshold"] == want


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.exponential(size=1001), 2)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(x)], "k int, v double")
    for r in quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.99}, ["k"]).collect():
        part = x[np.arange(1001) % 2 == r.k]
        assert [r.a, r.b, r.c] == pytest.approx(list(np.quantile(part, [0.1, 0.5, 0.99])))


def test_number_rows_is_a_total_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("v"), (F.col("id") % 3 == 0).cast("int").alias("k"))
    rows = number_by_value(df, "v", keys=["k"], name="rn").collect()
    for k in (0, 1):
        part = sorted((r.v, r.rn) for r in rows if r.k == k)
        assert [rn for _, rn in part] == list(range(1, len(part) + 1))


def test_spearman_matches_average_ranks(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 30, 400), rng.integers(0, 10, 400)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "x int, y int")

    def rank(v):
        return np.array([(v < w).sum() + ((v == w).sum() + 1) / 2 for w in v])

    assert m.spearman(df, "x", "y").first()["spearman"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])


def test_null_channel_counts_only_in_overall(spark):
    df = spark.createDataFrame([(0, None), (1, "tool"), (1, "direct")], "label bigint, channel string")
    got = {r["group"]: r["count"] for r in m.by_channel_and_overall(df).groupBy("group").count().collect()}
    assert got == {"overall": 3, "tool": 1, "direct": 1}
