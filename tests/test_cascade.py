import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from twinsieve.functions import money
from twinsieve.functions.scores import int_label, route
from twinsieve.operators import bootstrap as b
from twinsieve.operators import calibrate as cal
from twinsieve.operators import cascade as k
from twinsieve.operators import cellboot
from twinsieve.operators import cost as c
from twinsieve.operators import reports as rep


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    y = (rng.random(1500) < 0.25).astype(int)
    p1 = np.round(np.clip(rng.random(1500) - 0.3 * y + 0.1, 0, 1), 3)
    s2 = np.round(rng.random(1500) * 0.7 + 0.3 * y, 3)
    df = spark.createDataFrame([(i, int(a), float(p), float(s)) for i, (a, p, s) in enumerate(zip(y, p1, s2))], "row_id bigint, label bigint, p1 double, s2 double")
    return df, y, p1, s2


def naive_point(y, p1, s2, theta, f=0.01):
    esc = p1 < theta
    nb = (y == 0).sum()
    eb = np.sort(s2[esc & (y == 0)])
    ea = s2[esc & (y == 1)]
    if len(eb) == 0:
        return esc.mean(), len(ea), 0, None
    local = min(1.0, f * nb / len(eb))
    t = eb[int(np.ceil((len(eb) - 1) * (1.0 - local)))]
    return esc.mean(), (ea > t).sum(), (eb > t).sum(), t


def test_frontier_equals_one_point_at_a_time(rows):
    df, y, p1, s2 = rows
    grid = k.theta_grid(0.0, 1.0, 0.05)
    for r in k.frontier(df, grid).collect():
        e, caught, fp, t = naive_point(y, p1, s2, r.theta)
        assert (r.e, r.caught, r.fp, r.theta2) == (pytest.approx(e), caught, fp, t)


def test_point_equals_frontier(rows):
    df, y, p1, s2 = rows
    r = k.cascade_at(df, 0.6).first()
    e, caught, fp, t = naive_point(y, p1, s2, 0.6)
    assert (r.caught, r.fp, r.theta2) == (caught, fp, t)


def test_routing_boundaries(spark):
    got = spark.createDataFrame([(0.9,), (0.7,), (0.5,), (0.2,), (0.1,)], "p double").select(route(F.col("p"), 0.7, 0.2).alias("d")).collect()
    assert [r.d for r in got] == ["pass", "pass", "escalate", "block", "block"]
    for bad in ((0.2, 0.7), (0.5, 0.5), (1.1, 0.2), (0.7, -0.1)):
        with pytest.raises(ValueError):
            route(F.lit(0.5), *bad)


def test_operating_points_equal_scalar_routing(rows):
    df, y, p1, _ = rows
    safe, unsafe = [0.5, 0.7, 0.9], [0.1, 0.3, 0.5]
    got = {(r.theta_safe, r.theta_unsafe): r for r in k.operating_points(df, safe, unsafe).collect()}
    assert len(got) == 8
    for (ts, tu), r in got.items():
        assert r.escalated == ((p1 < ts) & (p1 > tu)).sum()
        assert r.passed_attacks == ((p1 >= ts) & (y == 1)).sum()
        assert r.blocked_benign == ((p1 <= tu) & (y == 0)).sum()


def test_infeasible_operating_point_reports_the_nearest_miss(rows):
    df, *_ = rows
    r = k.choose_operating_point(k.operating_points(df, [0.5], [0.1]), 0.0).first()
    assert r.feasible is False and r.theta_safe is None and r.min_passed > 0


def test_labels(spark):
    ok = spark.createDataFrame([("safe",), ("benign",), ("0",), ("unsafe",), ("injected",), ("1",)], "l string")
    assert [r.x for r in ok.select(int_label(F.col("l")).alias("x")).collect()] == [0, 0, 0, 1, 1, 1]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("maybe",)], "l string").select(int_label(F.col("l"))).collect()


def test_temperature_recovers_sharpening(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(0, 1.5, 4000)
    y = (rng.random(4000) > 1 / (1 + np.exp(-z))).astype(int)
    df = spark.createDataFrame([(float(3 * a), int(b_)) for a, b_ in zip(z, y)], "z double, label bigint")
    t = cal.fit_temperature(df)
    assert 2.5 < t < 3.6
    loss = {round(r["T"], 6): r["nll"] for r in cal.nll(df, [1.0, t, t * 1.02, t / 1.02]).collect()}
    assert loss[round(t, 6)] == min(loss.values()) and loss[round(t, 6)] < loss[1.0]


def pav(p, y):
    order = np.argsort(p)
    blocks = []
    for i in order:
        blocks.append([float(y[i]), 1, [i]])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v, w, ix = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [(a[0] * a[1] + v * w) / (a[1] + w), a[1] + w, a[2] + ix]
    out = np.empty(len(p))
    for v, _, ix in blocks:
        out[ix] = v
    return out


def test_isotonic_matches_pooling(spark):
    rng = np.random.default_rng(8)
    p = rng.permutation(np.arange(300) / 300.0)
    y = (rng.random(300) > p).astype(int)
    df = spark.createDataFrame([(float(a), int(b_)) for a, b_ in zip(p, y)], "p1 double, label bigint")
    got = {r.p1: r.p_iso for r in cal.apply_isotonic(df, cal.isotonic(df)).collect()}
    want = pav(p, 1 - y)
    assert [got[float(a)] for a in p] == pytest.approx(list(want))


def test_bootstrap_is_repeatable_and_covers_the_point(rows):
    df, *_ = rows
    point = k.cascade_at(df, 0.6).first().tpr
    one, two = b.gap(df, "row_id", 0.6, n=30).first(), b.gap(df.repartition(7), "row_id", 0.6, n=30).first()
    assert one == two and one.cascade_tpr_lo <= point <= one.cascade_tpr_hi


def test_bootstrap_of_small_groups_and_distinct_draws(spark):
    one = spark.createDataFrame([(i, f"g{i}", 1.0) for i in range(6)] + [(i + 2**31 - 1, "far", float(i)) for i in range(6)], "id bigint, g string, v double")
    got = {r.g: r for r in b.paired(one, "id", "v", 200, 0, ["g"]).collect()}
    assert len(got) == 7 and all((got[f"g{i}"].lo, got[f"g{i}"].hi) == (1.0, 1.0) for i in range(6))
    # ids a modulus apart draw differently
    sums = {k: [r["s"] for r in b.replicate_sums(one.filter(F.col("id") == k), "id", 40, 0, {"s": F.lit(1)}).orderBy("rep").collect()] for k in (1, 2**31)}
    assert len(sums[1]) == 40 and sums[1] != sums[2**31]


def test_bootstrap_rates_equal_plain_replicates(rows):
    df, y, p1, s2 = rows
    w = {}
    for r in b.dealt(df, "row_id").withColumn("_g", F.lit(0)).withColumn("_d", b.draws_of(0, F.col("_g"), F.col("row_id"))).select("row_id", *[b.poisson1("_d", F.lit(j)).alias(f"w{j}") for j in range(4)]).collect():
        w[r.row_id] = r
    for r in b.replicate_rates(df, "row_id", 0.6, n=4).collect():
        c = np.array([w[i][f"w{r.rep}"] for i in range(len(y))])
        yy, pp, ss = np.repeat(y, c), np.repeat(p1, c), np.repeat(s2, c)
        _, caught, _, _ = naive_point(yy, pp, ss, 0.6)
        benign = np.sort(ss[yy == 0])
        alone = (ss[yy == 1] > benign[int(np.ceil((len(benign) - 1) * 0.99))]).mean()
        assert r.cascade_tpr == pytest.approx(caught / (yy == 1).sum()) and r.stage2_dr == pytest.approx(alone)


def test_isotonic_between_and_outside_blocks(spark):
    fit = spark.createDataFrame([(0.2, 1), (0.4, 1), (0.6, 0), (0.8, 0)], "p1 double, label bigint")
    at = spark.createDataFrame([(0.0,), (0.3,), (0.5,), (0.7,), (1.0,), (None,)], "p1 double")
    got = {r.p1: r.p_iso for r in cal.apply_isotonic(at, cal.isotonic(fit)).collect()}
    assert got == {0.0: 0.0, 0.3: 0.0, 0.5: pytest.approx(0.5), 0.7: 1.0, 1.0: 1.0, None: None}


def test_detector_document(spark):
    rows = [(0, None, 0, None, None), (1, "tool", 1, None, None), (1, "direct", 0, None, None), (0, None, 1, None, None)]
    df = spark.createDataFrame(rows, "label bigint, channel string, pred bigint, score double, ms double")
    got = {r.group: r for r in rep.evaluate_detector(df, "no such detector").collect()}
    assert set(got) == {"overall", "tool", "direct"} and got["overall"].note.startswith("binary") and got["overall"].dr_01 is None
    assert (got["overall"].n, got["overall"].n_benign, got["overall"].fpr_benign_only, got["overall"].usd_per_1m) == (4, 2, 0.5, None)
    scored = rep.evaluate_detector(df.withColumn("score", F.col("pred").cast("double")), "llama3.2-1b").filter("group = 'overall'").first()
    assert scored.note is None and scored.dr_01 == 0.0 and scored.vram_gb > 0
    with pytest.raises(PySparkException, match="no prediction rows"):
        rep.evaluate_detector(df.limit(0), "x").collect()


def test_rows_without_a_token_count_stay(spark):
    seg = c.pinned(c.segments(spark.createDataFrame([("a", 64, 1.0), ("a", 128, 2.0)], "model string, actual_tokens bigint, median_ms double")))
    df = spark.createDataFrame([(1, 96), (2, None)], "i bigint, n bigint")
    assert {r.i: r.k for r in c.interp(df, "n", seg, "a", "k").collect()} == {1: 1.5, 2: None}
    with pytest.raises(ValueError, match="no model"):
        c.interp(df, "n", seg, "b", "k")


def test_cost_known_answers(spark):
    one = spark.createDataFrame([(2.0, 100.0, 0.2)], "k1_ms double, k2_ms double, e double")
    r = c.cascade_cost(one).first()
    assert r.expected_ms == pytest.approx(22.0) and r.reduction == pytest.approx(0.78) and r.break_even_e == pytest.approx(0.98) and r.cheaper
    x = spark.range(1).select(money.usd_per_million(F.lit(100.0)).alias("u"), money.vram_gb(F.lit(7_240_000_000), F.lit(2.0)).alias("v")).first()
    assert x.u == pytest.approx(33.333333) and x.v == pytest.approx(17.376)
    with pytest.raises(PySparkException):
        one.select(money.expected_ms(F.lit(-1.0), F.lit(1.0), F.lit(0.5))).collect()
    with pytest.raises(PySparkException):
        one.select(money.expected_ms(F.lit(1.0), F.lit(1.0), F.lit(1.5))).collect()


def test_interpolation_is_flat_outside_and_averages_equal_anchors(spark):
    curve = spark.createDataFrame([("m", 86, 10.0), ("m", 86, 14.0), ("m", 186, 32.0)], "model string, actual_tokens bigint, median_ms double")
    df = spark.createDataFrame([(10,), (86,), (136,), (186,), (999,)], "n bigint")
    got = {r.n: r.ms for r in c.interp(df, "n", c.pinned(c.segments(curve)), "m", "ms").collect()}
    assert got == pytest.approx({10: 12.0, 86: 12.0, 136: 22.0, 186: 32.0, 999: 32.0})


def test_pinned_never_cuts(spark):
    with pytest.raises(ValueError):
        c.pinned(spark.range(20), limit=10)


@pytest.mark.parametrize(("cells", "values"), [(1024, 200_000), (16, 200_000), (4, 20)])
def test_cell_draws_have_the_distribution_of_row_weights(rows, cells, values):
    df, y, p1, s2 = rows
    got = cellboot.replicate_rates(df, 0.7, n=1000, seed=5, cells=cells, values=values)
    rng, want = np.random.default_rng(6), ([], [])
    esc = p1 < 0.7
    order = np.sort(np.unique(s2))
    for _ in range(1000):
        w = rng.poisson(1.0, len(y))
        nb, neb, na = w[y == 0].sum(), w[(y == 0) & esc].sum(), w[y == 1].sum()
        for out, rows_, rank in ((want[0], esc, np.ceil((neb - 1) * (1.0 - min(1.0, 0.01 * nb / neb)))), (want[1], np.ones(len(y), bool), np.ceil((nb - 1) * 0.99))):
            below = np.bincount(np.searchsorted(order, s2), np.where((y == 0) & rows_, w, 0), len(order)).cumsum()
            out.append(w[(y == 1) & rows_ & (s2 > order[(below <= rank).sum()])].sum() / na)
    for mine, theirs in zip(got, map(np.array, want)):
        se = theirs.std() / np.sqrt(1000)
        assert abs(mine.mean() - theirs.mean()) < 6 * se and 0.85 < mine.std() / theirs.std() < 1.18
        for q in (0.025, 0.25, 0.5, 0.75, 0.975):
            share = (theirs <= np.quantile(mine, q)).mean()
            assert abs(share - q) < 0.06, (cells, q, share)
    assert abs(np.corrcoef(*got)[0, 1] - np.corrcoef(*want)[0, 1]) < 0.1  # both rates come from one draw


def test_cell_draws_at_the_edges(spark):
    schema = "label long, p1 double, s2 double"
    assert all(np.isnan(x).all() for x in cellboot.replicate_rates(spark.createDataFrame([], schema), 0.7, n=20))
    ties = spark.createDataFrame([(0, 0.1, 0.5)] * 300 + [(1, 0.1, 0.5)] * 50 + [(1, None, 0.9)] * 50 + [(1, 0.1, None)], schema)
    cascade, alone = cellboot.replicate_rates(ties, 0.7, n=200, cells=4, values=1)
    assert (cascade == 0).all() and 0.35 < alone.mean() < 0.65
    no_benign = spark.createDataFrame([(1, 0.1, 0.5)] * 40 + [(1, 0.9, 0.6)] * 40, schema)
    cascade, alone = cellboot.replicate_rates(no_benign, 0.7, n=200)
    assert 0.35 < cascade.mean() < 0.65 and np.isnan(alone).all()
    again = cellboot.replicate_rates(ties.repartition(5), 0.7, n=200, cells=4, values=1)
    assert (again[0] == 0).all() and (again[1] == cellboot.replicate_rates(ties, 0.7, n=200, cells=4, values=1)[1]).all()
    row = cellboot.gap(ties, 0.7, n=100).first()
    assert row.n_boot == 100 and row.verdict == "worse"
