"""Two-stage routing: operating points, grid sweeps and their selection.

Input frames hold ``label``, ``p1`` (first stage, probability of safe) and ``s2`` (second stage,
suspicion). A row escalates when ``p1 < theta``; the rest pass as benign.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.functions.scores import check_thresholds, ratio
from twinsieve.operators.metrics import dr_at_fpr, thr_scan
from twinsieve.operators.ranks import BUCKET, bucket_holds, cut_points, holds, running, with_bucket


def _sum_if(cond: Column, weight: Column | None) -> Column:
    w = F.lit(1) if weight is None else weight
    return F.when(cond, w).otherwise(F.lit(0)).cast("long")


def budget_rank(benign_escalated: Column, benign: Column, fpr: float) -> Column:
    """Rank of the second threshold among escalated benign rows when all false positives come from them."""
    local = F.least(F.lit(1.0), F.try_divide(F.lit(fpr) * benign, benign_escalated.cast("double")))
    return F.ceil((benign_escalated - F.lit(1)) * (F.lit(1.0) - local))


def _result(keys: Sequence[str]) -> list[Column]:
    caught = F.coalesce(F.col("caught"), F.col("ea"))
    fp = F.coalesce(F.col("fp"), F.lit(0)).cast("long")
    local = F.least(F.lit(1.0), F.try_divide(F.col("budget"), F.col("eb").cast("double")))
    return [
        *keys, "theta", ratio(F.col("ea") + F.col("eb"), F.col("n")).alias("e"), ratio(caught, F.col("na")).alias("tpr"),
        ratio(fp, F.col("nb")).alias("fpr"), (F.col("na") - F.col("ea")).alias("passed"), caught.alias("caught"), fp.alias("fp"),
        "theta2", F.col("eb").alias("n_esc_benign"),
        F.coalesce(F.col("eb") >= F.floor(F.try_divide(F.lit(1.0), local)), F.lit(True)).alias("resolvable"),
    ]


def cascade_at(
    df: DataFrame, theta: float | Column, fpr: float = 0.01, keys: Sequence[str] = (),
    weight: Column | None = None, cuts: Sequence[float] | None = None, groups: int | None = None,
) -> DataFrame:
    """Operating point at one theta, per key group; row weights (whole counts) are optional."""
    th = F.lit(theta) if isinstance(theta, float) else theta
    esc, benign, attack = F.col("p1") < th, F.col("label") == 0, F.col("label") == 1
    sums = {
        "eb": _sum_if(esc & benign, weight), "ea": _sum_if(esc & attack, weight),
        "nb": _sum_if(benign, weight), "na": _sum_if(attack, weight),
    }
    run = running(df, "s2", sums, keys, lambda: bucket_holds("eb", budget_rank(F.col("eb_all"), F.col("nb_all"), fpr)), cuts, groups)
    hit = run.filter(holds("eb", budget_rank(F.col("eb_all"), F.col("nb_all"), fpr))).select(
        *keys, F.col("s2").alias("theta2"),
        (F.col("ea_all") - F.col("ea_below") - F.col("ea")).alias("caught"),
        (F.col("eb_all") - F.col("eb_below") - F.col("eb")).alias("fp"),
    )
    totals = df.groupBy(*keys).agg(
        F.max(th).alias("theta"), *[F.sum(c).alias(n) for n, c in sums.items()],
        F.sum(F.lit(1).cast("long") if weight is None else weight).alias("n"),
    ).withColumn("budget", F.lit(fpr) * F.col("nb"))
    joined = totals.join(hit, list(keys), "left") if keys else totals.join(F.broadcast(hit), F.lit(True), "left")
    return joined.select(*_result(keys))


def theta_grid(lo: float, hi: float, step: float) -> list[float]:
    return [round(lo + i * step, 10) for i in range(int(round((hi - lo) / step)) + 1)]


def frontier(df: DataFrame, grid: Sequence[float], fpr: float = 0.01, keys: Sequence[str] = ()) -> DataFrame:
    """Operating point at every theta of a grid, exact, from one count table and one narrow re-read.

    Rows are counted by (second-stage bucket, number of grid points at or below ``p1``). That table is
    bounded by buckets x grid; its running sums tell for every theta in which bucket the second
    threshold lies. Only rows of those buckets are read again and ranked.
    """
    keys = list(keys)
    grid = sorted(set(grid))
    size = len(grid)
    base = df.select(*keys, "label", "p1", "s2").filter(F.col("s2").isNotNull())
    cuts = cut_points(base, "s2")
    rows = with_bucket(with_bucket(base, "p1", grid).withColumnRenamed(BUCKET, "g"), "s2", cuts)
    eb, ea = (F.col("label") == 0).cast("long"), (F.col("label") == 1).cast("long")
    cells = rows.groupBy(*keys, BUCKET, "g").agg(F.sum(eb).alias("eb"), F.sum(ea).alias("ea"))
    slots = cells.select(*keys, BUCKET).distinct().withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    upto = Window.partitionBy(*keys, BUCKET).orderBy("g")
    dense = slots.join(cells, [*keys, BUCKET, "g"], "left").select(
        *keys, BUCKET, "g", *[F.sum(F.coalesce(c, F.lit(0))).over(upto).alias(f"{c}_in") for c in ("eb", "ea")]
    )
    per = Window.partitionBy(*keys, "g")
    dense = dense.select(
        *keys, BUCKET, "g", "eb_in",
        *[(F.sum(f"{c}_in").over(per.orderBy(BUCKET)) - F.col(f"{c}_in")).alias(f"{c}_off") for c in ("eb", "ea")],
        *[F.sum(f"{c}_in").over(per).alias(f"{c}_all") for c in ("eb", "ea")],
    )
    size_of = base.groupBy(*keys).agg(F.sum(eb).alias("nb"), F.sum(ea).alias("na"), F.count(F.lit(1)).alias("n"))
    dense = dense.join(size_of, keys) if keys else dense.join(F.broadcast(size_of))
    rank = budget_rank(F.col("eb_all"), F.col("nb"), fpr)
    hit = dense.filter(bucket_holds("eb", rank)).select(*keys, BUCKET, F.col("g").alias("_g"), "eb_off", "ea_off", "ea_all", "eb_all", rank.alias("_rank"))
    # Without keys there is at most one row per grid point.
    close = rows.join(hit if keys else F.broadcast(hit), [*keys, BUCKET]).filter(F.col("g") <= F.col("_g"))
    merged = close.groupBy(*keys, "_g", "s2").agg(
        F.sum(eb).alias("eb"), F.sum(ea).alias("ea"), *[F.max(c).alias(c) for c in ("eb_off", "ea_off", "ea_all", "eb_all", "_rank")]
    )
    inside = Window.partitionBy(*keys, "_g").orderBy("s2")
    run = merged.select(*keys, "_g", "s2", "eb", "ea", "ea_all", "eb_all", "_rank",
                        *[(F.col(f"{c}_off") + F.sum(c).over(inside) - F.col(c)).alias(f"{c}_below") for c in ("eb", "ea")])
    at = run.filter(holds("eb", F.col("_rank"))).select(
        *keys, F.col("_g").alias("g"), F.col("s2").alias("theta2"),
        (F.col("ea_all") - F.col("ea_below") - F.col("ea")).alias("caught"), (F.col("eb_all") - F.col("eb_below") - F.col("eb")).alias("fp"),
    )
    totals = dense.groupBy(*keys, "g").agg(*[F.max(a).alias(b) for a, b in (("eb_all", "eb"), ("ea_all", "ea"), ("nb", "nb"), ("na", "na"), ("n", "n"))])
    values = F.array(*[F.lit(float(x)) for x in grid])
    out = totals.withColumn("theta", F.element_at(values, F.col("g") + 1)).withColumn("budget", F.lit(fpr) * F.col("nb"))
    return out.join(at, [*keys, "g"], "left").select(*_result(keys))


def best_point(points: DataFrame, fpr: float = 0.01) -> DataFrame:
    """Grid point with the highest detection rate, then the least escalation, within the budget."""
    ok = points.filter(F.col("fpr") <= F.lit(fpr + 1e-9))
    best = F.max(F.struct(F.col("tpr"), (-F.col("e")).alias("ne"), (-F.col("theta")).alias("nt"))).alias("b")
    return ok.agg(best).select((-F.col("b.nt")).alias("theta"), F.col("b.tpr").alias("tpr"), (-F.col("b.ne")).alias("e"))


# The thresholds that a sweep visits when no grid is asked for.
DEFAULT_SWEEP = (1e-5, 3.16e-5, 1e-4, 3.16e-4, 1e-3, 3.16e-3, 5e-3, 1e-2, 3.16e-2, 1e-1, 3.16e-1, 1.0)


def sweep_grid(frozen: float, points: int | None = None) -> list[float]:
    """The default grid, or ``points`` log-spaced thresholds from 1e-6 to 1 of three digits; always with ``frozen``."""
    grid = DEFAULT_SWEEP if points is None else [float(f"{10 ** (-6 + 6 * i / (points - 1)):.3g}") for i in range(points)]
    return sorted({*grid, frozen})


def select_theta(cal: DataFrame, grid: Sequence[float], fpr: float = 0.01, keep: float = 0.99) -> float | None:
    """Cheapest theta on the calibration rows that keeps its share of the second stage's detection rate."""
    alone = dr_at_fpr(cal, "s2", (fpr,)).select(F.col("dr").alias("dr2"))
    pts = frontier(cal, grid, fpr).join(F.broadcast(alone))
    ok = pts.filter((F.col("fpr") <= F.lit(fpr + 1e-9)) & (F.col("tpr") >= F.lit(keep) * F.col("dr2") - F.lit(1e-9)))
    row = ok.agg(F.min(F.struct("e", "theta")).alias("b")).first()
    return None if row["b"] is None else float(row["b"]["theta"])


def route_counts(df: DataFrame, theta_safe: float, theta_unsafe: float, p: str = "p1") -> DataFrame:
    check_thresholds(theta_safe, theta_unsafe)
    passed, blocked = F.col(p) >= theta_safe, F.col(p) <= theta_unsafe
    return df.agg(
        F.sum((~passed & ~blocked).cast("long")).alias("escalated"),
        F.sum((passed & (F.col("label") == 1)).cast("long")).alias("passed_attacks"),
        F.sum((blocked & (F.col("label") == 0)).cast("long")).alias("blocked_benign"),
    )


def operating_points(df: DataFrame, safe_grid: Sequence[float], unsafe_grid: Sequence[float], p: str = "p1") -> DataFrame:
    """Routing counts at every valid pair of thresholds, from one pass over the rows.

    Each row is reduced to its place among all grid values, so the rest works on a bounded table:
    cumulative counts per grid value, then the pairs.
    """
    values = sorted(set(safe_grid) | set(unsafe_grid))
    at_or_above = with_bucket(df, p, values).withColumnRenamed(BUCKET, "lo")
    on_value = F.coalesce(F.array_contains(F.array(*[F.lit(float(x)) for x in values]), F.col(p)), F.lit(False))
    cells = at_or_above.groupBy("lo", on_value.alias("eq")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == 1).cast("long")).alias("na"), F.sum((F.col("label") == 0).cast("long")).alias("nb"))
    # lo = number of grid values <= p. p >= v_j  <=>  lo >= j + 1;  p <= v_j  <=>  lo <= j, or lo = j + 1 and p = v_j.
    points = cells.select(F.explode(F.sequence(F.lit(0), F.lit(len(values) - 1))).alias("j"), "*")
    above = F.col("lo") >= F.col("j") + 1
    below = (F.col("lo") <= F.col("j")) | ((F.col("lo") == F.col("j") + 1) & F.col("eq"))
    at = points.groupBy("j").agg(
        F.sum(F.when(above, F.col("n")).otherwise(0)).alias("n_pass"), F.sum(F.when(above, F.col("na")).otherwise(0)).alias("passed_attacks"),
        F.sum(F.when(below, F.col("n")).otherwise(0)).alias("n_block"), F.sum(F.when(below, F.col("nb")).otherwise(0)).alias("blocked_benign"),
        F.sum("n").alias("n"), F.sum("nb").alias("nb"))
    safe = [values.index(x) for x in safe_grid]
    pairs = [(i, values.index(u)) for i in safe for u in unsafe_grid if u < values[i]]
    tab = df.sparkSession.createDataFrame([(k, a, b, float(values[a]), float(values[b])) for k, (a, b) in enumerate(pairs)],
                                          "place int, js int, ju int, theta_safe double, theta_unsafe double")
    a = at.select(F.col("j").alias("js"), "n_pass", "passed_attacks", "n", "nb")
    b = at.select(F.col("j").alias("ju"), "n_block", "blocked_benign")
    out = F.broadcast(tab).join(a, "js").join(b, "ju")
    return out.select("place", "theta_safe", "theta_unsafe", (F.col("n") - F.col("n_pass") - F.col("n_block")).alias("escalated"),
                      "passed_attacks", "blocked_benign", ratio(F.col("n") - F.col("n_pass") - F.col("n_block"), F.col("n")).alias("e"),
                      ratio(F.col("blocked_benign"), F.col("nb")).alias("fpr"))


def choose_operating_point(points: DataFrame, fpr: float, zero_passed: bool = True) -> DataFrame:
    """Feasible pair with the least escalation (first in grid order on ties), or the nearest miss."""
    ok = (F.col("fpr") <= fpr) & ((F.col("passed_attacks") == 0) if zero_passed else F.lit(True))
    best = F.min(F.when(ok, F.struct("e", "place", "theta_safe", "theta_unsafe", "fpr", "passed_attacks", "blocked_benign"))).alias("b")
    return points.agg(
        best, F.min("passed_attacks").alias("min_passed"), F.min(F.when(F.col("passed_attacks") == 0, F.col("fpr"))).alias("min_fpr_zero_passed"),
    ).select(F.col("b").isNotNull().alias("feasible"), "b.theta_safe", "b.theta_unsafe", "b.e", "b.fpr", "b.passed_attacks", "b.blocked_benign",
             "min_passed", "min_fpr_zero_passed")


def by_channel(df: DataFrame, theta: float, fpr: float = 0.01, ties_flagged: bool = False) -> DataFrame:
    """Second stage alone and the cascade per injection channel at one theta."""
    pt = cascade_at(df, theta, fpr).select(F.col("theta2"), F.col("e"), F.col("tpr").alias("overall_tpr"))
    alone = dr_at_fpr(df, "s2", (fpr,)).select(F.col("threshold").alias("t_alone"))
    rows = df.filter("label = 1").join(F.broadcast(pt)).join(F.broadcast(alone))
    esc = F.col("p1") < theta
    over = F.col("s2") >= F.col("theta2") if ties_flagged else F.col("s2") > F.col("theta2")
    hit = esc & F.coalesce(over, F.lit(True))
    return rows.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("s2") > F.col("t_alone")).cast("int")).alias("stage2_dr"), F.avg(hit.cast("int")).alias("cascade_dr"),
        F.sum((~esc).cast("long")).alias("passed"), F.max("e").alias("e"), F.max("overall_tpr").alias("overall_tpr"))


def sweep_by_channel(df: DataFrame, points: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Recall per channel at every point of a sweep (inclusive flag rule).

    The attacks are reduced to counts by (channel, place of p1 among the thetas, place of s2 among the
    second thresholds); that table does not grow with the data.
    """
    # One row per grid point comes to the driver: thetas and second thresholds, nothing from the data.
    pts = sorted((float(r["theta"]), r["theta2"]) for r in points.select("theta", "theta2").collect())
    thetas, seconds = [p[0] for p in pts], sorted({float(p[1]) for p in pts if p[1] is not None})
    a = df.filter("label = 1").select("channel", "p1", "s2")
    a = with_bucket(with_bucket(a, "p1", thetas).withColumnRenamed(BUCKET, "i1"), "s2", seconds).withColumnRenamed(BUCKET, "i2")
    cells = a.groupBy("channel", "i1", "i2").agg(F.count(F.lit(1)).alias("c"))
    need = [(i, float(th), -1 if t2 is None else seconds.index(float(t2)) + 1) for i, (th, t2) in enumerate(pts)]
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(th).alias("theta"), F.lit(k).alias("k")) for i, th, k in need])
    x = cells.select("channel", "i1", "i2", "c", F.explode(wanted).alias("w"))
    hit = (F.col("i1") <= F.col("w.i")) & (F.col("i2") >= F.col("w.k")) & (F.col("w.k") >= 0)
    counts = x.groupBy(F.col("w.theta").alias("theta")).agg(*[
        ratio(F.sum(F.when(hit & (F.col("channel") == ch), F.col("c")).otherwise(0)), F.sum(F.when(F.col("channel") == ch, F.col("c")).otherwise(0))).alias(f"dr_{ch}")
        for ch in channels])
    return points.join(counts, "theta")


def overlap(df: DataFrame, fpr: float = 0.01) -> DataFrame:
    """Attacks with both stages' miss flags at matched thresholds; ``t1`` and ``t2`` are on every row."""
    t1 = thr_scan(df, "s1", fpr).select(F.col("threshold").alias("t1"))
    t2 = thr_scan(df, "s2", fpr).select(F.col("threshold").alias("t2"))
    rows = df.filter("label = 1").join(F.broadcast(t1)).join(F.broadcast(t2))
    return rows.withColumn("m1", (F.col("s1") < F.col("t1")).cast("long")).withColumn("m2", (F.col("s2") < F.col("t2")).cast("long"))


def overlap_table(miss: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Contingency of the two stages' misses and what follows from it."""
    m1, m2 = F.col("m1"), F.col("m2")
    c = miss.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(m1).alias("miss1"), F.sum(m2).alias("miss2"), F.sum(m1 * m2).alias("both_miss"))
    n, a, b, k = (F.col(x) for x in ("n", "miss1", "miss2", "both_miss"))
    p1, p2 = ratio(a, n), ratio(b, n)
    var = p1 * (F.lit(1.0) - p1) * p2 * (F.lit(1.0) - p2)  # rates, as products of counts would overflow
    return c.select(
        *keys, "n", (n - a - b + k).alias("both_flag"), (b - k).alias("s1_only"), (a - k).alias("s2_only"), "both_miss",
        (F.lit(1.0) - p1).alias("stage1_dr"), (F.lit(1.0) - p2).alias("stage2_dr"), ratio(k, n).alias("p_both_miss"),
        ratio(k, a).alias("p_s2_miss_given_s1_miss"), F.try_divide(ratio(k, a), p2).alias("lift"),
        F.try_divide(ratio(k, n), p1 * p2).alias("excess"),
        F.try_divide(ratio(k, n) - p1 * p2, F.sqrt(var)).alias("phi"),
        (F.lit(1.0) - ratio(k, n)).alias("union_dr"), ratio(a - k, a).alias("stage2_rescue"), ratio(b - k, b).alias("stage1_rescue"))
