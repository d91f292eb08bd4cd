"""Temperature and isotonic calibration of the first stage's logit gap."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.functions.scores import injection_nll, sigmoid
from twinsieve.operators.ranks import BUCKET, cut_points, running, with_bucket
from twinsieve.sources.readers import stored


def nll(df: DataFrame, temperatures: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Mean loss at several temperatures in one pass: one row per (keys, T).

    The temperatures are data, not part of the generated code, so that every round of a search runs
    the same compiled plan.
    """
    grid = F.array(*[F.lit(float(t)) for t in temperatures])
    rows = df.select(*keys, "z", "label", F.explode(grid).alias("T"))
    return rows.groupBy(*keys, "T").agg(F.avg(injection_nll(F.col("z"), F.col("label"), F.col("T"))).alias("nll"))


def fit_temperatures(df: DataFrame, keys: Sequence[str] = (), bounds: tuple[float, float] = (1e-2, 1e2), rounds: int = 40, tol: float = 1e-9) -> dict[tuple, float]:
    """Temperature with the least loss for every key group, all at once.

    The loss is convex in b = 1 / T. A pass sums its first and second derivative over the rows; a Newton step that
    leaves the bracket is replaced by its middle. About eight passes, of one row per row.
    """
    own = {tuple(r): [1.0 / bounds[1], 1.0 / bounds[0], 1.0] for r in df.select(*keys).distinct().collect()} if keys else {(): [1.0 / bounds[1], 1.0 / bounds[0], 1.0]}
    fits: dict[tuple, float] = {}
    for _ in range(rounds):
        todo = {k: v for k, v in own.items() if k not in fits}
        if not todo:
            break
        # current slopes as literals: as many as there are key groups
        b = F.lit(1.0)
        for k, (_, _, at) in todo.items():
            same = F.lit(True)
            for name, value in zip(keys, k):
                same = same & F.col(name).eqNullSafe(F.lit(value))
            b = F.when(same, F.lit(at)).otherwise(b)
        z = F.col("z")
        s = sigmoid(-b * z)
        sums = df.groupBy(*keys).agg(F.avg(z * (F.col("label") - s)).alias("d1"), F.avg(z * z * s * (1.0 - s)).alias("d2")).collect()
        for r in sums:
            k = tuple(r[:-2])
            if k not in todo or r.d1 is None:
                fits.setdefault(k, 1.0)
                continue
            lo, hi, at = own[k]
            lo, hi = (at, hi) if r.d1 < 0 else (lo, at)
            step = at - r.d1 / r.d2 if r.d2 > 0 else math.inf
            new = step if lo < step < hi else math.sqrt(lo * hi)
            own[k] = [lo, hi, new]
            if abs(new - at) <= tol * at:
                fits[k] = 1.0 / new
    return {k: fits.get(k, 1.0 / v[2]) for k, v in own.items()}


def fit_temperature(df: DataFrame, bounds: tuple[float, float] = (1e-2, 1e2)) -> float:
    return fit_temperatures(df, (), bounds)[()]


def temperature_report(df: DataFrame, t: float, eps: float = 1e-3) -> DataFrame:
    """Loss, curvature by second difference and row count at a fitted temperature."""
    z, y = F.col("z"), F.col("label")
    at = {n: F.avg(injection_nll(z, y, x)) for n, x in (("m", t - eps), ("c", t), ("p", t + eps))}
    agg = df.agg(*[c.alias(n) for n, c in at.items()], F.count(F.lit(1)).alias("n_fit"))
    curve = (F.col("p") - 2.0 * F.col("c") + F.col("m")) / F.lit(eps * eps)
    return agg.select(F.lit(float(t)).alias("T"), F.col("c").alias("nll"), curve.alias("curvature"), "n_fit")


def apply_temperature(df: DataFrame, t: float) -> DataFrame:
    """Both log-probabilities divided by T, and the calibrated probability; the schema is kept."""
    return df.withColumns({"logp_benign": F.col("logp_benign") / t, "logp_injection": F.col("logp_injection") / t}).withColumn(
        "p_safe", sigmoid(F.col("logp_benign") - F.col("logp_injection")))


def _hull(points: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Lower convex hull of points (weight, sum, p) in order of weight; whole numbers, so exact."""
    out: list[tuple[int, int, float]] = []
    for w, s, p in points:
        while len(out) > 1 and (out[-1][1] - out[-2][1]) * (w - out[-2][0]) >= (s - out[-2][1]) * (out[-1][0] - out[-2][0]):
            out.pop()
        out.append((w, s, p))
    return out


def _hull_of_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("w")
    kept = _hull(list(zip(pdf["w"].tolist(), pdf["s"].tolist(), pdf["p"].tolist())))
    return pd.DataFrame(kept, columns=["w", "s", "p"]).assign(g=pdf["g"].iloc[0])


FAN = 16  # hulls joined at a time


def isotonic(df: DataFrame, p: str = "p1") -> DataFrame:
    """Fit ``P(safe)`` as a non-decreasing function of ``p``: pooled blocks ``lo, hi, value``.

    The fit is the slope of the lower convex hull of the running (count, safe) sums over the scores. A hull of
    hulls is the hull of all, so buckets of scores are reduced first, then ``FAN`` of them at a time; what meets in a
    task is the hulls' corners, of which there are at most about the 2/3 power of the rows. Nothing but the
    number of buckets reaches the driver.
    """
    cuts = cut_points(df, p)
    sums = running(df, p, {"s": 1 - F.col("label").cast("long"), "w": F.lit(1).cast("long")}, cuts=cuts)
    points = stored(sums.select(F.col(p).cast("double").alias("p"), (F.col("w_below") + F.col("w")).alias("w"), (F.col("s_below") + F.col("s")).alias("s"), "w_below"), "isotonic")
    hulls = with_bucket(points, "p", cuts).select(F.col(BUCKET).cast("long").alias("g"), "w", "s", "p")
    start = df.sparkSession.createDataFrame([(0, 0, 0, float("-inf"))], "g long, w long, s long, p double")
    hulls, groups = hulls.unionByName(start), len(cuts) + 1
    while True:
        hulls = stored(hulls.groupBy("g").applyInPandas(_hull_of_group, "w long, s long, p double, g long"), "hulls")
        if groups == 1:
            break
        groups = -(-groups // FAN)
        hulls = hulls.withColumn("g", F.floor(F.col("g") / FAN).cast("long"))
    corner = Window.partitionBy("g").orderBy("w")  # the corners of the fit: its own size
    blocks = hulls.select("w", "s", "p", F.lag("w").over(corner).alias("w0"), F.lag("s").over(corner).alias("s0")).filter("w0 is not null")
    lows = points.select(F.col("w_below").alias("w0"), F.col("p").alias("lo"))
    return stored(blocks.join(lows, "w0").select("lo", F.col("p").alias("hi"), ((F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))).alias("value")), "isotonic-blocks")


def apply_isotonic(df: DataFrame, blocks: DataFrame, p: str = "p1") -> DataFrame:
    """Adds ``p_iso``: a block's value inside it, a straight line between blocks, the end values outside.

    The last piece that starts at or below a score is found by a running last value inside buckets of scores; what
    a bucket inherits from those before it is one piece. A NULL score stays NULL.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("lo")  # one row per block
    ends = blocks.select("*", F.lead("lo").over(order).alias("_lo1"), F.lead("value").over(order).alias("_v1"), F.row_number().over(order).alias("_n"))
    slope = F.coalesce((F.col("_v1") - F.col("value")) / (F.col("_lo1") - F.col("hi")), F.lit(0.0))
    flat = F.struct(F.when(F.col("_n") == 1, F.lit(float("-inf"))).otherwise(F.col("lo")).alias("x"), F.col("lo").alias("x0"), F.col("value").alias("y0"), F.lit(0.0).alias("k"))
    # nudged past ``hi`` by starting at it: at hi itself line and block agree
    line = F.struct(F.col("hi").alias("x"), F.col("hi").alias("x0"), F.col("value").alias("y0"), slope.alias("k"))
    pieces = ends.select(F.explode(F.array(flat, line)).alias("q")).select("q.*")
    cuts = cut_points(df, p)
    pieces = with_bucket(pieces, "x", cuts).groupBy(BUCKET, "x").agg(F.max(F.struct("k", "x0", "y0")).alias("q"))
    rows = with_bucket(df.withColumn("_x", F.col(p).cast("double")).filter(F.col(p).isNotNull()), "_x", cuts)
    inherited = Window.partitionBy(F.lit(0)).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    known = df.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias(BUCKET)).join(
        pieces.groupBy(BUCKET).agg(F.max_by("q", "x").alias("q")), BUCKET, "left").select(BUCKET, F.last("q", True).over(inherited).alias("_before"))
    at = Window.partitionBy(BUCKET).orderBy("_x", "_is_row").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumns({"_is_row": F.lit(1), "_q": F.lit(None).cast(pieces.schema["q"].dataType)}).unionByName(
        pieces.select(BUCKET, F.col("x").alias("_x"), F.lit(0).alias("_is_row"), F.col("q").alias("_q")), allowMissingColumns=True)
    both = both.withColumn("_q", F.last("_q", True).over(at)).filter("_is_row = 1").join(F.broadcast(known), BUCKET)  # one row per bucket
    q = F.coalesce("_q", "_before")
    value = q["y0"] + F.when(q["k"] == 0.0, 0.0).otherwise(q["k"] * (F.col("_x") - q["x0"]))
    out = both.withColumn("p_iso", value).select(*df.columns, "p_iso")
    return out.unionByName(df.filter(F.col(p).isNull()).withColumn("p_iso", F.lit(None).cast("double")))
