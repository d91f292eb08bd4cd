"""Cost accounting on latency curves and timed requests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.functions import money
from twinsieve.functions.scores import ratio
from twinsieve.operators.metrics import class_sums
from twinsieve.operators.ranks import quantiles, running

MAX_CURVE_ROWS = 10_000


def pinned(df: DataFrame, limit: int = MAX_CURVE_ROWS) -> DataFrame:
    """A small table read once and kept as literals; more rows than the limit are an error, never cut off."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"table has more than {limit} rows and cannot be pinned")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.sparkSession.createDataFrame([tuple(r) for r in rows], schema)


def with_profile(df: DataFrame, detector: str, tokens: int = 512) -> DataFrame:
    """Static hardware figures by detector name; NULL when the name is not known."""
    known = df.sparkSession.createDataFrame(money.PROFILES, f"{detector} string, param_count bigint, load_dtype string, _bytes double")
    out = df.join(F.broadcast(known), detector, "left")  # as many rows as the profile list
    return out.withColumns({
        "vram_gb": money.vram_gb(F.col("param_count"), F.col("_bytes")), "flops": money.flops(F.col("param_count"), tokens)}).drop("_bytes")


def detector_cost(df: DataFrame, detector: str, ms: str, hourly: float = money.GPU_HOURLY_USD, tokens: int = 512) -> DataFrame:
    mean = df.groupBy(detector).agg(F.avg(ms).alias("mean_latency_ms"))
    x = F.col("mean_latency_ms")
    out = mean.withColumn("gpu_s_per_1k", money.gpu_seconds_per_1k(x)).withColumn("usd_per_1m", money.usd_per_million(x, hourly))
    return with_profile(out, detector, tokens)


def cascade_cost(df: DataFrame, hourly: float = money.GPU_HOURLY_USD) -> DataFrame:
    """Adds the cascade's cost report to rows with ``k1_ms``, ``k2_ms`` and ``e``."""
    k1, k2, e = F.col("k1_ms"), F.col("k2_ms"), F.col("e")
    cost, be = money.expected_ms(k1, k2, e), money.break_even(k1, k2)
    return df.withColumns({
        "ratio": F.try_divide(k1, k2), "break_even_e": be, "cheaper": e < be, "expected_ms": cost, "usd_cascade": money.usd_per_million(cost, hourly),
        "usd_stage2": money.usd_per_million(k2, hourly), "reduction": money.reduction(k1, k2, e)})


def overlay(base: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Later session over an earlier one; where both have a point the gap between them is kept."""
    b = base.select(*keys, F.col("actual_tokens").alias("_ba"), F.col("median_ms").alias("base_ms"))
    x = extra.select(*keys, F.col("actual_tokens").alias("_xa"), F.col("median_ms").alias("extra_ms"))
    return b.join(x, list(keys), "full_outer").select(
        *keys, F.coalesce("_xa", "_ba").alias("actual_tokens"), F.coalesce("extra_ms", "base_ms").alias("median_ms"),
        (F.try_divide(F.col("extra_ms"), F.col("base_ms")) - F.lit(1.0)).alias("drift"))


def anchor_pairs(curve: DataFrame, keys: Sequence[str], stage2: str) -> DataFrame:
    """First- and second-stage medians on shared target lengths."""
    k1 = curve.filter(F.col("role") == "stage1").select(*keys, "model", "target_tokens", F.col("median_ms").alias("k1_ms"), F.col("actual_tokens").alias("tokens1"))
    k2 = curve.filter(F.col("model") == stage2).select(*keys, "target_tokens", F.col("median_ms").alias("k2_ms"), F.col("actual_tokens").alias("tokens2"))
    return k1.join(k2, [*keys, "target_tokens"])


def segments(curve: DataFrame) -> DataFrame:
    """Piecewise-linear segments per model; equal token counts are averaged, both ends are open and flat."""
    pts = curve.groupBy("model", F.col("actual_tokens").cast("double").alias("x")).agg(F.avg("median_ms").alias("y"))
    w = Window.partitionBy("model").orderBy("x")
    seg = pts.select("model", "x", "y", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), F.row_number().over(w).alias("i"))
    low = F.when(F.col("i") == 1, F.lit(float("-inf"))).otherwise(F.col("x"))
    return seg.select("model", low.alias("x_from"), F.coalesce("x1", F.lit(float("inf"))).alias("x_to"), F.col("x").alias("x0"), F.col("y").alias("y0"),
                      F.coalesce(F.try_divide(F.col("y1") - F.col("y"), F.col("x1") - F.col("x")), F.lit(0.0)).alias("slope"))


def interp(df: DataFrame, tokens: str, seg: DataFrame, model: str, name: str) -> DataFrame:
    """Latency at a row's token count, as one expression over the pinned curve's few segments.

    A row without a token count gets NULL and stays; a model that the curve does not have is an error.
    """
    own = sorted((r.x_to, r.x0, r.y0, r.slope) for r in seg.filter(F.col("model") == model).collect())  # pinned
    if not own:
        raise ValueError(f"the latency curve has no model {model!r}")
    n, value = F.col(tokens).cast("double"), None
    for x_to, x0, y0, slope in own:
        here = F.lit(y0) + F.lit(slope) * (F.greatest(n, F.lit(x0)) - F.lit(x0))
        value = F.when(n < F.lit(x_to), here) if value is None else value.when(n < F.lit(x_to), here)
    return df.withColumn(name, value)


def length_weighted(df: DataFrame, hourly: float = money.GPU_HOURLY_USD, keys: Sequence[str] = ()) -> DataFrame:
    """Sums of per-request cost for rows with ``k1``, ``k2`` and the routing flag ``esc``."""
    k1, k2, esc = F.col("k1"), F.col("k2"), F.col("esc") == 1
    a = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("esc")).alias("e"), F.sum(k2).alias("base"), F.sum(k1).alias("router"), F.sum(F.when(esc, k2).otherwise(0.0)).alias("esc2"))
    base, router, esc2, n = (F.col(x) for x in ("base", "router", "esc2", "n"))
    return a.select(
        *keys, "n", "e", (base / n).alias("mean_k2"), (router / n).alias("mean_k1"), F.try_divide(router, base).alias("r_effective"),
        (F.lit(1.0) - F.try_divide(router + esc2, base)).alias("reduction"), F.try_divide(esc2, base).alias("stage2_share"),
        money.usd_per_million(base / n, hourly).alias("usd_base"), money.usd_per_million((router + esc2) / n, hourly).alias("usd_cascade"))


def prevalence_weights(df: DataFrame, shares: Mapping[str, float | None], keys: Sequence[str] = ()) -> DataFrame:
    """One copy of the rows per target mix with a weight; ``None`` keeps the mix of the data."""
    sizes = df.groupBy(*keys).agg(F.sum(1 - F.col("label")).alias("_nb"), F.sum("label").alias("_na"))
    rows = df.join(sizes, list(keys)) if keys else df.join(F.broadcast(sizes))
    mixes = F.array(*[F.struct(F.lit(k).alias("mix"), F.lit(v).cast("double").alias("share")) for k, v in shares.items()])
    rows = rows.select("*", F.explode(mixes).alias("_m")).select("*", "_m.mix", "_m.share").drop("_m")
    share = F.coalesce(F.col("share"), ratio(F.col("_nb"), F.col("_nb") + F.col("_na")))
    w = F.when(F.col("label") == 0, share / F.col("_nb")).otherwise((F.lit(1.0) - share) / F.col("_na"))
    return rows.withColumn("weight", w).drop("_nb", "_na", "share")


def weighted_cost(df: DataFrame, k1: str, k2: str, keys: Sequence[str]) -> DataFrame:
    w, a, b, esc = F.col("weight"), F.col(k1), F.col(k2), F.col("esc").cast("double")
    s = df.groupBy(*keys).agg(F.sum(w * b).alias("baseline_ms"), F.sum(w * (a + esc * b)).alias("cascade_ms"), F.sum(w * a).alias("_r"))
    base = F.col("baseline_ms")
    return s.select(*keys, "baseline_ms", "cascade_ms", (F.lit(1.0) - F.try_divide(F.col("cascade_ms"), base)).alias("reduction"), F.try_divide(F.col("_r"), base).alias("r_effective"))


def weighted_quantiles(df: DataFrame, value: str, shares: Mapping[str, float | None], qs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Smallest value whose cumulative weight reaches q, for several class mixes.

    Weights only depend on the class, so cumulative weights follow from cumulative class counts; these
    are whole numbers and the result does not depend on summation order.
    """
    mixes = [(k, v) for k, v in shares.items()]

    def weight(neg: Column, pos: Column, share: float | None) -> Column:
        if share is None:
            return ratio(neg + pos, F.col("neg_all") + F.col("pos_all"))
        return ratio(neg, F.col("neg_all")) * F.lit(share) + ratio(pos, F.col("pos_all")) * F.lit(1.0 - share)

    def keep() -> Column:
        cond = F.lit(False)
        for _, s in mixes:
            before = weight(F.col("neg_off"), F.col("pos_off"), s)
            after = weight(F.col("neg_off") + F.col("neg_in"), F.col("pos_off") + F.col("pos_in"), s)
            for q in qs:
                cond = cond | ((before < q) & (after >= q))
        return cond

    run = running(df, value, class_sums(), keep=keep)
    neg, pos = F.col("neg_below") + F.col("neg"), F.col("pos_below") + F.col("pos")
    aggs = [F.min(F.when(weight(neg, pos, s) >= q, F.col(value))).alias(f"{k}_{n}") for k, s in mixes for q, n in zip(qs, names)]
    one = run.agg(*aggs)
    packed = F.array(*[F.struct(F.lit(k).alias("mix"), *[F.col(f"{k}_{n}").alias(n) for n in names]) for k, _ in mixes])
    return one.select(F.explode(packed).alias("m")).select("m.*")


def interp_error(df: DataFrame, priced: str, measured: str) -> DataFrame:
    """Relative error of priced against measured latency."""
    x = df.select(priced, measured, ((F.col(priced) - F.col(measured)) / F.col(measured)).alias("_e")).withColumn("_a", F.abs("_e"))
    q = quantiles(x, "_e", {"median": 0.5}).join(F.broadcast(quantiles(x, "_a", {"p95_abs": 0.95})))
    s = x.agg(F.avg("_e").alias("mean"), F.max("_a").alias("max_abs"), (F.sum(priced) / F.sum(measured) - 1.0).alias("total_bias"))
    return s.join(F.broadcast(q))
