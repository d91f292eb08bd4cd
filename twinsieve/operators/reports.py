"""Whole result documents: a detector's, and the timing summary of a split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.functions import money
from twinsieve.operators.cost import with_profile
from twinsieve.operators.metrics import CONFUSION, FPR_TARGETS, by_channel_and_overall, confusion, dr_at_fpr, one_row
from twinsieve.operators.ranks import quantiles


def at_name(target: float) -> str:
    """0.005 as ``005``: the digits behind the point."""
    return f"{target:g}".split(".")[1]


def rates_at(df: DataFrame, score: str, targets: Sequence[float] = FPR_TARGETS, keys: Sequence[str] = ()) -> DataFrame:
    """Detection rate and threshold at every target as columns ``dr_*`` and ``thr_*``, one row per keys."""
    long = dr_at_fpr(df, score, targets, keys)
    pick = lambda c, t: F.max(F.when(F.col("fpr_target") == t, F.col(c)))
    return long.groupBy(*keys).agg(*[pick("dr", t).alias(f"dr_{at_name(t)}") for t in targets], *[pick("threshold", t).alias(f"thr_{at_name(t)}") for t in targets])


def evaluate_detector(df: DataFrame, detector: str, pred: str = "pred", score: str | None = "score", ms: str | None = "ms", targets: Sequence[float] = FPR_TARGETS) -> DataFrame:
    """A detector's metrics: the row ``overall`` with everything, and a row per channel with its confusion metrics.

    Without scores (no column, or all NULL) the rates at fixed false-positive rates stay NULL and ``note`` says so;
    without latencies the cost block stays NULL. A table without rows is an error.
    """
    rows = df.select("label", "channel", F.col(pred).alias("pred"), *[(F.col(c).cast("double") if c else F.lit(None).cast("double")).alias(n) for c, n in ((score, "score"), (ms, "ms"))])
    benign = F.col("label") == 0
    base = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(benign).alias("n_benign"), F.count_if(F.col("label") == 1).alias("n_injection"), F.count("score").alias("_scored"),
        F.avg(F.when(benign, F.col("pred"))).alias("fpr_benign_only"), F.avg("ms").alias("mean_latency_ms"))
    base = base.withColumn("n", F.when(F.col("n") == 0, F.raise_error(F.lit("no prediction rows")).cast("long")).otherwise(F.col("n")))
    base = base.withColumn("note", F.when(F.col("_scored") == 0, "binary verdicts only: no score to sweep thresholds on")).drop("_scored")
    base = base.withColumns({"gpu_s_per_1k": money.gpu_seconds_per_1k(F.col("mean_latency_ms")), "usd_per_1m": money.usd_per_million(F.col("mean_latency_ms")), "detector": F.lit(detector)})
    base = with_profile(base, "detector").drop("detector")
    rates = rates_at(rows, "score", targets)
    # the aggregate of nothing is one row of NULLs, so a detector without scores keeps its row
    overall = one_row(base, rates).withColumn("group", F.lit("overall"))
    per = confusion(by_channel_and_overall(rows), "pred", ["group"]).select("group", *CONFUSION, "tp", "fp", "tn", "fn")
    # an empty table has no group at all: the error must still be raised
    return overall.join(per, "group", "full").withColumn("detector", F.lit(detector))


def timing_summary(df: DataFrame, cell: Sequence[str], row: str, ms: str = "ms", label: str = "label") -> DataFrame:
    """Latency per timed row (median of its repetitions), summed up per cell for all, benign and attack rows.

    ``spread_*`` is (max - min) / median of a row's repetitions, taken over the rows. A row with any attack
    repetition is an attack row.
    """
    keys = [*cell, row]
    each = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("reps"), F.min(ms).alias("_lo"), F.max(ms).alias("_hi"), F.max(label).alias("_y"))
    each = each.join(quantiles(df, ms, {"_m": 0.5}, keys), keys).withColumn("_spread", (F.col("_hi") - F.col("_lo")) / F.col("_m"))
    kind = F.explode(F.array(F.lit("all"), F.when(F.col("_y") == 1, "attack").otherwise("benign")))
    each = each.select(*cell, kind.alias("rows"), "reps", F.col("_m").alias("m"), F.col("_spread").alias("s"))
    by = [*cell, "rows"]
    out = each.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("reps").alias("reps"), F.avg("m").alias("mean_ms"), F.stddev_samp("m").alias("stdev_ms"), F.min("m").alias("min_ms"), F.max("m").alias("max_ms"), (F.sum("m") / 1000.0).alias("total_sec"))
    out = out.join(quantiles(each, "m", {"median_ms": 0.5, "p90_ms": 0.9, "p95_ms": 0.95, "p99_ms": 0.99}, by), by)
    return out.join(quantiles(each, "s", {"spread_median": 0.5, "spread_p95": 0.95}, by), by)
