"""Detector metrics over score tables. ``label`` is 0 (benign) or 1 (injection); scores grow with suspicion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.functions.scores import ratio
from twinsieve.operators.ranks import bucket_holds, holds, quantiles, running, with_bucket, BUCKET

FPR_TARGETS = (0.001, 0.005, 0.01)


def _int(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0).cast("long")


def class_sums(label: str = "label") -> dict[str, Column]:
    return {"neg": _int(F.col(label) == 0), "pos": _int(F.col(label) == 1)}


def higher_rank(n: Column, target: Column | float) -> Column:
    """0-based position of the benign quantile at ``1 - target`` under the 'higher' rule."""
    share = F.lit(1.0 - target) if isinstance(target, float) else F.lit(1.0) - target
    return F.ceil((n - F.lit(1)) * share)


def dr_at_fpr(
    df: DataFrame, score: str, targets: Sequence[float] = FPR_TARGETS, keys: Sequence[str] = (),
    label: str = "label", sums: dict[str, Column] | None = None, cuts: Sequence[float] | None = None,
    groups: int | None = None,
) -> DataFrame:
    """Detection rate at fixed false-positive rates, one row per (keys, target).

    The threshold is a benign score; flagging is strict. Only the bucket that holds the wanted rank is
    ever shuffled. Groups without benign rows, or without injections, keep a row with NULLs.
    """
    sums = sums or class_sums(label)

    def keep() -> Column:
        cond = F.lit(False)
        for t in targets:
            cond = cond | bucket_holds("neg", higher_rank(F.col("neg_all"), t))
        return cond

    at = running(df, score, sums, keys, keep, cuts, groups)
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(1.0 - t).alias("share")) for i, t in enumerate(targets)])
    hit = (
        at.select("*", F.explode(wanted).alias("w"))
        .filter(holds("neg", F.ceil((F.col("neg_all") - F.lit(1)) * F.col("w.share"))))
        .select(
            *keys, F.col("w.i").alias("_i"), F.col(score).cast("double").alias("threshold"),
            ratio(F.col("pos_all") - F.col("pos_below") - F.col("pos"), F.col("pos_all")).alias("dr"),
            ratio(F.col("neg_all") - F.col("neg_below") - F.col("neg"), F.col("neg_all")).alias("achieved_fpr"),
        )
    )
    sized = F.array(*[
        F.struct(F.lit(i).alias("_i"), F.lit(t).alias("fpr_target"), F.lit(int(1.0 / t)).alias("need"))
        for i, t in enumerate(targets)
    ])
    totals = (
        df.filter(F.col(score).isNotNull()).groupBy(*keys)
        .agg(F.sum(sums["neg"]).alias("n_benign"), F.sum(sums["pos"]).alias("n_injection"))
        .select(*keys, "n_benign", "n_injection", F.explode(sized).alias("t"))
        .select(*keys, "n_benign", "n_injection", "t.*")
    )
    return totals.join(hit, [*keys, "_i"], "left").select(
        *keys, "fpr_target", "dr", "threshold", "achieved_fpr",
        (F.coalesce(F.col("n_benign"), F.lit(0)) >= F.col("need")).alias("resolvable"), "n_benign", "n_injection",
    )


def dr_column(df: DataFrame, score: str, target: float = 0.01, keys: Sequence[str] = (), name: str = "dr") -> DataFrame:
    return dr_at_fpr(df, score, (target,), keys).select(*keys, F.col("dr").alias(name))


def thr_scan(df: DataFrame, score: str, target: float = 0.01, keys: Sequence[str] = ()) -> DataFrame:
    """Lowest benign score whose inclusive benign flag rate stays within the target, and its rates."""
    left = F.col("neg_all") - F.col("neg_below")

    def keep() -> Column:
        rest = F.col("neg_all") - F.col("neg_off") - F.col("neg_in")
        return ratio(rest, F.col("neg_all")) <= F.lit(target)

    run = running(df, score, class_sums(), keys, keep)
    ok = run.filter((F.col("neg") > 0) & (ratio(left, F.col("neg_all")) <= F.lit(target)))
    best = F.min_by(F.struct(
        F.col(score).alias("threshold"),
        ratio(F.col("pos_all") - F.col("pos_below"), F.col("pos_all")).alias("dr"),
        ratio(left, F.col("neg_all")).alias("achieved_fpr"),
    ), F.col(score)).alias("b")
    return ok.groupBy(*keys).agg(best).select(*keys, "b.*")


def thr_linear(df: DataFrame, score: str, target: float = 0.01) -> DataFrame:
    """Interpolated benign quantile as threshold, inclusive flag rule."""
    thr = quantiles(df, score, {"threshold": 1.0 - target}, where=F.col("label") == 0)
    s = F.col(score)
    flagged = s >= F.col("threshold")
    return df.filter(s.isNotNull()).join(F.broadcast(thr)).agg(
        F.max("threshold").alias("threshold"),
        ratio(F.sum(_int(flagged & (F.col("label") == 1))), F.sum("label")).alias("dr"),
        ratio(F.sum(_int(flagged & (F.col("label") == 0))), F.sum(1 - F.col("label"))).alias("fpr"),
    )


CONFUSION = ("f1", "precision", "recall", "tpr", "fpr", "accuracy")


def confusion(df: DataFrame, pred: str, keys: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Counts and rates of hard decisions; a rate with a zero denominator is NULL."""
    y, p = F.col(label), F.col(pred)
    c = df.groupBy(*keys).agg(
        F.sum(_int((p == 1) & (y == 1))).alias("tp"), F.sum(_int((p == 1) & (y == 0))).alias("fp"),
        F.sum(_int((p == 0) & (y == 0))).alias("tn"), F.sum(_int((p == 0) & (y == 1))).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    c = c.select(*keys, "tp", "fp", "tn", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                 ratio(fp, fp + tn).alias("fpr"), ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"))
    pr, rc = F.col("precision"), F.col("recall")
    return c.select(*keys, "tp", "fp", "tn", "fn", F.try_divide(2 * pr * rc, pr + rc).alias("f1"), "precision", "recall",
                    rc.alias("tpr"), "fpr", "accuracy")


def conf_bin(conf: Column, bins: int = 10) -> Column:
    """Index of the equal-width bin on [0, 1]; the last bin is closed. Outside values get NULL."""
    edge = [i / bins for i in range(bins + 1)]
    out = F.when((conf < edge[0]) | (conf > edge[-1]), F.lit(None).cast("int"))
    for i in range(1, bins):
        out = out.when(conf < F.lit(edge[i]), F.lit(i - 1))
    return out.when(conf.isNotNull(), F.lit(bins - 1))


def reliability(df: DataFrame, conf: str, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Mean confidence, observed rate and size of each non-empty bin."""
    return (
        df.select(*keys, "label", F.col(conf).alias("c"), conf_bin(F.col(conf), bins).alias("bin"))
        .filter(F.col("bin").isNotNull())
        .groupBy(*keys, "bin")
        .agg(F.avg("c").alias("mean_conf"), F.avg("label").alias("observed"), F.count(F.lit(1)).alias("n"))
    )


def ece(df: DataFrame, conf: str, keys: Sequence[str] = (), bins: int = 10, name: str = "ece") -> DataFrame:
    """Expected calibration error from the bounded bin table."""
    b = reliability(df, conf, keys, bins)
    gap = F.abs(F.col("mean_conf") - F.col("observed")) * F.col("n")
    return b.groupBy(*keys).agg(F.try_divide(F.sum(gap), F.sum("n").cast("double")).alias(name))


def auroc(df: DataFrame, score: str, keys: Sequence[str] = (), name: str = "auroc", cuts: Sequence[float] | None = None) -> DataFrame:
    """Mann-Whitney area with ties counted half; NULL when a class is missing."""
    run = running(df, score, class_sums(), keys, cuts=cuts)
    wins = F.col("pos") * (F.col("neg_below") + F.col("neg") / F.lit(2.0))
    agg = run.groupBy(*keys).agg(
        F.sum(wins).alias("w"), F.max("pos_all").cast("double").alias("p"), F.max("neg_all").cast("double").alias("m")
    )
    return agg.select(*keys, F.try_divide(F.col("w"), F.col("p") * F.col("m")).alias(name))


def roc_points(df: DataFrame, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """False- and true-positive rate at every distinct score, flagging at or above it."""
    run = running(df, score, class_sums(), keys)
    return run.select(
        *keys, F.col(score).alias("threshold"),
        ratio(F.col("neg_all") - F.col("neg_below"), F.col("neg_all")).alias("fpr"),
        ratio(F.col("pos_all") - F.col("pos_below"), F.col("pos_all")).alias("tpr"),
    )


def precision_recall(df: DataFrame, score: str) -> DataFrame:
    """Precision, recall and the step term of average precision at every distinct score."""
    run = running(df, score, class_sums())
    tp = F.col("pos_all") - F.col("pos_below")
    flagged = tp + F.col("neg_all") - F.col("neg_below")
    return run.select(
        F.col(score).alias("threshold"), ratio(tp, flagged).alias("precision"), ratio(tp, F.col("pos_all")).alias("recall"),
        (ratio(tp, flagged) * ratio(F.col("pos"), F.col("pos_all"))).alias("step"),
    )


def average_precision(df: DataFrame, score: str) -> DataFrame:
    return precision_recall(df, score).agg(F.sum("step").alias("average_precision"), F.count(F.lit(1)).alias("n_thresholds"))


def slice_breakdown(df: DataFrame, score: str, key: str, keys: Sequence[str] = ()) -> DataFrame:
    """AUROC, accuracy at 0.5 and class counts per slice; a NULL slice is kept as 'None'."""
    by = [*keys, "slice"]
    rows = df.select(*keys, F.coalesce(F.col(key), F.lit("None")).alias("slice"), "label", score)
    hit = _int((F.col(score) > 0.5) == (F.col("label") == 1))
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"),
        F.avg(hit).alias("accuracy"),
    )
    return base.join(auroc(rows, score, by), by, "left").withColumn("slice_by", F.lit(key))


def by_channel_and_overall(df: DataFrame, channel: str = "channel") -> DataFrame:
    """Each row once under ``overall`` and once under its channel if it has one."""
    both = F.when(F.col(channel).isNotNull(), F.array(F.col(channel), F.lit("overall"))).otherwise(F.array(F.lit("overall")))
    return df.withColumn("group", F.explode(both))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Tie-averaged rank of every distinct value, centred on zero and scaled to the row count."""
    run = running(df, value, {"n": F.lit(1).cast("long")})
    rank = F.col("n_below") + (F.col("n") + F.lit(1)) / F.lit(2.0)
    return run.select(value, ((rank - (F.col("n_all") + F.lit(1)) / F.lit(2.0)) / F.col("n_all")).alias(name))


def spearman(df: DataFrame, x: str, y: str, name: str = "spearman") -> DataFrame:
    """Rank correlation with average ranks. Pairs are merged first, so ties do not grow the joins."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = both.groupBy(x, y).agg(F.count(F.lit(1)).alias("w"))
    r = pairs.join(average_ranks(both, x, "_rx"), x).join(average_ranks(both, y, "_ry"), y)
    w, a, b = F.col("w"), F.col("_rx"), F.col("_ry")
    return r.agg(F.try_divide(F.sum(w * a * b), F.sqrt(F.sum(w * a * a) * F.sum(w * b * b))).alias(name))


def survival_benign(df: DataFrame, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of benign rows at or above each benign score."""
    run = running(df.filter(F.col("label") == 0), score, {"n": F.lit(1).cast("long")}, keys)
    return run.select(*keys, F.col(score).alias("score"), "n",
                      ratio(F.col("n_all") - F.col("n_below"), F.col("n_all")).alias("survival"))


def histogram_density(df: DataFrame, value: str, keys: Sequence[str], bins: int = 50) -> DataFrame:
    """Density over equal-width bins of [0, 1]; the last bin is closed."""
    b = df.select(*keys, conf_bin(F.col(value), bins).alias("bin")).filter(F.col("bin").isNotNull())
    n = b.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return n.select(*keys, "bin", "n", (F.col("n") / total * F.lit(float(bins))).alias("density"))


def length_bands(df: DataFrame, score: str, length: str, bands: dict[str, tuple[int, int | None]], target: float = 0.01) -> DataFrame:
    """AUROC and detection rate inside each length band, each with its own threshold."""
    n = F.col(length)
    band = F.lit(None).cast("string")
    for name, (lo, hi) in bands.items():
        band = F.when((n >= lo) & (n <= hi if hi is not None else F.lit(True)), name).otherwise(band)
    rows = df.withColumn("band", band).filter(F.col("band").isNotNull())
    size = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_injection"))
    return size.join(auroc(rows, score, ["band"]), "band", "left").join(dr_column(rows, score, target, ["band"]), "band", "left")


def band_by_cuts(df: DataFrame, value: str, cuts: Sequence[float], name: str) -> DataFrame:
    """Number of given cut points at or below the value."""
    return with_bucket(df, value, sorted(set(cuts))).withColumnRenamed(BUCKET, name)


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row frames side by side."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(F.broadcast(f))
    return out
