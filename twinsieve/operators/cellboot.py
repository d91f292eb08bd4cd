"""Bootstrap of detection rates on counts: what a replicate draws is drawn for whole cells of the score axis.

Rows of one class in one cell get Poisson weights that add up to one Poisson draw, so a replicate needs only the
cells' counts. Only the cell that holds a replicate's threshold is looked into, and its draw is split over its parts
by conditional binomials. Work is cells x replicates and does not grow with the rows; rows are never multiplied.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.operators.bootstrap import interval
from twinsieve.operators.ranks import BUCKET, cut_points, with_bucket

CELLS = 1024  # of the first cut
PARTS = 64  # into which a cell is cut that holds more distinct scores than can be read one by one
VALUES = 200_000  # distinct scores that are read one by one, of all cells together
CLASSES = ("neg_esc", "neg_not", "pos_esc", "pos_not")


def _counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.count(F.when(F.col("kind") == i, 1)).alias(c) for i, c in enumerate(CLASSES)], F.min("s2").alias("low"), F.max("s2").alias("high"))


class _Cell:
    """Ordered parts of one cell: their counts by class, and whether a part is one score."""

    def __init__(self, rows: list):
        self.counts = np.array([[r[c] for c in CLASSES] for r in rows], np.int64).reshape(len(rows), len(CLASSES))
        self.single = np.array([r["low"] == r["high"] for r in rows], bool)


def _split(rng: np.random.Generator, drawn: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Draws of a cell (replicates x classes) spread over its parts: replicates x parts x classes."""
    out = np.zeros((len(drawn), *counts.shape), np.int64)
    for c, total in enumerate(counts.sum(0)):
        if total:
            out[:, :, c] = rng.multinomial(drawn[:, c], counts[:, c] / total)
    return out


def _place(weights: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part in which the 0-based ``rank`` lies, and the ranks before it."""
    run = weights.cumsum(1)
    part = (run <= rank[:, None]).sum(1).clip(max=weights.shape[1] - 1)
    return part, run[np.arange(len(run)), part] - weights[np.arange(len(run)), part]


def replicate_rates(df: DataFrame, theta: float, fpr: float = 0.01, n: int = 1000, seed: int = 0, cells: int = CELLS, values: int = VALUES) -> tuple[np.ndarray, np.ndarray]:
    """Detection rates of the cascade and of the second stage alone in ``n`` replicates; NaN where undefined.

    One pass counts four classes (benign or attack, escalated or not) by cell of ``s2``. Where the threshold lies is
    found on the draws; the cells that hold one, a few in the upper tail, are read again, score by score if they hold
    at most ``values`` distinct ones, otherwise in ``PARTS`` parts, again and again. The driver holds counts of at
    most ``cells`` cells, ``PARTS`` parts of 2 n cells or ``values`` scores, and n x cells draws. Draws depend on the
    seed and the counts only.
    """
    esc = F.coalesce(F.col("p1") < theta, F.lit(False))
    kind = F.when(F.col("label") == 0, F.when(esc, 0).otherwise(1)).otherwise(F.when(esc, 2).otherwise(3))
    cuts = cut_points(df, "s2", cells)
    rows = with_bucket(df.filter(F.col("s2").isNotNull() & F.col("label").isin(0, 1)).select(F.col("s2").cast("double").alias("s2"), kind.alias("kind")), "s2", cuts)
    rng = np.random.default_rng(seed)
    known = sorted(_counts(rows, BUCKET).collect(), key=lambda r: r[BUCKET])
    if not known:
        return np.full(n, np.nan), np.full(n, np.nan)
    names, top = [(r[BUCKET],) for r in known], _Cell(known)
    drawn = np.stack([rng.poisson(top.counts) for _ in range(n)])  # replicates x cells x classes
    neg, pos = drawn[:, :, 0] + drawn[:, :, 1], drawn[:, :, 2] + drawn[:, :, 3]
    all_neg, all_pos, esc_neg, esc_pos = neg.sum((1,)), pos.sum(1), drawn[:, :, 0].sum(1), drawn[:, :, 2].sum(1)
    caught: dict[str, np.ndarray] = {"a": np.zeros(n, np.int64), "c": np.zeros(n, np.int64)}
    of: dict[str, Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]] = {
        "a": lambda w: (w[..., 0] + w[..., 1], w[..., 2] + w[..., 3]), "c": lambda w: (w[..., 0], w[..., 2])}
    share = np.minimum(1.0, fpr * all_neg / np.maximum(esc_neg, 1))
    rank = {"a": np.ceil((all_neg - 1) * (1.0 - fpr)), "c": np.ceil((esc_neg - 1) * (1.0 - share))}
    # a replicate's sides that still look for their threshold: the cell it lies in, its rank there and the cell's draw
    open_: dict[tuple[int, str], tuple[tuple, int]] = {}
    inside: dict[tuple[int, tuple], np.ndarray] = {}

    def descend(reps: np.ndarray, side: str, weights: np.ndarray, ranks: np.ndarray, parts: list[tuple], single: np.ndarray) -> None:
        benign, attacks = of[side](weights)
        part, before = _place(benign, ranks)
        after = attacks.sum(1) - attacks.cumsum(1)[np.arange(len(part)), part]
        caught[side][reps] += after
        for i, r in enumerate(reps):
            if not single[part[i]]:
                open_[r, side] = (parts[part[i]], int(ranks[i] - before[i]))
                inside[r, parts[part[i]]] = weights[i, part[i]]

    for side, has in (("a", all_neg > 0), ("c", esc_neg > 0)):
        reps = np.flatnonzero(has)
        descend(reps, side, drawn[reps], rank[side][reps], names, top.single)
    caught["c"][esc_neg == 0] = esc_pos[esc_neg == 0]  # without an escalated benign row every escalated attack is caught
    path = [BUCKET]
    while open_:
        wanted = sorted({cell for cell, _ in open_.values()})
        some = df.sparkSession.createDataFrame(wanted, ", ".join(f"{p} int" for p in path))
        rows = rows.join(F.broadcast(some), path)  # at most two cells a replicate
        each = _counts(rows, *path, "s2")
        if each.limit(values + 1).count() <= values:
            found, step = each.collect(), "s2"
        else:
            step = f"_part{len(path)}"
            spots = rows.groupBy(*path).agg(F.percentile_approx("s2", [i / PARTS for i in range(1, PARTS)], 10_000).alias("_cuts"), F.min("s2").alias("_least"))
            # scores equal to the least one are a part of their own, so every step makes progress
            part: Column = F.when(F.col("s2") == F.col("_least"), 0).otherwise(1 + F.size(F.filter("_cuts", lambda c: c < F.col("s2"))))
            rows = rows.join(F.broadcast(spots), path).withColumn(step, part.cast("int")).drop("_cuts", "_least")
            found = _counts(rows, *path, step).collect()
        groups: dict[tuple, list] = {}
        for r in sorted(found, key=lambda r: r[step]):
            groups.setdefault(tuple(r[p] for p in path), []).append(r)
        todo, open_ = open_, {}
        old, inside = inside, {}
        for cell in wanted:
            parts = _Cell(groups[cell])
            named = [(*cell, r[step]) if step != "s2" else cell for r in groups[cell]]
            reps = sorted({r for (r, _), (c, _) in todo.items() if c == cell})
            weights = _split(rng, np.array([old[r, cell] for r in reps]), parts.counts)
            for side in "ac":
                here = [i for i, r in enumerate(reps) if todo.get((r, side), (None,))[0] == cell]
                if here:
                    ranks = np.array([todo[reps[i], side][1] for i in here])
                    descend(np.array([reps[i] for i in here]), side, weights[here], ranks, named, parts.single)
        path.append(step)
    with np.errstate(divide="ignore", invalid="ignore"):
        cascade, alone = caught["c"] / all_pos, np.where(all_neg > 0, caught["a"] / all_pos, np.nan)
    return np.where(all_pos > 0, cascade, np.nan), np.where(all_pos > 0, alone, np.nan)


def gap(df: DataFrame, theta: float, fpr: float = 0.01, n: int = 1000, seed: int = 0) -> DataFrame:
    """Interval of the cascade's detection rate, the second stage's, and their difference, from ``replicate_rates``."""
    cascade, alone = replicate_rates(df, theta, fpr, n, seed)
    plain = lambda x: None if np.isnan(x) else float(x)
    rates = df.sparkSession.createDataFrame([(plain(a), plain(b)) for a, b in zip(cascade, alone)], "cascade_tpr double, stage2_dr double")
    out = interval(rates.withColumn("gap", F.col("cascade_tpr") - F.col("stage2_dr")), ["cascade_tpr", "stage2_dr", "gap"])
    return out.withColumn("verdict", F.when(F.col("gap_lo") > 0, "exceeds").when(F.col("gap_hi") < 0, "worse").otherwise("matches"))
