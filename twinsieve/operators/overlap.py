"""How much of one text collection occurs in another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.functions import text as t
from twinsieve.functions.scores import ratio
from twinsieve.operators.phrases import occurrences_by
from twinsieve.operators.ranks import bucket_holds, holds, running
from twinsieve.sources.readers import stored


HOT_SHARE = 1000  # a gram with more than this part of all gram rows is hot: there are fewer than this many


def coverage(df: DataFrame, ref: DataFrame, ident: str, text: str, keep: Sequence[str] = (), tail: int = 80, k: int = 5) -> DataFrame:
    """Share of each row's tail grams that occur in the reference tails; 0 for a row without grams.

    Rows with one tail are one entry, and grams are 64-bit hashes. Which grams are known is settled on distinct grams.
    A gram that most tails share would meet in one task, so hot grams go to the rows by broadcast (fewer than
    ``HOT_SHARE`` by their definition) and only the others are joined by shuffle.
    """
    end = lambda x: t.squeeze(F.right(F.col(text), F.lit(tail)))
    grams = lambda x: F.transform(t.shingle_set(x, k, short_text=False), lambda g: F.xxhash64(g))
    rows = stored(df.select(ident, *keep, F.md5(end(df).cast("binary")).alias("_tail"), end(df).alias("_end")), "tails")
    own = stored(rows.groupBy("_tail").agg(F.first("_end").alias("_end")).select("_tail", F.explode(grams(F.col("_end"))).alias("g")), "tail-grams")
    known = ref.select(end(ref).alias("_end")).distinct().select(F.explode(grams(F.col("_end"))).alias("g")).distinct()
    total = own.count()
    seen = stored(own.groupBy("g").agg(F.count(F.lit(1)).alias("n")).join(known.hint("merge"), "g", "left_semi"), "seen-grams")
    hot = F.col("n") * HOT_SHARE > total
    hits = own.join(F.broadcast(seen.filter(hot)), "g", "left_semi").unionByName(own.join(seen.filter(~hot), "g", "left_semi"))
    share = own.groupBy("_tail").agg(F.count(F.lit(1)).alias("_n")).join(hits.groupBy("_tail").agg(F.count(F.lit(1)).alias("_hits")), "_tail", "left")
    share = share.select("_tail", (F.coalesce("_hits", F.lit(0)) / F.col("_n")).alias("_c"))
    return stored(rows.join(share, "_tail", "left").select(ident, *keep, F.coalesce("_c", F.lit(0.0)).alias("coverage")), "coverage")


def coverage_summary(cov: DataFrame, key: str) -> DataFrame:
    """Mean, positional median and deciles, and shares above two bounds, per key."""
    n = F.col("_n_all")
    spots = {"median": F.expr("_n_all div 2"), "p10": F.expr("_n_all div 10"), "p90": F.expr("(9 * _n_all) div 10")}

    def keep():
        cond = F.lit(False)
        for s in spots.values():
            cond = cond | bucket_holds("_n", s)
        return cond

    run = running(cov, "coverage", {"_n": F.lit(1).cast("long")}, [key], keep)
    at = run.groupBy(key).agg(*[F.round(F.max(F.when(holds("_n", s), F.col("coverage"))), 4).alias(name) for name, s in spots.items()])
    c = F.col("coverage")
    base = cov.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.avg((c >= 0.999).cast("int")), 4).alias("fully"),
                                F.round(F.avg((c >= 0.9).cast("int")), 4).alias("above_09"))
    return base.join(at, key)


def containment(df: DataFrame, text: str, phrases: DataFrame) -> DataFrame:
    """Non-overlapping occurrences of each phrase of a table in safe and unsafe text, in one pass over the texts."""
    found = occurrences_by(df, text, "label", phrases)
    n = lambda y: F.coalesce(F.sum(F.when(F.col("key") == y, F.col("n"))), F.lit(0)).alias("in_unsafe" if y == "1" else "in_safe")
    per = phrases.select("phrase").distinct().join(found, "phrase", "left")
    return per.groupBy("phrase").agg(n("0"), n("1"))


def set_overlap(items: DataFrame) -> DataFrame:
    """Distinct, shared and one-sided items per kind, and the share of evaluation rows whose item was seen.

    ``items`` has ``side`` (train/eval), ``kind`` and ``item``. One aggregate per item, no join.
    """
    per = items.groupBy("kind", "item").agg(F.sum((F.col("side") == "eval").cast("long")).alias("e"), F.sum((F.col("side") == "train").cast("long")).alias("t"))
    e, tr = F.col("e") > 0, F.col("t") > 0
    return per.groupBy("kind").agg(
        F.sum(e.cast("long")).alias("eval_distinct"), F.sum(tr.cast("long")).alias("train_distinct"), F.sum((e & tr).cast("long")).alias("shared"),
        F.sum((e & ~tr).cast("long")).alias("eval_only"), F.round(ratio(F.sum(F.when(tr, F.col("e")).otherwise(0)), F.sum("e")), 4).alias("frac_seen"))
