"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.llm.common import lookup, stored, text_of, word_count


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Words wanted from each source: ``source, source_size, target`` from ``source, source_size``.

    Sources in code point order, null last, have the weights in turn and share all words by weight. A target
    stops at ``cap`` times its source; the excess goes to the others by weight. In the order of cap over
    weight the capped sources come first, so one running sum finds the common level. One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    whole = Window.orderBy("_cap").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    s = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn + 1)).withColumn("_cap", F.col("source_size") * cap)
    before = by_level.rowsBetween(Window.unboundedPreceding, 0)
    s = s.select(
        "source", "source_size", "_w", "_cap",
        (F.sum("source_size").over(whole) - F.sum("_cap").over(before) + F.col("_cap")).alias("_left"),
        (F.sum("_w").over(whole) - F.sum("_w").over(before) + F.col("_w")).alias("_weights"),
    )
    level = F.col("_left") / F.col("_weights")
    s = s.withColumn("_level", F.max(F.when(F.col("_cap") > level * F.col("_w"), level)).over(whole))
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap").cast("double")))
    return s.select("source", "source_size", target.alias("target"))


def _sized(docs: DataFrame, hash_bits: int, carry: str | None = None) -> DataFrame:
    t = text_of()
    digest = F.md5(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), t), "UTF-8"))
    copy_hash = F.shiftright(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), 48 - hash_bits)
    return docs.select("doc_id", "source", word_count(t).alias("size"), copy_hash.alias("copy_hash"), *([F.col(carry).alias("_carry")] if carry else []))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, bits: int = 10, levels: int = 3, carry: str | None = None) -> DataFrame:
    """How many words a mix takes of every document, repeats counted.

    A source whose target is k times its size and a bit more gives every document k times and some of them
    once more: those whose hash is below the source's threshold. Words are summed by source and the first
    ``bits`` bits of the hash; the bucket in which the sum passes the budget is split by the next bits, and
    only its rows are read again, ``levels`` times in all. What is left is one cell of the hash, taken if that
    comes nearer to the target. Nothing is sorted, and thresholds are nested: a larger budget keeps every
    document that a smaller one takes.

    Returns ``doc_id, source, size, source_size, target, taken, times, copy_hash``. A null text has no words; a row
    without words comes as often as its source is taken whole. No row comes more than ``cap`` times. A null source is a
    source of its own, after all others. Rows with one id and one text share a hash and are
    taken together. An empty table gives an empty result; other columns are ignored, but for one named in ``carry``.
    """
    total_bits = bits * levels
    rows = stored(_sized(docs, total_bits), "mix")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = source_targets(sizes, weights, cap).withColumn("times", times).select(
        "*", (F.col("target") - F.col("times") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("cell"))
    state = stored(state, "mix-state")
    for level in range(1, levels + 1):
        shift = total_bits - bits * level
        inside = lookup(rows, state.select("source", "cell"), ["source"], F.col("copy_hash"))
        if level > 1:
            inside = inside.filter(F.shiftright("copy_hash", shift + bits) == F.col("cell"))
        sums = inside.groupBy("source", F.shiftright("copy_hash", shift).alias("next")).agg(F.sum("size").alias("words"))
        sums = lookup(sums, state.select("source", "left"), ["source"], F.col("next"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("next").rowsBetween(Window.unboundedPreceding, 0))
        passed = sums.withColumn("run", run).filter(F.col("run") > F.col("left")).groupBy("source").agg(
            F.min(F.struct("next", (F.col("left") - F.col("run") + F.col("words")).alias("left"), "words")).alias("p"))
        passed = passed.select(F.col("source").alias("_s"), "p.*")
        # no bucket passes the budget: it covers all that is inside
        nxt = F.coalesce(F.col("next"), F.shiftleft(F.col("cell") + 1, bits) if level > 1 else F.lit(1 << bits)).cast("long")
        prev = state.drop("words") if level > 1 else state
        state = stored(prev.withColumnRenamed("left", "_left").join(passed, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", "source_size", "target", "times", nxt.alias("cell"),
            F.coalesce("left", F.when(F.col("next").isNull(), F.lit(0.0))).alias("left"), F.coalesce("words", F.lit(0)).alias("words"),
        ), "mix-state")
    below = F.col("cell") + F.when(F.col("words") < 2 * F.col("left"), 1).otherwise(0)
    limits = stored(state.select("source", "source_size", "target", "times", below.alias("_below")), "mix-state")
    out = lookup(_sized(docs, total_bits, carry) if carry else rows, limits, ["source"], F.col("copy_hash"))
    # a row without words fills nothing, wherever its hash lies; and no row comes more often than its source's cap
    taken = F.least(F.col("times") + F.when((F.col("copy_hash") < F.col("_below")) & (F.col("size") > 0), 1).otherwise(0), F.lit(cap))
    return out.withColumn("times", taken).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", "copy_hash",
        *([F.col("_carry").alias(carry)] if carry else []))
