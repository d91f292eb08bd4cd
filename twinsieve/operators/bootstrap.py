"""Bootstrap intervals with seeded Poisson row weights.

Row ``i`` counts ``Poisson(1)`` times in replicate ``r``; the count is a function of (seed, r, i) only,
so no draw depends on the layout or on a task being run again. One digest serves four replicates. Rows stay
rows: they are sorted by what they are summed by, and each batch draws for all replicates and returns sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegralType, LongType, StructField, StructType

from twinsieve.functions.hashing import draws_in, draws_of, poisson1, poisson1_in  # noqa: F401  the tests hold draws_in to draws_of
from twinsieve.functions.scores import ratio
from twinsieve.operators.ranks import BUCKET, bucket_count, bucket_holds, cut_points, with_bucket
from twinsieve.sources.readers import stored

LANES = 4  # replicates that share a digest
ROWS = 10_000  # rows drawn for at once; an Arrow batch of Spark has as many
MOST_BUCKETS = 256  # score buckets of a pass: rows near the thresholds are cut again, so finer ones only cost sums
WIDE = "_wide"  # such a bucket; BUCKET is a finer one


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt evenly by key: a thousand draws for a row cost far more than moving it once."""
    return df.repartition(_parts(df), key)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _groups(columns: Sequence[pa.Array], rows: int) -> np.ndarray:
    """Numbers from 0 of the distinct rows of some columns."""
    number = np.zeros(rows, np.int64)
    for c in columns:
        code = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        number = np.unique(number * (code.max() + 1) + code, return_inverse=True)[1]
    return number


def replicate_sums(df: DataFrame, key: str, n: int, seed: int, values: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Sums of ``value * count`` for every (keys, replicate).

    Rows of one key draw alike, so their values are added first. The rest are dealt in the order of ``keys``, those of a
    large group over several tasks, and a batch hands on one list of sums for each group it holds.
    """
    keys, names, lanes = list(keys), list(values), -(-n // LANES)
    rows = df.select(*keys, F.col(key).cast("string").cast("binary").alias("_key"), *[v.alias(f"_{c}") for c, v in values.items()])
    rows = rows.groupBy(*keys, "_key").agg(*[F.sum(f"_{c}").alias(f"_{c}") for c in names])
    whole = {c: isinstance(rows.schema[f"_{c}"].dataType, IntegralType) for c in names}
    rows = rows.select(*keys, "_key", *[F.col(f"_{c}").cast("long" if whole[c] else "double").alias(f"_{c}") for c in names])
    rows = rows.repartitionByRange(_parts(df), *keys, "_key").sortWithinPartitions(*keys, "_key")
    lists = [StructField(f"_{c}", ArrayType(LongType() if whole[c] else DoubleType())) for c in names]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                b = whole_batch.slice(at, ROWS)
                number = _groups([b.column(c) for c in keys], b.num_rows)
                order = np.argsort(number, kind="stable")
                first = np.append(0, np.flatnonzero(np.diff(number[order])) + 1)
                b = b.take(pa.array(order))
                value = {c: b.column(f"_{c}").fill_null(0).to_numpy(zero_copy_only=False) for c in names}
                one = {c: whole[c] and bool((value[c] == 1).all()) for c in names}  # without copies the counts are the products
                known = {c: np.add.reduceat(b.column(f"_{c}").is_valid().to_numpy(zero_copy_only=False).astype(np.int64), first) > 0 for c in names}
                sums = {c: np.zeros((len(first), lanes * LANES), value[c].dtype) for c in names}
                for some, draws in draws_in(seed, lanes, b.column("_key").to_pylist()):
                    for lane, x in enumerate(draws):
                        w = poisson1_in(x)
                        for c in names:
                            sums[c][:, some.start * LANES + lane: some.stop * LANES: LANES] = np.add.reduceat(w if one[c] else w * value[c], first, axis=1, dtype=value[c].dtype).T
                spots = pa.array(np.arange(0, len(first) + 1, dtype=np.int32) * np.int32(n))
                out = [pa.ListArray.from_arrays(spots, pa.array(np.ascontiguousarray(sums[c][:, :n]).ravel()), mask=pa.array(~known[c])) for c in names]
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(first)) for c in keys], *out], [*keys, *[f"_{c}" for c in names]])

    sums = rows.mapInArrow(draw, StructType([*[rows.schema[c] for c in keys], *lists]))
    each = sums.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return each.groupBy(*keys, "rep").agg(*[F.sum(F.get(F.col(f"_{c}"), F.col("rep"))).alias(c) for c in names])


def interval(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """2.5, 50 and 97.5 percentiles over the replicates (one value per replicate); NULLs are left out."""
    spots: list[Column] = []
    for c in columns:
        for name, q in (("lo", 0.025), ("median", 0.5), ("hi", 0.975)):
            spots.append(F.percentile(F.col(c), F.lit(q)).alias(f"{c}_{name}"))
    return df.agg(*spots, F.count(F.lit(1)).alias("n_boot"))


def _by_side(rows: DataFrame, key: str, n: int, seed: int, at: str, keys: Sequence[str] = ()) -> DataFrame:
    """``rep, side, neg_in, pos_in, a_neg, a_pos`` by ``at``: benign rows and attacks among all rows (a) and escalated ones (c)."""
    sums = replicate_sums(rows, key, n, seed, {"w": F.lit(1).cast("long")}, [*keys, at, "kind", "esc"])
    of = lambda kind, ok: F.sum(F.when(ok & (F.col("kind") == kind), F.col("w")).when(F.col("kind").isNotNull(), 0))
    a = {f"a_{c}": of(k, F.lit(True)) for c, k in (("neg", 0), ("pos", 1))}
    sums = sums.groupBy(*keys, at, "rep").agg(*[x.alias(c) for c, x in a.items()], of(0, F.col("esc")).alias("c_neg"), of(1, F.col("esc")).alias("c_pos"))
    side = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_neg").alias("neg_in"), F.col(f"{s}_pos").alias("pos_in"), "a_neg", "a_pos") for s in "ac"]))
    return sums.select(*keys, at, "rep", side.alias("s")).select(*keys, at, "rep", "s.*")


def replicate_rates(df: DataFrame, key: str, theta: float, fpr: float = 0.01, n: int = 1000, seed: int = 0) -> DataFrame:
    """``rep, cascade_tpr, stage2_dr``: detection rates of the cascade and of the second stage alone.

    One pass sums the counts by replicate and score bucket. From these the bucket of either threshold is known for
    every replicate; only rows of such buckets are read again, by finer buckets, and of those the ones of the finer
    buckets by value.
    """
    label = F.col("label")
    kind = F.when(label == 0, 0).when(label == 1, 1).when(label.isNotNull(), 2)
    rows = df.filter(F.col("s2").isNotNull()).select(key, kind.alias("kind"), F.coalesce(F.col("p1") < theta, F.lit(False)).alias("esc"), "s2")
    buckets = min(bucket_count(df), MOST_BUCKETS)
    rows = with_bucket(rows, "s2", cut_points(rows, "s2", buckets)).withColumnRenamed(BUCKET, WIDE)
    cells = _by_side(rows, key, n, seed, WIDE)
    group = Window.partitionBy("rep", "side")

    def ends(at: str) -> tuple[Column, Column]:
        """Benign rows below and attacks above, inside a replicate's side."""
        before, after = group.orderBy(at).rowsBetween(Window.unboundedPreceding, -1), group.orderBy(at).rowsBetween(1, Window.unboundedFollowing)
        return F.coalesce(F.sum("neg_in").over(before), F.lit(0)), F.coalesce(F.sum("pos_in").over(after), F.lit(0))

    below, above = ends(WIDE)
    cells = cells.select(
        "rep", "side", WIDE, "neg_in", below.alias("neg_off"), above.alias("pos_after"),
        F.sum("neg_in").over(group).alias("nb"), F.sum("pos_in").over(group).alias("np"), F.sum("a_neg").over(group).alias("all_neg"), F.sum("a_pos").over(group).alias("all_pos"))
    rate = F.when(F.col("side") == "a", F.lit(fpr)).otherwise(F.least(F.lit(1.0), fpr * F.col("all_neg") / F.col("nb")))
    # read for the totals and for the buckets: replicates x buckets rows
    cells = stored(cells.withColumn("rank", F.ceil((F.col("nb") - 1) * (F.lit(1.0) - rate))), "replicates")
    totals = cells.groupBy("rep", "side").agg(F.max("np").alias("np"), F.max("nb").alias("nb"), F.max("all_pos").alias("all_pos"))
    hit = cells.filter((F.col("nb") > 0) & bucket_holds("neg", F.col("rank"))).select("rep", "side", WIDE, "rank", F.col("neg_off").alias("_off"), "pos_after")

    def nearer(near: DataFrame, hit: DataFrame, at: Sequence[str], by: str) -> DataFrame:
        """Where by ``by`` the rank lies among the rows of each replicate's bucket, and the attacks above that."""
        inside = _by_side(near, key, n, seed, by, at).drop("a_neg", "a_pos").join(F.broadcast(hit), ["rep", "side", *at])  # two rows per replicate
        below, above = ends(by)
        inside = inside.select("rep", "side", *at, by, "rank", "neg_in", (F.col("_off") + below).alias("neg_off"), (F.col("pos_after") + above).alias("pos_after"))
        return inside.filter(bucket_holds("neg", F.col("rank"))).select("rep", "side", *at, by, "rank", F.col("neg_off").alias("_off"), "pos_after")

    near = rows.join(F.broadcast(hit.select(WIDE).distinct()), WIDE, "left_semi")
    near = with_bucket(near, "s2", cut_points(near, "s2", 4 * buckets))
    hit = stored(nearer(near, hit, [WIDE], BUCKET), "replicates")
    near = near.join(F.broadcast(hit.select(WIDE, BUCKET).distinct()), [WIDE, BUCKET], "left_semi")
    found = nearer(near, hit, [WIDE, BUCKET], "s2").select("rep", "side", F.col("pos_after").alias("caught"))
    # without an escalated benign row there is no threshold, and every escalated attack is caught
    each = totals.join(found, ["rep", "side"], "left").withColumn("tpr", ratio(F.coalesce("caught", F.when(F.col("nb") == 0, F.col("np"))), F.col("all_pos")))
    return each.groupBy("rep").agg(F.max(F.when(F.col("side") == "c", F.col("tpr"))).alias("cascade_tpr"), F.max(F.when((F.col("side") == "a") & (F.col("nb") > 0), F.col("tpr"))).alias("stage2_dr"))


def gap(df: DataFrame, key: str, theta: float, fpr: float = 0.01, n: int = 1000, seed: int = 0) -> DataFrame:
    """Interval of the cascade's detection rate, the second stage's, and their difference."""
    both = replicate_rates(df, key, theta, fpr, n, seed).withColumn("gap", F.col("cascade_tpr") - F.col("stage2_dr"))
    out = interval(both, ["cascade_tpr", "stage2_dr", "gap"])
    verdict = F.when(F.col("gap_lo") > 0, "exceeds").when(F.col("gap_hi") < 0, "worse").otherwise("matches")
    return out.withColumn("verdict", verdict)


def paired(df: DataFrame, key: str, value: str, n: int = 1000, seed: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Interval of the mean of a per-id difference. A replicate that draws no row of a group has no mean."""
    sums = replicate_sums(df, key, n, seed, {"sum": F.col(value), "count": F.lit(1)}, keys)
    mean = sums.select(*keys, "rep", ratio(F.col("sum"), F.col("count")).alias("m"))
    q = [F.percentile(F.col("m"), F.lit(x)).alias(nm) for nm, x in (("lo", 0.025), ("hi", 0.975))]
    ci = mean.groupBy(*keys).agg(*q)
    point = df.groupBy(*keys).agg(F.avg(value).alias("delta"), F.count(F.lit(1)).alias("n"))
    return point.join(ci, list(keys)) if keys else point.join(F.broadcast(ci))
