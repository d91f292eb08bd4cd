"""Order statistics and running sums over a whole table without one big task.

A window ordered by a score and partitioned by nothing (or by a key that holds a third of the rows)
sorts everything in one task. Here the value axis is cut into buckets first:

1. one sketch pass gives the cut points (a bounded list of doubles on the driver);
2. bucket totals are a map-side-combined aggregate, and their running sums are the bucket offsets;
3. only inside a bucket are rows ordered, after equal values have been merged.

Cut points only steer balance. They are literals in the plan, so every branch (and every task that is
run again) sees the same buckets and the result is exact whatever the sketch said.
A ``keep`` rule on the bucket offsets drops all buckets that cannot hold the wanted rank before any
row is shuffled; picking a threshold then costs scans and a shuffle of about one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
MAX_BUCKETS = 4096
MAX_BROADCAST_ROWS = 200_000  # bucket offsets are a few longs per row


def bucket_count(df: DataFrame) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(8, min(MAX_BUCKETS, 4 * parts))


def _cut_spots(value: str, n: int) -> Column:
    # Cut points may be off by a quarter of a bucket; a finer sketch would only make the merge larger.
    return F.percentile_approx(F.col(value).cast("double"), [i / n for i in range(1, n)], max(1000, 4 * n))


def _as_cuts(found: list[float] | None) -> list[float]:
    return sorted({float(x) for x in found or []})


def cut_points(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """At most ``buckets - 1`` increasing cut points of a column, from one sketch pass."""
    return _as_cuts(df.agg(_cut_spots(value, buckets or bucket_count(df)).alias("c")).first()["c"])


def _cuts_and_groups(df: DataFrame, value: str, keys: Sequence[str]) -> tuple[list[float], int]:
    """Cut points and the (estimated) number of key groups, from the same pass."""
    n = bucket_count(df)
    groups = F.approx_count_distinct(F.struct(*keys)) if keys else F.lit(1)
    row = df.agg(_cut_spots(value, n).alias("c"), groups.alias("g")).first()
    return _as_cuts(row["c"]), int(row["g"])


def with_bucket(df: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """Number of cut points at or below the value, found by binary search inside the JVM."""
    if not cuts:
        return df.withColumn(BUCKET, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    tmp = df.withColumn("_v", F.col(value).cast("double"))
    out = Bucketizer(splits=splits, inputCol="_v", outputCol=BUCKET, handleInvalid="keep").transform(tmp)
    return out.withColumn(BUCKET, F.col(BUCKET).cast("int")).drop("_v")


def _over(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def running(
    df: DataFrame,
    value: str,
    sums: Mapping[str, Column],
    keys: Sequence[str] = (),
    keep: Callable[[], Column] | None = None,
    cuts: Sequence[float] | None = None,
    groups: int | None = None,
) -> DataFrame:
    """One row per distinct (keys, value) with running sums.

    For each name in ``sums`` the result has ``name`` (sum at this value), ``name_below`` (sum over
    smaller values) and ``name_all`` (sum over the key group). Rows with a NULL value are left out.
    ``groups`` is the number of key groups where the caller knows it; otherwise it is estimated.
    ``keep`` may use ``name_off`` (sum before the bucket), ``name_in`` (sum in it) and ``name_all``.
    """
    keys = list(keys)
    names = list(sums)
    base = df.select(*keys, F.col(value), *[c.alias(n) for n, c in sums.items()])
    base = base.filter(F.col(value).isNotNull())
    if cuts is None:
        cuts, seen = _cuts_and_groups(base, value, keys)
        groups = seen if groups is None else groups
    rows = with_bucket(base, value, cuts)
    totals = rows.groupBy(*keys, BUCKET).agg(*[F.sum(n).alias(f"{n}_in") for n in names])
    ordered = _over(keys).orderBy(BUCKET)
    offsets = totals.select(
        *keys, BUCKET,
        *[F.col(f"{n}_in") for n in names],
        *[(F.sum(f"{n}_in").over(ordered) - F.col(f"{n}_in")).alias(f"{n}_off") for n in names],
        *[F.sum(f"{n}_in").over(_over(keys)).alias(f"{n}_all") for n in names],
    )
    if keep is not None:
        offsets = offsets.filter(keep())
    offsets = offsets.drop(*[f"{n}_in" for n in names])
    # Offsets are at most groups x buckets rows. They are broadcast when that product is known to be
    # small; with more groups the same joins run as shuffles.
    few = not keys or (groups is not None and groups * (len(cuts) + 1) <= MAX_BROADCAST_ROWS)
    small = F.broadcast if few else (lambda x: x)
    side = small(offsets)
    on = [*keys, BUCKET]
    if keep is not None:
        rows = rows.join(small(offsets.select(*on)), on, "left_semi")
    merged = rows.groupBy(*keys, BUCKET, value).agg(*[F.sum(n).alias(n) for n in names])
    inside = Window.partitionBy(*keys, BUCKET).orderBy(value)
    out = merged.join(side, on)
    return out.select(
        *keys, value, *names,
        *[(F.col(f"{n}_off") + F.sum(n).over(inside) - F.col(n)).alias(f"{n}_below") for n in names],
        *[F.col(f"{n}_all") for n in names],
    )


def holds(name: str, rank: Column) -> Column:
    """The row whose 0-based positions include ``rank``."""
    below = F.col(f"{name}_below")
    return (F.col(name) > 0) & (below <= rank) & (rank < below + F.col(name))


def bucket_holds(name: str, rank: Column) -> Column:
    off = F.col(f"{name}_off")
    return (off <= rank) & (rank < off + F.col(f"{name}_in"))


def quantiles(
    df: DataFrame,
    value: str,
    shares: Mapping[str, float],
    keys: Sequence[str] = (),
    where: Column | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles per key group: one row per group, one column per name."""
    base = df if where is None else df.filter(where)
    n_all = F.col("_n_all")

    def spots(q: float) -> tuple[Column, Column, Column]:
        pos = F.lit(q) * (n_all - F.lit(1))
        lo = F.floor(pos)
        return pos, lo, F.least(lo + F.lit(1), n_all - F.lit(1))

    def keep() -> Column:
        cond = F.lit(False)
        for q in shares.values():
            _, lo, hi = spots(q)
            cond = cond | bucket_holds("_n", lo) | bucket_holds("_n", hi)
        return cond

    run = running(base, value, {"_n": F.lit(1).cast("long")}, keys, keep)
    picks = []
    for i, q in enumerate(shares.values()):
        pos, lo, hi = spots(q)
        picks += [
            F.max(F.when(holds("_n", lo), F.col(value).cast("double"))).alias(f"_lo{i}"),
            F.max(F.when(holds("_n", hi), F.col(value).cast("double"))).alias(f"_hi{i}"),
            F.max(pos - lo).alias(f"_f{i}"),
        ]
    out = run.groupBy(*keys).agg(*picks)
    return out.select(
        *keys,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(n)
            for i, n in enumerate(shares)
        ],
    )


def number_rows(
    df: DataFrame,
    order: Sequence[Column],
    bucket: Column,
    keys: Sequence[str] = (),
    name: str = "rn",
    limit: int | None = None,
) -> DataFrame:
    """1-based row numbers per key group under ``order``.

    ``bucket`` must not decrease along ``order``; rows are only sorted inside a (keys, bucket) cell.
    With ``limit`` only numbers up to it are wanted: cells that start beyond it are dropped before any
    row is moved.
    """
    keys = list(keys)
    rows = df.withColumn(BUCKET, bucket)
    totals = rows.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_in"))
    offsets = totals.select(
        *keys, BUCKET, (F.sum("_in").over(_over(keys).orderBy(BUCKET)) - F.col("_in")).alias("_off")
    )
    if limit is not None:
        offsets = offsets.filter(F.col("_off") < limit)
    # Without keys there is one row per bucket, of which there are at most MAX_BUCKETS.
    side = F.broadcast(offsets) if not keys else offsets
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    out = (
        rows.join(side, [*keys, BUCKET])
        .withColumn(name, (F.row_number().over(inside) + F.col("_off")).cast("long"))
        .drop(BUCKET, "_off")
    )
    return out if limit is None else out.filter(F.col(name) <= limit)


def number_by_hash(
    df: DataFrame, key: str, ties: Sequence[str], keys: Sequence[str] = (), name: str = "rn", limit: int | None = None
) -> DataFrame:
    """Row numbers under a column of hex digests; its first three digits are 4,096 even buckets."""
    return number_rows(df, [F.col(key), *[F.col(t) for t in ties]], F.substring(key, 1, 3), keys, name, limit)


def number_by_value(
    df: DataFrame, value: str, ties: Sequence[str] = (), keys: Sequence[str] = (), name: str = "rn", limit: int | None = None
) -> DataFrame:
    """Row numbers under a numeric column, cut into buckets by a sketch of that column."""
    cuts = cut_points(df, value)
    rows = with_bucket(df, value, cuts).withColumnRenamed(BUCKET, "_vb")
    out = number_rows(rows, [F.col(value), *[F.col(t) for t in ties]], F.col("_vb"), keys, name, limit)
    return out.drop("_vb")
