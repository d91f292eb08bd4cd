"""Order-free digests of tables that are kept up to date by differences and compared with a pinned list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 4
_LANE = [f"lane{i}" for i in range(LANES)]
MODULUS = 1 << 64


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _wrapped(c: Column) -> Column:
    """A sum of lanes modulo 2^64."""
    return F.pmod(_wide(c), _wide(F.lit(str(MODULUS))))


def row_digest(cols: Sequence[str]) -> Column:
    """SHA-256 of all fields, each with its length in front, so that no two rows of fields read alike; NULL has none."""
    text = [F.col(f"`{c}`").cast("string") for c in cols]
    fields = [F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("null")) for x in text]
    return F.sha2(F.concat_ws("|", *fields).cast("binary"), 256)


def fingerprint(df: DataFrame, name: str, cols: Sequence[str] | None = None) -> DataFrame:
    """One row ``tbl, n, lane0 .. lane3`` for a table: its row count and the sums of its rows' digests, lane by lane.

    The digest of a row is cut into four lanes of 64 bits, and every lane is summed modulo 2^64. Sums do not depend on
    order or partitions and, unlike exclusive or, a row that comes twice does not cancel itself. It tells accidents
    (lost, doubled, changed rows) apart with 256 bits; it is not meant to stop someone who builds colliding tables.
    One pass with map-side sums: one row per task moves. An empty table has count and lanes 0.
    """
    digest = df.select(row_digest(cols or df.columns).alias("_h"))
    lanes = [_wide(F.conv(F.substring("_h", 16 * i + 1, 16), 16, 10)).alias(x) for i, x in enumerate(_LANE)]
    sums = digest.select(*lanes).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(x) for x in _LANE])
    return sums.select(F.lit(name).alias("tbl"), "n", *[_wrapped(F.coalesce(F.col(x), F.lit(0))).cast("string").alias(x) for x in _LANE])


def _summed(prints: DataFrame) -> DataFrame:
    sums = prints.groupBy("tbl").agg(F.sum("n").alias("n"), *[F.sum(_wide(F.col(x))).alias(x) for x in _LANE])
    return sums.select("tbl", "n", *[_wrapped(F.col(x)).cast("string").alias(x) for x in _LANE])


def updated(prints: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Fingerprints after rows came and went, from those of the old tables and of the differences alone.

    ``added`` and ``removed`` are fingerprints of the rows themselves; the tables are not read again.
    """
    out = prints
    if added is not None:
        out = out.unionByName(added)
    if removed is not None:
        out = out.unionByName(removed.select("tbl", (-F.col("n")).alias("n"), *[(-_wide(F.col(x))).cast("string").alias(x) for x in _LANE]))
    return _summed(out)


def compared(actual: DataFrame, pinned: DataFrame) -> DataFrame:
    """Verdict per table: ``same``, ``changed``, ``missing`` (pinned only) or ``unpinned``, with the rows it gained.

    A table of equal count and other lanes has ``gained`` 0 and is ``changed``; both lists hold one row per table.
    """
    a = actual.select("tbl", F.col("n").alias("_n"), F.struct(*_LANE).alias("_now"))
    p = pinned.select("tbl", F.col("n").alias("_m"), F.struct(*_LANE).alias("_pin"))
    same = (F.col("_n") == F.col("_m")) & (F.col("_now") == F.col("_pin"))
    verdict = F.when(F.col("_n").isNull(), "missing").when(F.col("_m").isNull(), "unpinned").when(same, "same").otherwise("changed")
    gained = F.coalesce("_n", F.lit(0)) - F.coalesce("_m", F.lit(0))
    return a.join(p, "tbl", "full").select("tbl", verdict.alias("verdict"), gained.cast("long").alias("gained"))


def verified(df: DataFrame, name: str, pinned: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The table itself, after a check that it is the pinned one; otherwise an error that names the verdict."""
    got = compared(fingerprint(df, name, cols), pinned.filter(F.col("tbl") == name)).first()
    if got.verdict != "same":
        raise ValueError(f"table {name} is not the pinned one: {got.verdict}, rows gained {got.gained}")
    return df
