"""Contiguous shards of near equal size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.llm.common import stored, text_of


def contiguous_shards(docs: DataFrame, n_shards: int = 16, carry: str | None = None) -> DataFrame:
    """Cut the documents, in id order, into ``n_shards`` runs of near equal bytes.

    The rows are dealt into ranges of the id and written once. The ranges' totals, one row per partition, give
    each range the bytes and rows before it; running sums inside a range do the rest. A document goes to the
    shard in whose equal share of all bytes its middle lies, so a shard misses its share by less than one
    document. No task sees more than one range and nothing but the totals is summed globally.

    Returns ``doc_id, size, text_crc32, shard, slot`` and the column named in ``carry``. A size is the UTF-8
    bytes of the text plus one; a null text counts as an empty one (size 1, CRC 0). Null ids come first. Rows
    with one id are ordered by CRC, then by their place in the input; equal rows stay separate rows. An empty
    table gives an empty result; other columns are ignored.
    """
    t = text_of()
    order = ["_id", "text_crc32", "_tie"]
    rows = docs.select(
        F.col("doc_id").alias("_id"), (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"), F.monotonically_increasing_id().alias("_tie"),
        *([F.col(carry).alias("_carry")] if carry else []),
    )
    ranges = stored(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("_part", F.spark_partition_id()), "shards")
    everything = Window.orderBy("_part")
    totals = ranges.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows")).select(
        "_part",
        (F.sum("_bytes").over(everything.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_bytes")).alias("_bytes_before"),
        (F.sum("_rows").over(everything.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")).alias("_rows_before"),
        F.sum("_bytes").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    before = F.col("_bytes_before") + F.col("_run") - F.col("size")
    placed = (
        ranges.withColumn("_run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_nth", F.row_number().over(inside))
        .join(F.broadcast(totals), "_part")  # one row per partition of the shuffle
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.call_function("div", (before * 2 + F.col("size")) * n_shards, F.col("_total") * 2)).cast("int"))
        .withColumn("_row", F.col("_rows_before") + F.col("_nth") - 1)
    )
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first")).withColumnRenamed("shard", "_shard")
    return placed.join(F.broadcast(first), F.col("shard") == F.col("_shard")).select(
        F.col("_id").alias("doc_id"), "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"),
        *([F.col("_carry").alias(carry)] if carry else []),
    )
