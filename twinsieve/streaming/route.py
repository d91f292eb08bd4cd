"""Routing of arriving scored requests. Stateless: every request is judged by frozen parameters alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.functions.scores import clean, logit_gap, route, sigmoid

SCORED = "row_id bigint, logp_benign double, logp_injection double"


def routed(scores: DataFrame, temperature: float, theta_safe: float, theta_unsafe: float) -> DataFrame:
    """Calibrated probability and decision per request; works on batch and streaming frames alike."""
    z = logit_gap(clean(F.col("logp_benign")), clean(F.col("logp_injection")))
    p = scores.select("row_id", sigmoid(z / temperature).alias("p_safe"))
    return p.withColumn("decision", route(F.col("p_safe"), theta_safe, theta_unsafe))


def run_available(
    spark: SparkSession, source: str, sink: str, checkpoint: str,
    temperature: float, theta_safe: float, theta_unsafe: float, files_per_batch: int = 1000,
) -> None:
    """Route everything that has arrived and stop. One folder per decision; a restart goes on where it stopped."""
    arriving = spark.readStream.schema(SCORED).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    job = (
        routed(arriving, temperature, theta_safe, theta_unsafe)
        .writeStream.format("parquet").partitionBy("decision").outputMode("append")
        .option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    job.awaitTermination()


DECISIONS = ("pass", "block", "escalate")
REQUESTS = f"{SCORED}, sent timestamp"
Writer = Callable[[DataFrame, str], None]


def overwrite_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def run_sinks(
    spark: SparkSession, source: str, sinks: dict[str, str], checkpoint: str, temperature: float, theta_safe: float, theta_unsafe: float,
    late: str = "10 minutes", files_per_batch: int = 1000, write: Writer = overwrite_parquet,
) -> None:
    """Route all requests that have arrived into a sink per decision and stop.

    A request sent again within ``late`` of its event time ``sent`` is dropped by its ``row_id``; rows without an id or a
    time cannot be told apart or aged and are all kept: they pass beside the deduplication. Every batch goes to the folder
    ``batch=<id>`` of each sink and replaces what stands there, so a batch that is run again after a crash between two
    sinks writes once. ``read_sinks`` gives the routed rows.
    """
    missing = set(DECISIONS) - set(sinks)
    if missing:
        raise ValueError(f"no sink for {sorted(missing)}")

    def one(batch: DataFrame, number: int) -> None:
        rows = routed(batch, temperature, theta_safe, theta_unsafe).persist()
        try:
            for name in DECISIONS:
                write(rows.filter(F.col("decision") == name), f"{sinks[name]}/batch={number}")
        finally:
            rows.unpersist()

    arriving = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    whole = F.col("row_id").isNotNull() & F.col("sent").isNotNull()
    once = arriving.filter(whole).withWatermark("sent", late).dropDuplicatesWithinWatermark(["row_id"])
    job = once.union(arriving.filter(~whole)).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()


def read_sinks(spark: SparkSession, sinks: dict[str, str]) -> DataFrame:
    """Rows of all sinks as ``row_id, p_safe, decision``; an error before the first batch, when there are no sinks yet."""
    out = None
    for name in DECISIONS:
        part = spark.read.schema("row_id bigint, p_safe double, decision string").parquet(f"{sinks[name]}/batch=*")
        out = part if out is None else out.unionByName(part)
    return out
