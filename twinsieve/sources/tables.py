"""The given tables and the frames derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two detectors' scores per event; rational arithmetic only, so any engine agrees bit for bit."""
    e = table(spark, sf_dir, "events")
    attack = F.col("event_type") == "error"
    shift = F.when(attack, 0).otherwise(1)
    i = F.col("event_id")
    return e.select(
        i.alias("row_id"),
        F.when(attack, 1).otherwise(0).cast("long").alias("label"),
        F.when(~attack, None).when(i % 3 == 0, "document").when(i % 3 == 1, "tool")
        .otherwise("direct").alias("channel"),
        F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("source"),
        ((F.lit(3.0) * (((i * 7919) % 10007 + F.lit(0.5)) / F.lit(10008.0)) + shift) / F.lit(4.0)).alias("p1"),
        ((F.lit(2.0) * (((i * 104729) % 10007 + F.lit(0.5)) / F.lit(10008.0)) + shift) / F.lit(3.0)).alias("p2"),
        (F.lit(60) + (i * 31) % 2100).alias("n_tokens"),
        F.col("value").alias("ms"),
        F.when(F.col("user_id") % 3 == 0, "cal").when(F.col("user_id") % 3 == 1, "val")
        .otherwise("eval").alias("split"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("row_id"), "text", F.col("toxic").cast("long").alias("label"), "lang", "source"
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency samples: every event is one repetition for a (regime, session, model, length) cell."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    slot = F.floor(i / 6) % 6
    model = F.floor(i / 2) % 3
    target = (
        F.when(slot == 0, 64).when(slot == 1, 128).when(slot == 2, 256)
        .when(slot == 3, 512).when(slot == 4, 1024).otherwise(2048)
    )
    per_token = F.when(model == 0, 0.25).when(model == 1, 0.5).otherwise(2.0)
    return e.select(
        F.when(i % 2 == 0, "nf4").otherwise("bf16").alias("regime"),
        F.when(F.col("user_id") % 4 == 0, "extra").otherwise("base").alias("session"),
        F.when(model == 0, "small-a").when(model == 1, "small-b").otherwise("large").alias("model"),
        F.when(model == 2, "stage2").otherwise("stage1").alias("role"),
        target.cast("long").alias("target_tokens"),
        F.when((target == 64) & (model == 2), 83).when(target == 64, 86).otherwise(target)
        .cast("long").alias("actual_tokens"),
        (F.lit(20.0) + per_token * target + F.col("value") / F.lit(17.0)).alias("ms"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("long").alias("label"),
        i.alias("idx"),
        (F.col("user_id") % 64).alias("rep_group"),
    )
