"""Readers and writers for line-delimited JSON, score files and latency curves."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.functions.scores import clean
from twinsieve.session import checkpoint_dir

SCORES = "row_id bigint, logp_benign double, logp_injection double, p_safe double"


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; blank lines are skipped and a malformed line stops the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> str:
    """Spark's commit protocol makes the output appear only when the whole write is done."""
    df.write.mode("overwrite").json(path)
    return path


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score rows; a NaN becomes NULL."""
    raw = read_jsonl(spark, path, SCORES)
    return raw.select("row_id", *[clean(F.col(c)).alias(c) for c in ("logp_benign", "logp_injection", "p_safe")])


def union_splits(spark: SparkSession, parts: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Union of splits as ``(origin, text)``; a missing path is skipped and empty texts are dropped."""
    out = None
    for split, (path, key, text) in parts.items():
        hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath):
            continue
        part = spark.read.parquet(path).select(
            F.format_string("%s:%d", F.lit(split), F.col(key)).alias("origin"), F.col(text).alias("text")
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("none of the splits exists")
    return out.filter(F.length("text") > 0)


DEDUP = "struct<reason:string,jac:double,cos:double,match_train_id:string>"


def write_verdicts(df: DataFrame, path: str, prefix: str) -> str:
    """Screened rows, whole, in two folders ``kept=true`` and ``kept=false``; removed ones with their provenance."""
    match = F.concat(F.lit(prefix), F.col("match_id").cast("string")).alias("match_train_id")
    note = F.when(F.col("remove"), F.struct("reason", "jac", "cos", match))
    df.withColumn("_dedup", note).withColumn("kept", ~F.col("remove")).drop("remove", "reason", "jac", "cos", "match_id").write.partitionBy("kept").parquet(path)
    return path


def read_verdicts(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Kept and removed rows of ``write_verdicts``."""
    back = spark.read.schema(f"{schema}, _dedup {DEDUP}, kept boolean").parquet(path)
    return back.filter("kept"), back.filter("not kept")


_POINT = "struct<median_ms:double,actual_prompt_tokens:bigint>"
CURVE = f"struct<per_model:map<string,struct<role:string,by_length:map<string,{_POINT}>>>>"
FLAT = "struct<cascade_k1k2:map<string,struct<k1_ms:double,k2_ms:double>>>"


def curve_rows(df: DataFrame, doc: str, *keep: str) -> DataFrame:
    """Nested curve documents to one row per (model, target length)."""
    parsed = df.select(*keep, F.from_json(F.col(doc), CURVE).alias("d"))
    models = parsed.select(*keep, F.explode("d.per_model").alias("model", "spec"))
    points = models.select(*keep, "model", F.col("spec.role").alias("role"), F.explode("spec.by_length").alias("target", "p"))
    return points.select(*keep, "model", "role", F.col("target").cast("long").alias("target_tokens"),
                         F.col("p.actual_prompt_tokens").alias("actual_tokens"), F.col("p.median_ms").alias("median_ms"))


def pair_rows(df: DataFrame, doc: str, *keep: str) -> DataFrame:
    """The flat variant of a curve document: one (k1, k2) pair per first-stage model."""
    parsed = df.select(*keep, F.from_json(F.col(doc), FLAT).alias("d"))
    return parsed.select(*keep, F.explode("d.cascade_k1k2").alias("model", "k")).select(*keep, "model", "k.k1_ms", "k.k2_ms")


def list_or_text(doc: Column, path: str) -> Column:
    """A JSON field that is a list of lines or one string, as text."""
    v = F.parse_json(doc)
    lines = F.try_variant_get(v, path, "array<string>")
    return F.coalesce(F.array_join(lines, "\n"), F.try_variant_get(v, path, "string"), F.lit(""))


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write a costly intermediate once to the shared folder and read it back.

    Later steps prune columns from the written table, and a lost executor costs a re-read, not a
    recomputation.
    """
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_closely(df: DataFrame, tag: str) -> DataFrame:
    """As ``stored``, in two thirds of the bytes and somewhat more time: for texts."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
