"""The operators of this subpackage over their whole tables, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm.chat import neighbours, preference_pairs
from twinsieve.llm.decontam import contaminated
from twinsieve.llm.dialogue import damaged, repair_report
from twinsieve.llm.mixing import mix
from twinsieve.llm.quality import quality_rules
from twinsieve.llm.repeats import repeated_bytes, repeated_words
from twinsieve.llm.secrets import scan_secrets
from twinsieve.llm.shards import contiguous_shards
from twinsieve.llm.simhash import near_duplicates
from twinsieve.llm.tokenlinks import align_tokens
from twinsieve.llm.toxicity import fit_toxicity, score_toxicity
from twinsieve.llm.urls import judge_urls
from twinsieve.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@_query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


@_query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = contiguous_shards(table(spark, sf_dir, "documents"), 16)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@_query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


@_query
def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


@_query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@_query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(table(spark, sf_dir, "documents"))


@_query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference_pairs(neighbours(table(spark, sf_dir, "conversations")))
    flat = lambda m: F.array_join(F.transform(m, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return pairs.withColumns({c: flat(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


@_query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair_report(conversations, damaged(conversations))


@_query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


@_query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))[0]
