"""Documents to training shards: quality rules, near-duplicates, benchmark passages, source mix, shards.

Every stage reads what its predecessor kept, written as Parquet. ``run`` writes to the shared folder named in
``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm.common import stored
from twinsieve.llm.decontam import clean_documents
from twinsieve.llm.mixing import mix
from twinsieve.llm.quality import quality_rules
from twinsieve.llm.shards import contiguous_shards
from twinsieve.llm.simhash import first_rows
from twinsieve.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def whole_rows(docs: DataFrame) -> DataFrame:
    """What the operators read, and the whole row in one column, so that no other column can get in the way."""
    return docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Rows are judged one by one, so repeated rows have one fate and an id, null or shared, decides nothing. A null or empty
    text has no words and goes; a long one is judged whole. The row travels in one column, so names of other columns
    cannot clash. An empty table stays empty.
    """
    return quality_rules(whole_rows(docs), carry="row").filter("kept").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest id, null ids last, then the first by text.

    Rows go by a number that is written beside them, so an id that is missing or comes twice decides nothing else.
    """
    rows = stored(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("number")), "pipeline-rows")
    stay = first_rows(rows.select("row.doc_id", "row.text", "number"))
    return rows.join(stay, "number", "left_semi").select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Judged by whole texts, row by row: repeated rows have one fate, null ids count for nothing, and null or empty texts hold
    nothing and stay. All columns are carried; only ``text`` is read. An empty table or benchmark takes nothing away.
    """
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; not at all, once, or up to three times.

    A null source is a source of its own. A null text has no words; such a row comes as often as its source is taken whole.
    Rows with one id and one text are taken together. The row travels in one column, so names of others cannot clash.
    """
    return mix(whole_rows(docs), carry="row").filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their place in it; columns of these names are replaced.

    Null ids come first, rows of one id by CRC of their text and then by place; equal rows stay separate rows. A null text
    counts as an empty one. An empty table stays empty.
    """
    own = [f"row.{c}" for c in docs.columns if c.lower() not in ("shard", "slot")]
    return contiguous_shards(whole_rows(docs), carry="row").select(*own, "shard", "slot")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality), ("near-duplicates", one_of_each_group), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded),
]

#: SimHash groups and retrieval by score are beyond plain SQL; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
