"""Corpus pipeline: quality, near duplicates, benchmark passages, mixture, shards. Each stage takes what the last kept.

Every stage takes an empty table to an empty one and hands on all columns of its input under their names; columns that
clash with those an operator makes for itself do no harm. Texts are read whole, however long.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from motorlot.llm import decontamination, minhash, mixing, quality, sharding
from motorlot.llm.store import table
from motorlot.session import checkpoint_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes; it learns from the labelled documents of the stage's own input.

    Null and empty texts are scored like others; repeated rows are judged alike, and so are rows with a null id, from
    which nothing is learnt. Without any usable label every row has score 0.5 and stays.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id.

    Rows without words (null, empty, blank texts) are in no group and stay, but equal rows of one id stay once. A row
    without an id stays only where its group has no id; several such are decided by their text.
    """
    return minhash.representatives(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and empty texts hold none and stay; repeated rows stay as often as they are there; items without words are none.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them.

    A null source is a source of its own; null and empty texts follow their source's rate, and a source without any word
    is taken once. Rows of one id draw alike, rows without an id by their text.
    """
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in random order with their shard and slot.

    Rows with null ids or texts and repeated rows are dealt like others. Columns `shard` and `slot` of the input give way.
    """
    return sharding.shuffled(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_text),
    ("mixing to target weights", mix_sources),
    ("sharding", shard),
]

# The stages score by numeric models and random orders that DuckDB has no equal for; tests/llm holds them to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each result is written under the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        folder = f"{checkpoint_dir(spark).rstrip('/')}/stage-{k}-{uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
