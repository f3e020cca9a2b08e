"""Queries of this subpackage and their DuckDB check texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from motorlot.llm import alignment, decontamination, lines, minhash, mixing, quality, quality_rules, sharding, spelling, token_counts, url_rules, vectors, warc
from motorlot.llm.store import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_cover_tree(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(table(spark, folder, "embeddings"))


def op2_quality_votes(spark: SparkSession, folder: str) -> DataFrame:
    return quality.digest(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judged(spark, table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.digest(sharding.shuffled(table(spark, folder, "documents")))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derived(warc.responses(table(spark, folder, "pages")))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.digest(lines.deduped(table(spark, folder, "documents")))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.digest(table(spark, folder, "documents"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.scored(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.digest(quality_rules.judged(table(spark, folder, "documents")))


def queries() -> dict[str, Query]:
    own = (op1_cover_tree, op2_quality_votes, op3_url_rules, op4_sharding, op5_token_counts, op6_warc_derivatives, op7_decontamination, op8_minhash_near_dedup, op9_line_dedup, op10_mixing,
           op11_spelling_variants, op12_token_alignment, op13_quality_rules)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_cover_tree": vectors.SQL, "op3_url_rules": url_rules.SQL, "op7_decontamination": decontamination.SQL, "op9_line_dedup": lines.SQL, "op10_mixing": mixing.SQL, "op11_spelling_variants": spelling.SQL, "op13_quality_rules": quality_rules.SQL}
