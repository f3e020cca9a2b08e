"""Substring search by an index of three-letter pieces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SIZE = 3


def grams(text: Column) -> Column:
    """Different pieces of SIZE characters of the upper-cased text; none for null and shorter texts."""
    upper = F.upper(text)
    starts = F.sequence(F.lit(1), F.greatest(F.length(upper) - (SIZE - 1), F.lit(1)))
    return F.when(F.length(upper) >= SIZE, F.array_distinct(F.transform(starts, lambda i: F.substring(upper, i, F.lit(SIZE))))).otherwise(F.array().cast("array<string>"))


def write_index(rows: DataFrame, key: str, columns: Sequence[Column], path: str) -> None:
    """Store the postings (gram, key) of the texts, sorted by gram so that a search opens few row groups, and their counts.

    A gram that stands in very many rows is cut over files by its keys.
    """
    spark = rows.sparkSession
    postings = rows.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.flatten(F.array(*[grams(c) for c in columns])))).alias("gram"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings.repartitionByRange(tasks, "gram", "key").sortWithinPartitions("gram", "key").write.mode("overwrite").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    counts = stored.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange(tasks, "gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")


def keyword_grams(keyword: str) -> list[str]:
    upper = keyword.upper()
    return sorted({upper[i:i + SIZE] for i in range(len(upper) - SIZE + 1)})


def candidates(spark: SparkSession, path: str, keyword: str) -> DataFrame | None:
    """(key) of the rows whose texts hold every gram of the keyword; None for a keyword shorter than a gram.

    Only postings of these grams are read. Lists are met from the rarest on, so each step keeps at most what the rarest
    list holds; a gram that stands nowhere ends the search.
    """
    wanted = keyword_grams(keyword)
    if not wanted:
        return None
    counts = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(wanted)).collect()}
    postings = spark.read.parquet(f"{path}/postings")
    if len(counts) < len(wanted):
        return postings.select("key").limit(0)
    by_rarity = sorted(wanted, key=lambda g: (counts[g], g))
    lists = [postings.where(F.col("gram") == g).select("key") for g in by_rarity]
    met = lists[0]
    for further in lists[1:]:
        met = met.join(further, "key", "left_semi")
    return met


def indexed(rows: DataFrame, key: str, path: str, keyword: str) -> DataFrame:
    """Rows that may hold the keyword, for a search to verify; all rows for a keyword too short for the index."""
    found = candidates(rows.sparkSession, path, keyword)
    return rows if found is None else rows.join(found.withColumnRenamed("key", key), key, "left_semi")
