"""Typed scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from motorlot.sources.schemas import REQUIREMENT, schema_of


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Parquet scan with a declared schema, so nothing is inferred and unused columns are not read."""
    return spark.read.schema(schema_of(table)).parquet(f"{folder}/{table}.parquet")


def load_stream(spark: SparkSession, folder: str, table: str, files_per_batch: int | None = None) -> DataFrame:
    """The same scan as a stream: over the files that a table's folder holds and receives, or over the one file of a table."""
    path = f"{folder}/{table}.parquet"
    # A stream takes folders and patterns only, so a single file is named by a pattern that no other name meets.
    files = load(spark, folder, table).inputFiles()
    single = len(files) == 1 and files[0].endswith(f"/{table}.parquet")
    reader = spark.readStream.schema(schema_of(table))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{table}.parque[t]" if single else path)


def load_requirements(spark: SparkSession, path: str) -> DataFrame:
    """One row per requirement from a folder of linked-data documents."""
    documents = spark.read.schema(f"hasRequirement array<struct<{REQUIREMENT_FIELDS}>>").option(
        "multiLine", True
    ).json(path)
    return (
        documents.select(F.inline("hasRequirement"))
        .withColumnRenamed("@id", "id").withColumnRenamed("@type", "type")
    )


REQUIREMENT_FIELDS = REQUIREMENT.replace(" string", ":string").replace(" array", ":array")


def flat_json_map(df: DataFrame, column: str, name: str) -> DataFrame:
    """Flat JSON text as a string map without its JSON nulls."""
    parsed = F.from_json(F.col(column), "map<string,string>")
    return df.withColumn(name, F.map_filter(parsed, lambda key, value: value.isNotNull()))
