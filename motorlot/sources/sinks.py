"""Partitioned writes, refreshed summaries, text forms of rows, calendars and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from motorlot.plans.reports import monthly_summary

# Model-year cuts and payment-method groups of the stored tables.
MODEL_YEAR_CUTS = {"legacy": 2015, "mid": 2020, "recent": 2024}
MODEL_YEAR_OPEN = "current"
PAYMENT_GROUPS = {
    "card": ("CREDIT_CARD", "DEBIT_CARD"), "cash": ("CASH",), "other": ("BANK_TRANSFER", "DIGITAL_WALLET"),
}


def range_bucket(column: str, cuts: Mapping[str, int] = MODEL_YEAR_CUTS, rest: str = MODEL_YEAR_OPEN) -> Column:
    """Name of the first bucket whose upper cut lies above the value."""
    result = None
    for name, cut in cuts.items():
        test = F.col(column) < cut
        result = F.when(test, name) if result is None else result.when(test, name)
    return result.otherwise(rest)


def month_bucket(column: str) -> Column:
    return F.date_format(column, "yyyy-MM")


def list_bucket(column: str, groups: Mapping[str, Sequence[str]] = PAYMENT_GROUPS) -> Column:
    result = None
    for name, values in groups.items():
        test = F.col(column).isin(list(values))
        result = F.when(test, name) if result is None else result.when(test, name)
    return result


def write_partitioned(df: DataFrame, bucket: Column, path: str, name: str = "bucket") -> None:
    """Write one folder per bucket. A rebalance by bucket splits large buckets into tasks of the advisory size."""
    df.withColumn(name, bucket).hint("rebalance", F.col(name)).write.mode("overwrite").partitionBy(name).parquet(path)


def buckets_between(low: int, high: int, cuts: Mapping[str, int] = MODEL_YEAR_CUTS, rest: str = MODEL_YEAR_OPEN) -> list[str]:
    """Names of the range buckets that can hold values from low to high."""
    names, floor = [], None
    for name, cut in [*cuts.items(), (rest, None)]:
        if (cut is None or low < cut) and (floor is None or high >= floor):
            names.append(name)
        floor = cut
    return names


def read_range(spark: SparkSession, path: str, schema, column: str, low: int, high: int, name: str = "bucket") -> DataFrame:
    """Rows of a range-partitioned table between two values; other buckets are not listed for reading.

    A filter on the value alone would read every bucket, since the bucket is derived from it.
    """
    table = spark.read.schema(schema).parquet(path)
    return table.where(F.col(name).isin(buckets_between(low, high)) & F.col(column).between(low, high)).drop(name)


def bucket_counts(df: DataFrame, bucket: Column) -> DataFrame:
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))


def refresh_monthly_revenue(rentals: DataFrame, path: str) -> DataFrame:
    """Rewrite the monthly revenue table and return it as stored."""
    summary = monthly_summary(rentals)
    # A few rows per year: one file is enough. The aggregate itself keeps its tasks.
    summary.repartition(1).write.mode("overwrite").parquet(path)
    return rentals.sparkSession.read.schema(summary.schema).parquet(path)


def write_revenue_months(rentals: DataFrame, path: str) -> None:
    """Store the monthly revenue table with a folder for each month."""
    _monthly(rentals).write.mode("overwrite").partitionBy("month").parquet(path)


def _monthly(rentals: DataFrame) -> DataFrame:
    return monthly_summary(rentals).withColumn("month", month_bucket("revenue_month"))


def refresh_revenue_months(rentals: DataFrame, changes: DataFrame, path: str) -> None:
    """Work out again only the months that a change set touches, and overwrite only their folders.

    ``changes`` has ``actual_dropoff`` of the changed rentals, before and after the change; ``rentals`` is the table after
    it. A touched month without rentals left is written with a count of 0, which readers leave out.
    """
    touched = changes.select(F.trunc("actual_dropoff", "MM").alias("_month")).where("_month is not null").distinct()
    rows = rentals.withColumn("_month", F.trunc("actual_dropoff", "MM")).join(touched, "_month", "left_semi").drop("_month")
    summary = _monthly(rows)
    empty = touched.select(F.col("_month").alias("revenue_month"), month_bucket("_month").alias("month")).join(summary, "month", "left_anti")
    out = summary.unionByName(empty.withColumn("rental_count", F.lit(0).cast(summary.schema["rental_count"].dataType)), allowMissingColumns=True)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def read_revenue_months(rentals: DataFrame, path: str) -> DataFrame:
    """The stored months; the types are those that a summary of ``rentals`` has."""
    return rentals.sparkSession.read.schema(_monthly(rentals).schema).parquet(path).where("rental_count > 0").drop("month")


def rows_to_json(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rows as JSON objects; nulls stay, dates and times have fixed formats."""
    fields = F.struct(*[F.col(c).alias(n) for c, n in names.items()])
    options = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "dateFormat": "yyyy-MM-dd", "ignoreNullFields": "false"}
    return df.select(F.to_json(fields, options).alias("json"))


def json_object(df: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """Key column and a JSON object built from named columns."""
    fields = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    return df.select(key, F.to_json(fields, {"ignoreNullFields": "false"}).alias("object"))


def xml_escaped(column: Column) -> Column:
    value = column.cast("string")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(raw), F.lit(entity))
    return value


def xml_element(tag: str, *content: Column, attributes: Mapping[str, Column] | None = None) -> Column:
    """Compact element text; null content leaves the element empty, a null attribute is left out."""
    opening = [F.lit(f"<{tag}")]
    for name, value in (attributes or {}).items():
        quoted = F.replace(xml_escaped(value), F.lit('"'), F.lit("&quot;"))
        opening.append(F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), quoted, F.lit('"'))))
    return F.concat_ws("", *opening, F.lit(">"), *content, F.lit(f"</{tag}>"))


def rows_to_xml(rentals: DataFrame, key: str = "rental_id") -> DataFrame:
    """Each rental as an element with an id and four children."""
    children = {"customer": "customer_id", "vehicle": "vehicle_id", "amount": "total_charge", "status": "status"}
    parts = [xml_element(tag, xml_escaped(F.col(c))) for tag, c in children.items()]
    return rentals.select(key, xml_element("rental", *parts, attributes={"id": F.col(key)}).alias("rental_xml"))


def date_series(spark: SparkSession, start: date, days: int) -> DataFrame:
    """Calendar rows from a start day."""
    first = F.lit(start.isoformat()).cast("date")
    calendar = spark.range(1).select(F.explode(F.sequence(first, F.date_add(first, days - 1))).alias("rental_date"))
    return calendar.withColumn("day_name", F.upper(F.date_format("rental_date", "EEE")))


def daily_counts(rentals: DataFrame, start: date, days: int) -> DataFrame:
    """Pickups of each calendar day, zero where there are none."""
    calendar = date_series(rentals.sparkSession, start, days)
    last = F.date_add(F.lit(start.isoformat()).cast("date"), days)
    counts = rentals.where(
        (F.to_date("actual_pickup") >= F.lit(start.isoformat()).cast("date")) & (F.to_date("actual_pickup") < last)
    ).groupBy(F.to_date("actual_pickup").alias("rental_date")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(counts, "rental_date", "left").select(
        "rental_date", "day_name", F.coalesce("n", F.lit(0)).alias("pickups")
    ).orderBy("rental_date")


def drawn(key: Column, percent: float, seed: int) -> Column:
    """Whether a key is drawn: the first seven hex digits of the md5 of seed and key, as a share of their range."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 7)
    return F.conv(digits, 16, 10).cast("long") < F.lit(int(percent / 100 * 16**7))


def sample_rows(df: DataFrame, key: str, percent: float, seed: int = 42) -> DataFrame:
    """Random share of the rows, drawn by a hash of the key: the same rows on every cluster and file layout."""
    return df.where(drawn(F.col(key), percent, seed))


def sample_blocks(df: DataFrame, key: str, percent: float, block_rows: int = 1000, seed: int = 42) -> DataFrame:
    """Random share of blocks: runs of ``block_rows`` neighbouring key values are kept or left out together.

    A block is its number, not a place in a file, so a moved or rewritten table gives the same sample.
    """
    return df.where(drawn(F.floor(F.col(key) / block_rows), percent, seed))
