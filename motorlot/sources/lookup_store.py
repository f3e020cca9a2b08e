"""Tables stored for lookups by key: sorted files with Parquet bloom filters, so a lookup opens few row groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROW_GROUP_BYTES = 8 << 20


def write_lookup(rows: DataFrame, key: str, path: str, others: tuple[str, ...] = (), row_group_bytes: int = ROW_GROUP_BYTES,
                 by: Column | None = None, derived: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Store rows in key order, with bloom filters on the key and on ``others``, columns that are looked up as well.

    Row groups hold a range of keys each, so their bounds exclude most of them; the filter excludes the rest for a key that
    is not there, and all but a few for columns that are in no order. A key with very many rows is cut over files.

    Where stored columns follow from narrower ones, ``rows`` are those, ``by`` is the key as it follows from them and
    ``derived`` gives the stored columns row by row: they are made in the writing task and neither shuffled nor sorted.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(key) if by is None else by
    placed = rows.repartitionByRange(tasks, order).sortWithinPartitions(order)
    placed = derived(placed) if derived else placed
    writer = placed.write.mode("overwrite").option("parquet.block.size", row_group_bytes).option("compression", "zstd")
    for column in (key, *others):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


def lookup(spark: SparkSession, path: str, schema, column: str, value) -> DataFrame:
    """Rows with one value of a looked-up column."""
    return spark.read.schema(schema).parquet(path).where(F.col(column) == F.lit(value))
