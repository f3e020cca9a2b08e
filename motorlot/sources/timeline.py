"""A history stored as snapshots by period with the changes behind them, for reads of a past state."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from motorlot.operators.changes import as_of
from motorlot.operators.ordered import ordered_scan

EPOCH = date(1970, 1, 1)


def period_of(moment: Column, days: int) -> Column:
    return F.floor(F.datediff(F.to_date(moment), F.lit(EPOCH.isoformat()).cast("date")) / days).cast("int")


def write_timeline(history: DataFrame, path: str, key: str, columns: Sequence[str], days: int = 7) -> None:
    """Store a history (key, seq, changed_at, operation, columns) by periods of ``days``.

    ``changes/period=p`` has the changes of the period, ``snapshots/period=p`` the rows that are there when it begins.
    A version belongs to the snapshots of all periods that begin while it holds; deleted rows belong to none. The next
    change of a row comes from an ordered scan, so a row with very many changes is cut into ranges.
    """
    rows = history.select(key, "seq", "changed_at", "operation", *columns)
    rows.withColumn("period", period_of(F.col("changed_at"), days)).hint("rebalance", F.col("period")).write.mode("overwrite").partitionBy("period").parquet(f"{path}/changes")
    # The last period is stored beside the folders, so that a read need not open them to learn it.
    rows.agg(F.max(period_of(F.col("changed_at"), days)).alias("period")).coalesce(1).write.mode("overwrite").parquet(f"{path}/last")
    last = rows.sparkSession.read.parquet(f"{path}/last").first()["period"]
    follow = {"_until": lambda w: F.lead("changed_at").over(w)}
    held = ordered_scan(rows, ["changed_at"], ["seq"], [key], neighbours=follow, reach=1, ranks=False)
    held = held.select(key, "seq", "changed_at", "operation", *columns, (period_of(F.col("changed_at"), days) + 1).alias("_first"),
                       F.least(F.coalesce(period_of(F.col("_until") - F.expr("interval 1 microsecond"), days), F.lit(last)) , F.lit(last)).alias("_last"))
    held = held.where((F.col("operation") != "DELETE") & (F.col("_first") <= F.col("_last")))
    periods = held.select(key, "seq", "changed_at", "operation", *columns, F.explode(F.sequence("_first", "_last")).alias("period"))
    periods.hint("rebalance", F.col("period")).write.mode("overwrite").partitionBy("period").parquet(f"{path}/snapshots")


def stored_as_of(spark: SparkSession, path: str, schema, moment: datetime, key: str, columns: Sequence[str], days: int = 7) -> DataFrame:
    """Rows as they were at a moment: one snapshot and the changes of its period up to the moment.

    ``schema`` is that of the stored history. The period is a constant, so other folders are not opened. A moment after
    the last period reads the state at its end.
    """
    kind = spark.createDataFrame([], schema).select(key, "seq", "changed_at", "operation", *columns).schema.add("period", "integer")
    period = (moment.date() - EPOCH).days // days
    snapshots, changes = spark.read.schema(kind).parquet(f"{path}/snapshots"), spark.read.schema(kind).parquet(f"{path}/changes")
    newest = spark.read.schema("period int").parquet(f"{path}/last").first()["period"]
    period = period if newest is None else min(period, newest)
    parts = [part.where(F.col("period") == period) for part in (snapshots, changes)]
    return as_of(parts[0].unionByName(parts[1]), moment, key, columns)


def period_start(period: int, days: int = 7) -> date:
    return EPOCH + timedelta(days=period * days)
