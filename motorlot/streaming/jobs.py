"""Streaming forms of the row triggers, over a folder that receives files.

Progress, state and what a sink has committed are Spark's own: the query checkpoint, the state store and the file sink's
log. A query that is started again with the same folder goes on where it stopped.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from motorlot.functions.money import mean
from motorlot.operators.changes import event_state, latest_vehicle_events, payment_audit
from motorlot.plans.reports import month_of
from motorlot.session import checkpointed

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(stream: DataFrame, path: str, mode: str, write=None) -> StreamingQuery:
    """Start over what has arrived; state is kept in RocksDB, on disk beside the heap. The query takes the setting along."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}_progress").trigger(availableNow=True)
    writer = writer.foreachBatch(write) if write else writer.format("parquet").option("path", path)
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows that a stream has written so far; none before its first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# ---- audit rows --------------------------------------------------------------------------------

AUDIT_SCHEMA = "table_name string, operation string, record_id long, old_values string, new_values string"


def stream_audit(changes: DataFrame, path: str) -> StreamingQuery:
    """Append an audit row for each payment change; the file sink counts every batch once."""
    return _start(payment_audit(changes), path, "append")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, AUDIT_SCHEMA)


# ---- vehicle state -----------------------------------------------------------------------------

def stream_vehicle_state(events: DataFrame, path: str) -> StreamingQuery:
    """Keep the last event and the last reading of each vehicle in the state store.

    A batch gives the new state of the vehicles it touches, in a folder of its number; the same batch run again writes the
    same folder again. Events may arrive in any order: the latest (time, sequence) wins, in a batch and over batches.
    """
    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return _start(latest_vehicle_events(events), path, "update", write)


def _state_schema(seq_type: str) -> str:
    mark = f"struct<happened_at:timestamp_ntz,seq:{seq_type}>"
    return f"vehicle_id long, last_at {mark}, last_event string, read_at {mark}, last_odometer long, batch long"


def vehicle_states(spark: SparkSession, path: str, seq_type: str = "string") -> DataFrame:
    """The state of each vehicle: what the last batch that touched it wrote."""
    rows = _stored(spark, path, _state_schema(seq_type))
    last = F.max_by(F.struct(*[c for c in rows.columns if c != "batch"]), "batch")
    return rows.groupBy(F.col("vehicle_id").alias("_id")).agg(last.alias("s"), F.max("batch").alias("batch")).select("s.*", "batch")


def compact_vehicle_state(spark: SparkSession, path: str, seq_type: str = "string") -> None:
    """Keep one row for each vehicle, in the folder of its last batch. For times when the stream does not run."""
    checkpointed(vehicle_states(spark, path, seq_type)).write.mode("overwrite").partitionBy("batch").parquet(path)


def read_vehicle_state(spark: SparkSession, path: str, vehicles: DataFrame, seq_type: str = "string") -> DataFrame:
    """Vehicles with the state of all batches so far."""
    last = vehicle_states(spark, path, seq_type).select("vehicle_id", "last_event", "last_odometer")
    return vehicles.join(last, "vehicle_id", "left").withColumns({
        "status": F.coalesce(event_state(F.col("last_event")), F.col("status")),
        "mileage": F.coalesce("last_odometer", "mileage"),
    }).select(*vehicles.columns)


# ---- monthly revenue ---------------------------------------------------------------------------

REVENUE_SCHEMA = "day timestamp_ntz, n long, charged long, total decimal(20,2), most decimal(10,2), least decimal(10,2)"


CLOCK_SCHEMA = "moment timestamp_ntz"


def tick(spark: SparkSession, folder: str, moment: datetime) -> None:
    """Tell a clock folder that no rental of an earlier drop-off is to come, beyond the lateness allowed."""
    spark.createDataFrame([(moment,)], CLOCK_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream_monthly_revenue(rentals: DataFrame, path: str, lateness: str = "7 days", clock: str | None = None) -> StreamingQuery:
    """Totals of each day, written once when the day can no longer change.

    The watermark follows the drop-off of all rentals, completed or not, and the moments of a ``clock`` folder, which close
    the last days of a feed that has paused or ended; it runs ``lateness`` behind the latest one, and a day is closed when
    it passes. A rental of a closed day comes too late: it is dropped and counted (``late_rows``). Rentals without a
    drop-off belong to no day. A query that has a clock keeps it when it is started again.
    """
    timed = rentals.select("actual_dropoff", "total_charge", "status")
    if clock:
        moments = rentals.sparkSession.readStream.schema(CLOCK_SCHEMA).parquet(clock)
        kinds = timed.schema
        timed = timed.unionByName(moments.select(F.col("moment").alias("actual_dropoff"), F.lit(None).cast(kinds["total_charge"].dataType).alias("total_charge"), F.lit("CLOCK").alias("status")))
    # A watermark needs a time with a zone; the session's is UTC.
    timed = timed.withColumn("_at", F.col("actual_dropoff").cast("timestamp")).withWatermark("_at", lateness)
    # Rentals that do not count are not filtered out: Spark would do that before the watermark sees their time.
    done = F.col("status") == "COMPLETED"
    charge = F.when(done, F.col("total_charge"))
    days = timed.groupBy(F.window("_at", "1 day").alias("w")).agg(
        F.count(F.when(done, 1)).alias("n"), F.count(charge).alias("charged"), F.sum(charge).cast("decimal(20,2)").alias("total"),
        F.max(charge).alias("most"), F.min(charge).alias("least"),
    ).where("n > 0")
    return _start(days.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "charged", "total", "most", "least"), path, "append")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query has dropped since its start because their day was closed; partial sums of a task count as one."""
    return sum(operator.numRowsDroppedByWatermark for progress in query.recentProgress for operator in progress.stateOperators)


def read_monthly_revenue(spark: SparkSession, path: str) -> DataFrame:
    """Closed days rolled up to months."""
    days = _stored(spark, path, REVENUE_SCHEMA)
    return days.groupBy(month_of("day").alias("revenue_month")).agg(
        F.sum("n").alias("rental_count"), F.sum("total").alias("total_revenue"),
        mean(F.sum("total"), F.sum("charged")).alias("avg_charge"), F.max("most").alias("max_charge"),
        F.min("least").alias("min_charge"),
    )
