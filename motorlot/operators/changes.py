"""Table changes as jobs from an old snapshot and a change set to a new snapshot."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from motorlot.operators.ordered import ordered_scan
from motorlot.operators.pricing import tier
from motorlot.session import TASK_ROWS


def _moment(value: datetime) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def assign_keys(df: DataFrame, order: Sequence[str], name: str, start: int, task_rows: int = TASK_ROWS,
                ranges: int | None = None) -> DataFrame:
    """Dense keys from ``start`` in the given order, whose last column must make it unique."""
    scan = ordered_scan(df, order[:-1] or order, order[-1:], ranks=False, task_rows=task_rows, ranges=ranges)
    return scan.withColumn(name, F.col("row_num") + (start - 1)).select(name, *[c for c in df.columns if c != name])


def merge_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], stamp: Mapping[str, Column] | None = None) -> DataFrame:
    """Source rows replace target rows of the same key and new keys are added; ``stamp`` columns mark both.

    A key that the source repeats fails the job, as it has no single new row.
    """
    stamp = dict(stamp or {})
    values = [c for c in target.columns if c not in keys]
    stamped = source.select(*keys, *[(stamp[c] if c in stamp else F.col(c)).alias(f"_new_{c}") for c in values])
    once = stamped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*[f"_new_{c}" for c in values])).alias("_new"))
    repeated = F.raise_error(F.concat(F.lit("repeated source key "), F.to_json(F.struct(*keys)))).cast("boolean")
    fresh = once.select(*keys, "_new.*", F.when(F.col("_n") == 1, F.lit(True)).otherwise(repeated).alias("_hit"))
    merged = target.join(fresh, list(keys), "full_outer")
    return merged.select(*keys, *[
        F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in values
    ])


def customer_stats(rentals: DataFrame) -> DataFrame:
    """Source rows of the customer statistics table."""
    return rentals.where(F.col("status") == "COMPLETED").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("rental_count"), F.sum("total_charge").alias("total_spend"),
        F.max("actual_pickup").alias("last_rental"),
    )


def bump_usage(promos: DataFrame, uses: DataFrame) -> DataFrame:
    """Raise the use count of each promotion by the number of uses; other codes in ``uses`` are ignored."""
    counts = uses.where(F.col("promo_code").isNotNull()).groupBy("promo_code").agg(F.count(F.lit(1)).alias("_n"))
    return promos.join(counts, "promo_code", "left").withColumn(
        "current_uses", F.col("current_uses") + F.coalesce("_n", F.lit(0))
    ).drop("_n")


def apply_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Fill missing values of an insert."""
    return df.withColumns({c: F.coalesce(F.col(c), value) for c, value in defaults.items()})


def vehicle_defaults() -> dict[str, Column]:
    """Insert defaults of a vehicle (fixed values)."""
    return {"mileage": F.lit(0).cast("long"), "fuel_type": F.lit("GASOLINE"), "transmission": F.lit("AUTOMATIC"),
            "seats": F.lit(5).cast("long"), "status": F.lit("AVAILABLE"), "is_active": F.lit("Y")}


def apply_updates(target: DataFrame, changes: DataFrame, key: str, columns: Sequence[str],
                  order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with the changed columns set, changes whose key is unknown). A null in a change sets null.

    Of several changes of a key the last in ``order`` wins, of equal ones the one with the largest values.
    """
    last = F.max_by(F.struct(*[F.col(c).alias(f"_new_{c}") for c in columns]), F.struct(*order, *columns))
    fresh = changes.groupBy(key).agg(last.alias("_new")).select(key, "_new.*", F.lit(True).alias("_hit"))
    after = target.join(fresh, key, "left").withColumns({
        c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns
    }).select(*target.columns)
    return after, changes.join(target.select(key), key, "left_anti")


def soft_delete(target: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    marks = ids.select(key).distinct().withColumn("_gone", F.lit(True))
    return target.join(marks, key, "left").withColumn(
        "is_active", F.when(F.col("_gone"), "N").otherwise(F.col("is_active"))
    ).select(*target.columns)


def delete_ids(target: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows left after deleting a list of keys."""
    return target.join(ids.select(key), key, "left_anti")


def delete_rentals(target: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows left, refused deletions). An active rental is never deleted."""
    listed = target.join(ids.select(key), key, "left_semi")
    active = F.col("status") == "ACTIVE"
    refused = listed.where(active).select(key, F.lit("ACTIVE_RENTAL").alias("reason"))
    gone = listed.where(~F.coalesce(active, F.lit(False))).select(key)
    return target.join(gone, key, "left_anti"), refused


def purge(log: DataFrame, as_of: datetime, days: int = 90, moment: str = "changed_at") -> DataFrame:
    """Rows not older than some days; an unknown time is kept."""
    cutoff = _moment(as_of) - F.make_dt_interval(F.lit(days))
    return log.where(F.col(moment).isNull() | (F.col(moment) >= cutoff))


# ---- audit -------------------------------------------------------------------------------------

def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Changes between two snapshots: key, operation, old and new row."""
    before = old.select(key, F.struct(*old.columns).alias("old"))
    after = new.select(key, F.struct(*new.columns).alias("new"))
    operation = (
        F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE")
        .when(~F.col("old").eqNullSafe(F.col("new")), "UPDATE")
    )
    changes = before.join(after, key, "full_outer").withColumn("operation", operation)
    return changes.where(F.col("operation").isNotNull()).select(key, "operation", "old", "new")


def number_text(column: Column) -> Column:
    """Decimal text without zeros at the end of its fraction; whole numbers keep theirs."""
    return F.regexp_replace(column.cast("string"), r"(?<=\.\d{0,40})0+$|\.0+$", "")


def _image(side: str, names: Mapping[str, str]) -> Column:
    # The labels amount, method and status are fixed values.
    parts = []
    for label, column in names.items():
        value = F.col(side)[column]
        shown = number_text(value) if column == "amount" else value
        parts.append(F.concat(F.lit(f"{label}="), F.coalesce(shown, F.lit(""))))
    return F.concat_ws(",", *parts)


def payment_audit(changes: DataFrame, key: str = "payment_id") -> DataFrame:
    """Audit rows of payment changes. An insert shows amount, method and status; an update amount and
    status on both sides; a delete amount and method."""
    amount, method, status = {"amount": "amount"}, {"method": "payment_method"}, {"status": "status"}
    op = F.col("operation")
    old = F.when(op == "UPDATE", _image("old", {**amount, **status})).when(op == "DELETE", _image("old", {**amount, **method}))
    new = F.when(op == "INSERT", _image("new", {**amount, **method, **status})).when(
        op == "UPDATE", _image("new", {**amount, **status}))
    return changes.select(
        F.lit("PAYMENTS").alias("table_name"), "operation", F.col(key).alias("record_id"),
        old.alias("old_values"), new.alias("new_values"),
    )


# ---- effects of events -------------------------------------------------------------------------

def latest_vehicle_events(events: DataFrame) -> DataFrame:
    """Last state and last odometer reading of each vehicle, merged before the shuffle."""
    when = F.struct("happened_at", "seq")
    returned = (F.col("event") == "COMPLETE") & F.col("odometer").isNotNull()
    return events.groupBy("vehicle_id").agg(
        F.max(when).alias("last_at"), F.max_by("event", when).alias("last_event"),
        F.max(F.when(returned, when)).alias("read_at"),
        F.max_by("odometer", F.when(returned, when)).alias("last_odometer"),
    )


# State a vehicle is in after an event (fixed values).
EVENT_STATE = {"START": "RENTED", "COMPLETE": "AVAILABLE", "MAINTENANCE": "MAINTENANCE"}


def event_state(event: Column) -> Column:
    result = None
    for name, state in EVENT_STATE.items():
        result = F.when(event == name, state) if result is None else result.when(event == name, state)
    return result


def apply_vehicle_events(vehicles: DataFrame, events: DataFrame) -> DataFrame:
    """Vehicles with the status of their last event and the mileage of their last return."""
    last = latest_vehicle_events(events).select("vehicle_id", "last_event", "last_odometer")
    return vehicles.join(last, "vehicle_id", "left").withColumns({
        "status": F.coalesce(event_state(F.col("last_event")), F.col("status")),
        "mileage": F.coalesce("last_odometer", "mileage"),
    }).select(*vehicles.columns)


def award_points(customers: DataFrame, settled: DataFrame) -> DataFrame:
    """One point per unit spent, rounded per rental, then the tier of the new points."""
    won = settled.where(F.col("status") == "COMPLETED").groupBy("customer_id").agg(
        F.sum(F.round(F.coalesce("total_charge", F.lit(0)), 0)).cast("long").alias("_won")
    )
    return customers.join(won, "customer_id", "left").withColumn(
        "loyalty_points", F.col("loyalty_points") + F.coalesce("_won", F.lit(0))
    ).withColumn("tier", tier(F.col("loyalty_points"))).drop("_won")


# ---- history -----------------------------------------------------------------------------------

def as_of(history: DataFrame, moment: datetime, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows as they were at a moment: the last change of each key, unless it is a delete."""
    seen = history.where(F.col("changed_at") <= _moment(moment))
    last = seen.groupBy(key).agg(
        F.max_by(F.struct("operation", "changed_at", *columns), F.struct("changed_at", "seq")).alias("last")
    )
    return last.where(F.col("last.operation") != "DELETE").select(
        key, *[F.col(f"last.{c}").alias(c) for c in columns], F.col("last.changed_at").alias("changed_at")
    )


def versions(history: DataFrame, key: str, start: datetime, end: datetime, columns: Sequence[str],
             task_rows: int = TASK_ROWS) -> DataFrame:
    """Versions that began in a span, with the time each was replaced (null for the current one)."""
    rows = history.select(key, "seq", "changed_at", "operation", *columns)
    next_change: dict[str, Callable] = {"version_end": lambda w: F.lead("changed_at").over(w)}
    scan = ordered_scan(rows, ["changed_at"], ["seq"], [key], neighbours=next_change, reach=1, ranks=False, task_rows=task_rows)
    return scan.where(F.col("changed_at").between(_moment(start), _moment(end))).select(
        key, *columns, F.col("changed_at").alias("version_start"), "version_end",
        F.substring("operation", 1, 1).alias("version_operation"),
    )
