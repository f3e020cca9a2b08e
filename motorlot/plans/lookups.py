"""Listings, searches and joined views."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from motorlot.functions.money import ratio
from motorlot.functions.scalar import age, elapsed_hours
from motorlot.operators.overlap import clip_days
from motorlot.plans.reports import completed
from motorlot.session import checkpointed


def full_name() -> Column:
    return F.concat_ws(" ", "first_name", "last_name")


def vehicle_name() -> Column:
    return F.concat_ws(" ", "make", "model")


def vehicle_info() -> Column:
    return F.concat(F.col("make"), F.lit(" "), F.col("model"), F.lit(" ("), F.col("model_year"), F.lit(")"))


def matches(columns: Sequence[Column], keyword: str) -> Column:
    """Case-blind substring test over several columns."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.contains(F.upper(c), F.lit(keyword.upper())), F.lit(False))
    return test


# ---- customers ---------------------------------------------------------------------------------

def with_derived(rentals: DataFrame) -> DataFrame:
    """Derived columns of a rental: days booked and miles driven."""
    return rentals.withColumns({
        "total_days": F.datediff("dropoff_date", "pickup_date"),
        "miles_driven": F.col("odometer_in") - F.col("odometer_out"),
    })


def customers_derived(customers: DataFrame, as_of: datetime) -> DataFrame:
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    return customers.withColumns({"full_name": full_name(), "age": age(F.col("date_of_birth"), now)})


def list_customers(customers: DataFrame, as_of: datetime, active_only: bool = True) -> DataFrame:
    rows = customers.where(F.col("is_active") == "Y") if active_only else customers
    return customers_derived(rows, as_of).select(
        "customer_id", "first_name", "last_name", "full_name", "email", "license_number", "license_expiry",
        "date_of_birth", "age", "loyalty_points", "is_active",
    ).orderBy("last_name", "first_name", "customer_id")


def customer_by_id(customers: DataFrame, as_of: datetime, customer_id: int) -> DataFrame:
    return list_customers(customers.where(F.col("customer_id") == customer_id), as_of, active_only=False)


def search_customers(customers: DataFrame, keyword: str, as_of: datetime) -> DataFrame:
    hit = matches([full_name(), F.col("email"), F.col("license_number")], keyword)
    return list_customers(customers.where(hit), as_of)


# ---- vehicles ----------------------------------------------------------------------------------

def effective_rate() -> Column:
    return F.coalesce("daily_override", "daily_rate")


def fleet(vehicles: DataFrame, categories: DataFrame, locations: DataFrame) -> DataFrame:
    """Vehicles in service with category, place (null when unplaced) and daily rate."""
    return _placed(vehicles.where(F.col("is_active") == "Y"), categories, locations)


def _placed(vehicles: DataFrame, categories: DataFrame, locations: DataFrame) -> DataFrame:
    places = locations.select("location_id", "location_name")
    return vehicles.join(
        categories.select("category_name", F.col("daily_rate").alias("category_rate")), "category_name"
    ).join(places, "location_id", "left").withColumn("daily_rate", F.coalesce("daily_override", "category_rate"))


FLEET_COLUMNS = ["vehicle_id", "category_name", "location_id", "location_name", "make", "model", "model_year", "color",
                 "license_plate", "mileage", "fuel_type", "transmission", "seats", "status", "daily_rate",
                 "daily_override", "last_service_date", "insurance_expiry"]


def available(vehicles, categories, locations, location: int | None = None, category: str | None = None) -> DataFrame:
    """Vehicles free to rent; a filter left out is no filter."""
    rows = vehicles.where(F.col("status") == "AVAILABLE")
    if location is not None:
        rows = rows.where(F.col("location_id") == location)
    if category is not None and category.strip():
        rows = rows.where(F.col("category_name") == category)
    return fleet(rows, categories, locations).select(*FLEET_COLUMNS).orderBy("category_name", "make", "model", "vehicle_id")


def search_vehicles(vehicles, categories, locations, keyword: str) -> DataFrame:
    hit = matches([F.col("make"), F.col("model"), F.col("license_plate")], keyword)
    return fleet(vehicles.where(hit), categories, locations).select(*FLEET_COLUMNS).orderBy("make", "model", "vehicle_id")


def vehicle_by_id(vehicles, categories, locations, vehicle_id: int) -> DataFrame:
    """One vehicle, in service or not."""
    return _placed(vehicles.where(F.col("vehicle_id") == vehicle_id), categories, locations).select(*FLEET_COLUMNS, "is_active")


def vehicle_availability(vehicles, categories, locations, as_of: datetime) -> DataFrame:
    """Fleet list with insurance state; an unknown expiry counts as valid."""
    lapsed = F.col("insurance_expiry") < F.lit(str(as_of)).cast("timestamp_ntz")
    return fleet(vehicles, categories, locations).select(
        "vehicle_id", "make", "model", "model_year", "license_plate", "color", "category_name", "daily_rate",
        "location_name", "status", "mileage", F.when(lapsed, "EXPIRED").otherwise("VALID").alias("insurance_status"),
        "last_service_date",
    )


# ---- rentals -----------------------------------------------------------------------------------

def _joined(rentals, customers, vehicles, locations, cars: Column) -> DataFrame:
    people = customers.select("customer_id", full_name().alias("customer_name"), F.col("email").alias("customer_email"))
    fleet_names = vehicles.select("vehicle_id", cars.alias("vehicle"), "license_plate")
    pick = locations.select(F.col("location_id").alias("pickup_location"), F.col("location_name").alias("pickup_location_name"))
    drop = locations.select(F.col("location_id").alias("dropoff_location"), F.col("location_name").alias("dropoff_location_name"))
    return (
        rentals.join(people, "customer_id").join(fleet_names, "vehicle_id")
        .join(pick, "pickup_location").join(drop, "dropoff_location")
    )


def active_rentals_view(rentals, customers, vehicles, locations, as_of: datetime) -> DataFrame:
    """Open rentals with customer, vehicle and both places, in no order."""
    rows = rentals.where(F.col("status") == "ACTIVE")
    return _joined(rows, customers, vehicles, locations, vehicle_name()).select(
        "rental_ref", "customer_id", "customer_name", "customer_email", "vehicle_id", "vehicle", "license_plate",
        "pickup_location", "pickup_location_name", "dropoff_location", "dropoff_location_name", "actual_pickup",
        elapsed_hours(F.col("actual_pickup"), as_of).alias("hours_out"), "odometer_out", "base_charge", "status",
    )


def list_active_rentals(rentals, customers, vehicles, locations, as_of: datetime) -> DataFrame:
    """The view, latest pickup first. The joined rows are stored before the sort, which reads them twice."""
    return checkpointed(active_rentals_view(rentals, customers, vehicles, locations, as_of)).orderBy(F.col("actual_pickup").desc(), "rental_ref")


def rental_by_id(rentals, customers, vehicles, locations, rental_id: int) -> DataFrame:
    """One rental. The id is made of order and line, so the scan is cut to that order first."""
    rows = rentals.where((F.col("order_id") == rental_id // 10) & (F.col("rental_id") == rental_id))
    return _joined(rows, customers, vehicles, locations, vehicle_info()).select(
        "rental_id", "rental_ref", "customer_id", "customer_name", "vehicle_id", F.col("vehicle").alias("vehicle_info"),
        "pickup_location_name", "dropoff_location_name", "actual_pickup", "actual_dropoff", "total_charge", "status",
    )


def overdue(rentals, customers, vehicles, locations, as_of: datetime, days: int = 3) -> DataFrame:
    """Open rentals picked up more than some days ago, with the hours since."""
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    late = (F.col("status") == "ACTIVE") & (F.col("actual_pickup") < now - F.make_dt_interval(F.lit(days)))
    return checkpointed(_joined(rentals.where(late), customers, vehicles, locations, vehicle_name()).select(
        "rental_ref", "customer_id", "customer_name", "vehicle_id", F.col("vehicle").alias("vehicle_info"),
        "license_plate", "pickup_location", "pickup_location_name", "dropoff_location", "dropoff_location_name",
        "actual_pickup", "odometer_out", "fuel_level_out", "base_charge", "status",
        elapsed_hours(F.col("actual_pickup"), as_of).alias("hours_overdue"),
    )).orderBy("actual_pickup", "rental_ref")


def active_rentals(rentals, customers, vehicles, location_id: int | None = None) -> DataFrame:
    """Open rentals, of one pickup place if given."""
    rows = rentals.where(F.col("status") == "ACTIVE")
    if location_id is not None:
        rows = rows.where(F.col("pickup_location") == location_id)
    return (
        rows.join(customers.select("customer_id", full_name().alias("customer_name")), "customer_id")
        .join(vehicles.select("vehicle_id", vehicle_info().alias("vehicle_info")), "vehicle_id")
        .select("rental_ref", "customer_name", "vehicle_info", F.col("actual_pickup").alias("pickup_date"), "total_charge")
    )


def latest_per_row(outer: DataFrame, inner: DataFrame, key: str, order: Sequence[str], columns: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Latest inner row of each outer row. The latest row is a per-key maximum, merged before the shuffle."""
    top = inner.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_top"))
    return outer.join(top, key, how).select(*outer.columns, *[F.col("_top")[c].alias(c) for c in columns])


def vehicle_utilization(vehicles, rentals, start: date, end: date) -> DataFrame:
    """Rented days of each vehicle in percent of a span; 0 for an empty span."""
    span = (end - start).days
    first, last = (F.lit(str(d)).cast("timestamp_ntz") for d in (start, end))
    if span <= 0:
        return vehicles.select("vehicle_id", F.lit(0).cast("decimal(18,2)").alias("utilization_pct"))
    used = completed(rentals).where((F.col("actual_pickup") < last) & (F.col("actual_dropoff") > first)).groupBy(
        "vehicle_id"
    ).agg(F.sum(clip_days(F.col("actual_pickup"), F.col("actual_dropoff"), start, end)).alias("days"))
    return vehicles.select("vehicle_id").join(used, "vehicle_id", "left").select(
        "vehicle_id", ratio(F.coalesce("days", F.lit(0)), F.lit(span), 100).alias("utilization_pct")
    )


def semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key occurs in another table."""
    return df.join(keys, on, "left_semi")


def predicate_mix(rentals: DataFrame) -> DataFrame:
    """Closed rentals of 1997 to 1999 that are undamaged or charged a late fee."""
    return rentals.where(
        ~F.col("status").isin("ACTIVE")
        & F.col("actual_dropoff").between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1999-12-31").cast("timestamp_ntz"))
        & (F.col("damage_notes").isNull() | (F.col("late_fee") > 1000))
    )
