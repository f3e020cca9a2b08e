"""Registered queries: each binds library functions to the stored tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from motorlot.functions import scalar as S
from motorlot.operators import changes as J, checks as C, digests, hierarchy as H, overlap as O, pricing as P, rentals as Q, tours, trigrams
from motorlot.plans import lookups as L, reports as R, sql_api
from motorlot.session import checkpoint_dir
from motorlot.sources import adapter as A, loaders, lookup_store, sinks as K, timeline
from motorlot.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = datetime(2001, 7, 15)
SPAN = (date(1997, 1, 1), date(1997, 12, 31))
MONTHS = [f"1997-0{m}" for m in range(1, 7)]
# After every stored rental: the feed is complete and all its days may close.
END_OF_FEED = datetime(2100, 1, 1)
FORECAST_MONTHS = ["2001-05", "2001-06", "2001-07"]


def plain_types(df: DataFrame) -> DataFrame:
    """Money as doubles, whole numbers as longs and days as timestamps, as the check texts give them."""
    columns = []
    for field in df.schema.fields:
        name = f"`{field.name}`"
        if isinstance(field.dataType, T.DecimalType):
            columns.append(f"cast({name} as double) as {name}")
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            columns.append(f"cast({name} as bigint) as {name}")
        elif isinstance(field.dataType, T.DateType):
            columns.append(f"cast({name} as timestamp_ntz) as {name}")
        else:
            columns.append(name)
    return df.selectExpr(*columns)


def report_queries() -> dict[str, Query]:
    done = "COMPLETED"
    return {
        "dashboard_stats": lambda s, d: R.dashboard_stats(A.order_rentals(s, d), AS_OF),
        "monthly_revenue_snapshot": lambda s, d: R.monthly_summary(A.rentals(s, d, done)),
        "repeat_customers": lambda s, d: R.repeat_customers(A.customers(s, d), A.order_rentals(s, d)),
        "revenue_report": lambda s, d: R.revenue_report(A.rentals(s, d, done), *SPAN),
        "revenue_by_month": lambda s, d: R.revenue_by_month(A.rentals(s, d, done), *SPAN),
        "revenue_rollup": lambda s, d: R.revenue_rollup(A.rentals(s, d, done), A.vehicles(s, d), A.locations(s, d)),
        "customers_rollup": lambda s, d: R.customers_rollup(A.with_customer(A.rentals(s, d, done), s, d), A.vehicles(s, d), A.locations(s, d)),
        "revenue_grouping_sets": lambda s, d: R.revenue_grouping_sets(
            A.rentals(s, d, done), A.vehicles(s, d), A.locations(s, d),
            [["location_name", "category_name"], ["month"], []]),
        "revenue_cube": lambda s, d: R.revenue_cube(A.rentals(s, d, done), A.vehicles(s, d)),
        "pivot_monthly": lambda s, d: R.pivot_monthly(A.rentals(s, d, done), A.vehicles(s, d), MONTHS),
        "pivot_conditional": lambda s, d: R.pivot_conditional(A.rentals(s, d, done), A.vehicles(s, d), MONTHS),
        "unpivot_charges": lambda s, d: R.unpivot_charges(A.rentals(s, d), ["rental_ref"]),
        "unpivot_first": lambda s, d: R.unpivot_first(A.rentals(s, d), 10, ["rental_id", "rental_ref"]),
        "customer_spend_rank": lambda s, d: R.customer_spend_rank(A.customers(s, d), A.order_rentals(s, d, done)),
        "top_vehicles_by_category": lambda s, d: R.top_vehicles_by_category(A.rentals(s, d, done), A.vehicles(s, d)),
        "top_n_with_ties": lambda s, d: R.top_vehicles(A.rentals(s, d, done), A.vehicles(s, d)),
        "page_rownum": lambda s, d: R.numbered_page(
            R.completed(A.order_rentals(s, d, done)).select("rental_id", "customer_id", "total_charge"),
            "total_charge", "rental_id", 11, 20),
        "page_offset": lambda s, d: R.page(
            R.completed(A.order_rentals(s, d, done)).select("rental_id", "customer_id", "total_charge"),
            "total_charge", "rental_id", 10, 10),
        "vehicle_profitability": lambda s, d: R.vehicle_profitability(
            A.vehicles(s, d), A.rentals(s, d, done), A.maintenance(s, d)),
        "cohort_ltv": lambda s, d: R.cohort_ltv(A.order_rentals(s, d)),
        "revenue_dashboard": lambda s, d: R.revenue_dashboard(A.rentals(s, d, done)),
        "period_growth": lambda s, d: R.period_growth(A.rentals(s, d, done)),
        "revenue_forecast": lambda s, d: R.revenue_forecast(A.order_rentals(s, d, done), FORECAST_MONTHS),
        "kpi_summary": lambda s, d: R.kpi_summary(A.order_rentals(s, d), A.vehicles(s, d), A.customers(s, d), AS_OF),
        "running_totals": lambda s, d: R.running_totals(A.order_rentals(s, d, done)),
        "charge_distribution": lambda s, d: R.charge_distribution(A.order_rentals(s, d, done)),
        "location_cumulative": lambda s, d: R.location_cumulative(A.rentals(s, d, done), A.locations(s, d)),
        "customer_history": lambda s, d: R.customer_history(
            A.with_customer(A.rentals(s, d, done), s, d), A.vehicles(s, d), key="rental_ref"),
        # The same reports by ranges, the way of groups too large for a task.
        "customer_spend_rank_ranged": lambda s, d: R.customer_spend_rank(
            A.customers(s, d), A.order_rentals(s, d, done), task_rows=100),
        "running_totals_ranged": lambda s, d: R.running_totals(A.order_rentals(s, d, done), task_rows=1000),
        "charge_distribution_ranged": lambda s, d: R.charge_distribution(A.order_rentals(s, d, done), task_rows=1000),
        "customer_history_ranged": lambda s, d: R.customer_history(
            A.with_customer(A.rentals(s, d, done), s, d), A.vehicles(s, d), key="rental_ref", task_rows=10),
        "listagg_ids": lambda s, d: R.listagg(A.order_rentals(s, d), "customer_id", "rental_id", ","),
        "listagg_dates": lambda s, d: R.dates_listed(A.order_rentals(s, d), "customer_id", "actual_pickup", " | "),
        "features_listagg": lambda s, d: R.features_listed(A.vehicles(s, d)),
        "features_unnest": lambda s, d: R.unnest(A.vehicles(s, d), "features", "feature", ["vehicle_id"]),
    }


def _booked(s: SparkSession, d: str, status: str | None = None) -> DataFrame:
    return A.with_customer(A.rentals(s, d, status), s, d)


def _view(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return A.customers(s, d), A.vehicles(s, d), A.locations(s, d)


def _fleet(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return A.vehicles(s, d), A.categories(s, d), A.locations(s, d)


def _latest(s: SparkSession, d: str, how: str) -> DataFrame:
    cars = A.vehicles(s, d)
    if how == "left":
        cars = cars.where(F.col("is_active") == "Y")
    return L.latest_per_row(
        cars.select("vehicle_id", "make", "model"), R.completed(A.rentals(s, d, "COMPLETED")), "vehicle_id",
        ["actual_dropoff", "rental_ref"], ["rental_ref", "total_charge", "actual_dropoff"], how)


def _rule_violations(s: SparkSession, d: str) -> DataFrame:
    rules = {
        **C.rental_rules(),
        "base_charge_limit": F.col("base_charge") <= 90000,
        "fuel_in_minimum": C.within("fuel_level_in", 70, 100),
        "notes_length": C.at_most_long("damage_notes", 5),
        "late_fee_present": C.present("late_fee"),
    }
    return C.check_rules(A.rentals(s, d), rules, ["rental_ref"])


def _folder(s: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(s)}/{name}/{uuid4().hex}"


def _partitioned(s: SparkSession, d: str) -> DataFrame:
    """Vehicles written by model-year bucket and read back for a span of years."""
    cars, path = A.vehicles(s, d).select("vehicle_id", "make", "model_year", "status"), _folder(s, "by_year")
    K.write_partitioned(cars, K.range_bucket("model_year"), path)
    return K.read_range(s, path, cars.schema.add("bucket", "string"), "model_year", 2016, 2021)


def _sql(s: SparkSession, d: str, text: str) -> DataFrame:
    sql_api.register(s, {"rentals": _booked(s, d), "customers": A.customers(s, d), "vehicles": A.vehicles(s, d)})
    return s.sql(text)


JSON_NAMES = {
    "rental_ref": "rentalRef", "vehicle_id": "vehicleId", "actual_pickup": "actualPickup", "pickup_date": "pickupDate",
    "odometer_in": "odometerIn", "base_charge": "baseCharge", "total_charge": "totalCharge", "status": "status",
}


def lookup_queries() -> dict[str, Query]:
    done = "COMPLETED"
    return {
        "projection_concat": lambda s, d: A.vehicles(s, d).select("vehicle_id", L.vehicle_info().alias("vehicle")),
        "derived_columns": lambda s, d: L.with_derived(A.rentals(s, d)).select(
            "rental_ref", "total_days", "miles_driven"),
        "customer_derived_columns": lambda s, d: L.customers_derived(A.customers(s, d), AS_OF).select(
            "customer_id", "full_name", "age", F.col("address.city").alias("city")),
        "predicate_mix": lambda s, d: L.predicate_mix(A.rentals(s, d)).select("rental_ref", "status", "actual_dropoff"),
        "search_customers": lambda s, d: L.search_customers(A.customers(s, d), "0001", AS_OF),
        "search_customers_indexed": _indexed_customers,
        "search_vehicles_indexed": _indexed_vehicles,
        "search_vehicles": lambda s, d: L.search_vehicles(*_fleet(s, d), "RiNg"),
        "available_vehicles": lambda s, d: L.available(*_fleet(s, d), location=4, category="ECONOMY"),
        "available_vehicles_all": lambda s, d: L.available(*_fleet(s, d)),
        "rental_by_id_stored": lambda s, d: _stored_rental(s, d, 13),
        "rental_by_id": lambda s, d: L.rental_by_id(_booked(s, d), *_view(s, d), 13),
        "vehicle_by_id": lambda s, d: L.vehicle_by_id(*_fleet(s, d), 13),
        "customer_by_id": lambda s, d: L.customer_by_id(A.customers(s, d), AS_OF, 20),
        "list_customers_all": lambda s, d: L.list_customers(A.customers(s, d), AS_OF, active_only=False),
        "rule_violations": _rule_violations,
        "duplicate_keys": lambda s, d: C.check_unique(A.rentals(s, d), ["order_id", "line_number"]),
        "vehicle_availability": lambda s, d: L.vehicle_availability(*_fleet(s, d), AS_OF),
        "list_customers": lambda s, d: L.list_customers(A.customers(s, d), AS_OF),
        "active_rentals_view": lambda s, d: L.active_rentals_view(_booked(s, d, "ACTIVE"), *_view(s, d), AS_OF),
        "list_active_rentals": lambda s, d: L.list_active_rentals(_booked(s, d, "ACTIVE"), *_view(s, d), AS_OF),
        "active_rentals_tvf": lambda s, d: L.active_rentals(
            _booked(s, d, "ACTIVE"), A.customers(s, d), A.vehicles(s, d), 3),
        "overdue_rentals": lambda s, d: L.overdue(_booked(s, d, "ACTIVE"), *_view(s, d), AS_OF),
        "overlapping_bookings": lambda s, d: O.clash_counts(
            A.rentals(s, d), "vehicle_id", "pickup_date", "dropoff_date").select("rental_ref", "vehicle_id", "clashes"),
        "first_blocking_booking": lambda s, d: O.first_blocker(
            A.requests(s, d), A.rentals(s, d).where(F.col("status") != "ACTIVE").select("vehicle_id", F.col("rental_ref").alias("held"), F.col("pickup_date").alias("held_from"), F.col("dropoff_date").alias("held_to")),
            "vehicle_id", "pickup_date", "dropoff_date", "held", "held_from", "held_to").select("rental_ref", "vehicle_id", "blocker", "blocker_start"),
        "overlapping_span": lambda s, d: O.overlapping_span(
            A.rentals(s, d), date(1998, 6, 1), date(1998, 6, 30), "pickup_date", "dropoff_date").select(
            "rental_ref", "vehicle_id", "pickup_date", "dropoff_date"),
        "vehicle_utilization": lambda s, d: L.vehicle_utilization(A.vehicles(s, d), A.rentals(s, d, done), *SPAN),
        "latest_rental_lateral": lambda s, d: _latest(s, d, "inner"),
        "latest_rental_left_lateral": lambda s, d: _latest(s, d, "left"),
        "semi_join_in": lambda s, d: L.semi(
            A.customers(s, d).select("customer_id", "email"),
            A.order_rentals(s, d).where(F.col("total_charge") > 400000), "customer_id"),
        "orphan_keys": lambda s, d: C.orphans(
            A.maintenance(s, d), A.vehicles(s, d).where(F.col("is_active") == "Y"), "vehicle_id", "vehicle_id"),
        "conditional_functions": lambda s, d: S.conditional_functions(A.rentals(s, d), ["rental_ref"]),
        "numeric_functions": lambda s, d: S.numeric_functions(A.rentals(s, d), ["rental_ref"]),
        "date_functions": lambda s, d: S.date_functions(A.rentals(s, d, done), ["rental_ref"], AS_OF),
        "string_functions": lambda s, d: S.string_functions(A.customers(s, d)),
        "regex_functions": lambda s, d: S.regex_functions(A.customers(s, d)),
        "currency_convert": lambda s, d: S.currency_convert(A.payments(s, d)),
        "json_flat_map": lambda s, d: loaders.flat_json_map(loaders.load(s, d, "events"), "props", "fields").select(
            "event_id", F.explode("fields").alias("key", "value")),
        "json_rows": lambda s, d: K.rows_to_json(A.rentals(s, d), JSON_NAMES),
        "json_object": lambda s, d: K.json_object(A.rentals(s, d), "rental_ref", {"id": "rental_ref", "status": "status"}),
        "xml_element": lambda s, d: K.rows_to_xml(_booked(s, d), "rental_ref"),
        "date_series": lambda s, d: K.daily_counts(A.order_rentals(s, d), AS_OF.date(), 30),
        "partition_range_counts": lambda s, d: K.bucket_counts(A.vehicles(s, d), K.range_bucket("model_year")),
        "partition_month_counts": lambda s, d: K.bucket_counts(A.rentals(s, d), K.month_bucket("pickup_date")),
        "partition_list_counts": lambda s, d: K.bucket_counts(A.payments(s, d), K.list_bucket("payment_method")),
        "sample_rows": lambda s, d: K.sample_rows(
            A.order_rentals(s, d, done).select("rental_id", "customer_id", "total_charge"), "rental_id", 10),
        "sample_blocks": lambda s, d: K.sample_blocks(
            A.rentals(s, d, done).select("rental_ref", "order_id", "total_charge"), "order_id", 5, block_rows=128),
        "monthly_revenue_touched": _touched_months,
        "monthly_revenue_refreshed": lambda s, d: K.refresh_monthly_revenue(A.rentals(s, d, done), _folder(s, "monthly")),
        "partition_range_read": _partitioned,
        "active_rentals_sql": lambda s, d: _sql(s, d, "select * from active_rentals(3)"),
        "revenue_by_month_sql": lambda s, d: _sql(
            s, d, f"select * from revenue_by_month(date '{SPAN[0]}', date '{SPAN[1]}')"),
    }


def _rates(s: SparkSession, d: str) -> DataFrame:
    return P.rate_table(A.vehicles(s, d), A.categories(s, d))


def _priced(rows: DataFrame, s: SparkSession, d: str, **options) -> DataFrame:
    return P.price(rows, _rates(s, d), "pickup_date", "dropoff_date", **options)


def _promo_priced(s: SparkSession, d: str) -> DataFrame:
    return P.apply_promo(_priced(A.requests(s, d), s, d), A.promo_codes(s), AS_OF)


def _decisions(s: SparkSession, d: str) -> DataFrame:
    return Q.decide_reservations(
        # The open rentals are the requests; all others hold their vehicle, as none is cancelled.
        A.requests(s, d), A.rentals(s, d).where(F.col("status") != "ACTIVE").select("vehicle_id", "pickup_date", "dropoff_date"),
        A.customers(s, d), _rates(s, d), A.promo_codes(s), AS_OF, "rental_ref")


def _settled(s: SparkSession, d: str) -> DataFrame:
    return Q.settle(A.returns(s, d), _rates(s, d), A.promo_codes(s), AS_OF).select(
        "rental_ref", "base_charge", "fuel_charge", "damage_charge", "late_fee", "total_charge", "status")


def _begun(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Starts over the stored orders; every third request is sent a second time with another reading."""
    asked = A.pickups(s, d)
    again = asked.where(F.col("reservation_id") % 3 == 0).withColumn("odometer_out", F.col("odometer_out") + 1)
    cars = A.vehicles(s, d).select("vehicle_id", "status")
    return Q.begin_rentals(A.reservations(s, d), asked.unionByName(again), cars, AS_OF, 9001)


def rule_queries() -> dict[str, Query]:
    return {
        "tiered_pricing": lambda s, d: _priced(A.rentals(s, d), s, d).select(
            "rental_ref", "days", "daily_rate", "base_price"),
        "tiered_pricing_scaled": lambda s, d: _priced(A.rentals(s, d), s, d, fix_fallback=True).select(
            "rental_ref", "base_price"),
        "promo_pricing": lambda s, d: _promo_priced(s, d).select("rental_ref", "promo_code", "base_price", "price"),
        "loyalty_pricing": lambda s, d: P.apply_loyalty(_promo_priced(s, d), A.customers(s, d)).select(
            "rental_ref", "tier", "price", "cost"),
        "customer_tiers": lambda s, d: A.customers(s, d).select(
            "customer_id", "loyalty_points", P.tier(F.col("loyalty_points")).alias("tier")),
        "promo_validity": lambda s, d: P.check_promos(A.requests(s, d), A.promo_codes(s), AS_OF).select(
            "rental_ref", "promo_code", "promo_check"),
        "promo_valid_at": lambda s, d: O.valid_at(
            A.requests(s, d), A.promo_codes(s), "promo_code", F.col("pickup_date"), "valid_from", "valid_to").select(
            "rental_ref", "promo_code", "discount_type"),
        "availability_check": lambda s, d: Q.check_available(A.requests(s, d), A.vehicles(s, d)).select(
            "rental_ref", "vehicle_status", "start_check"),
        "reservation_decisions": _decisions,
        "begin_rentals": lambda s, d: _begun(s, d)[0],
        "begin_rentals_reservations": lambda s, d: _begun(s, d)[1].select("reservation_id", "status"),
        "begin_rentals_vehicles": lambda s, d: _begun(s, d)[2],
        "begin_rentals_refused": lambda s, d: _begun(s, d)[3].select("reservation_id", "odometer_out", "reason"),
        "rental_settlement": _settled,
        "settlement_refused": lambda s, d: Q.refused_returns(A.rentals(s, d)).select("rental_ref", "status", "reason"),
    }


HISTORY_AS_OF = datetime(2024, 1, 15)


def _upsert(s: SparkSession, d: str) -> DataFrame:
    rows = A.order_rentals(s, d, "COMPLETED")

    def since(text: str):
        return F.lit(text).cast("timestamp_ntz")

    target = J.customer_stats(rows.where(F.col("actual_pickup") < since("1999-01-01"))).withColumn(
        "updated_at", since("1999-01-01"))
    # All completed rentals, as the procedure reads them; customers of the target alone stay as they are.
    source = J.customer_stats(rows.where(F.col("actual_pickup").isNotNull()))
    return J.merge_upsert(target, source, ["customer_id"], {"updated_at": since(str(AS_OF))})


def _gappy_vehicles(s: SparkSession, d: str) -> DataFrame:
    """Vehicles with values left out, as inserts with missing fields."""
    def without(column: str, test) -> object:
        return F.when(~test, F.col(column))

    key = F.col("vehicle_id")
    return A.vehicles(s, d).select("vehicle_id", "mileage", "fuel_type", "transmission", "seats", "status", "is_active").withColumns({
        "mileage": without("mileage", key % 4 == 0), "fuel_type": without("fuel_type", key % 3 == 0),
        "transmission": without("transmission", key % 6 == 1), "seats": without("seats", key % 5 == 2),
        "status": without("status", key % 7 == 3),
    })


def _customer_updates(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rich customers get a new address and lose their points; customers without points are sent under unknown keys."""
    people = A.customers(s, d).select("customer_id", "email", "loyalty_points")
    rich = people.where(F.col("loyalty_points") > 5000).select(
        "customer_id", F.concat(F.lit("vip."), "email").alias("email"), F.lit(None).cast("long").alias("loyalty_points"))
    unknown = people.where(F.col("loyalty_points").isNull()).select(
        (F.col("customer_id") + 1_000_000_000).alias("customer_id"), "email", "loyalty_points")
    # Every second rich customer is sent twice; the later change wins.
    again = rich.where(F.col("customer_id") % 2 == 0).withColumn("email", F.concat(F.lit("second."), "email"))
    sent = rich.unionByName(unknown).withColumn("sent", F.lit(1)).unionByName(again.withColumn("sent", F.lit(2)))
    return J.apply_updates(people, sent, "customer_id", ["email", "loyalty_points"], ["sent"])


def _cheap(s: SparkSession, d: str) -> DataFrame:
    return A.order_rentals(s, d).where(F.col("total_charge") < 60000).select("rental_id")


def _audit_sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = A.payments(s, d).select("payment_id", "payment_date", "amount", "payment_method", "status")

    def day(text: str):
        return F.lit(text).cast("timestamp_ntz")

    old = rows.where(F.col("payment_date") < day("2001-01-01"))
    wallet = F.col("payment_method") == "DIGITAL_WALLET"
    new = rows.where(F.col("payment_date") >= day("1995-07-01")).withColumns({
        "amount": F.when(wallet, F.col("amount") + F.lit(10.5).cast("decimal(4,2)")).otherwise(F.col("amount")).cast("decimal(10,2)"),
        "status": F.when(F.col("status") == "PENDING", "COMPLETED").otherwise(F.col("status")),
    })
    return old, new


def _stored_rental(s: SparkSession, d: str, rental_id: int) -> DataFrame:
    rentals, path = _booked(s, d), _folder(s, "by_id")
    lookup_store.write_lookup(
        A.lines_with_customer(s, d), "rental_id", path, ("rental_ref",), by=F.expr(A.RENTAL_ID),
        derived=lambda lines: A.rentals_of(lines, "customer_id").select(*rentals.columns))
    return L.rental_by_id(lookup_store.lookup(s, path, rentals.schema, "rental_id", rental_id), *_view(s, d), rental_id)


def _touched_months(s: SparkSession, d: str) -> DataFrame:
    """The table as stored before the rentals of two months were completed, then refreshed for those."""
    done, path = A.rentals(s, d, "COMPLETED"), _folder(s, "months")
    late = F.trunc("actual_dropoff", "MM").isin(date(1996, 2, 1), date(1997, 5, 1))
    K.write_revenue_months(done.where(~late | (F.col("line_number") < 3)), path)
    K.refresh_revenue_months(done, done.where(late & (F.col("line_number") >= 3)), path)
    return K.read_revenue_months(done, path)


def _stored_as_of(s: SparkSession, d: str) -> DataFrame:
    history, path = A.history(s, d), _folder(s, "timeline")
    timeline.write_timeline(history, path, "row_key", ["state", "amount"])
    return timeline.stored_as_of(s, path, history.schema, HISTORY_AS_OF, "row_key", ["state", "amount"])


def _indexed_customers(s: SparkSession, d: str) -> DataFrame:
    rows, path = A.customers(s, d), _folder(s, "customer_grams")
    trigrams.write_index(rows, "customer_id", [L.full_name(), F.col("email"), F.col("license_number")], path)
    return L.search_customers(trigrams.indexed(rows, "customer_id", path, "0001"), "0001", AS_OF)


def _indexed_vehicles(s: SparkSession, d: str) -> DataFrame:
    rows, path = A.vehicles(s, d), _folder(s, "vehicle_grams")
    trigrams.write_index(rows, "vehicle_id", [F.col("make"), F.col("model"), F.col("license_plate")], path)
    return L.search_vehicles(trigrams.indexed(rows, "vehicle_id", path, "RiNg"), *_fleet(s, d)[1:], "RiNg")


def _guarded(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return J.delete_rentals(A.order_rentals(s, d).select("rental_id", "status"), _cheap(s, d), "rental_id")


def change_queries() -> dict[str, Query]:
    return {
        "assign_keys": lambda s, d: J.assign_keys(
            A.order_rentals(s, d).select("rental_id", "actual_pickup"), ["actual_pickup", "rental_id"], "new_id", 5001),
        "assign_keys_ranged": lambda s, d: J.assign_keys(
            A.order_rentals(s, d).select("rental_id", "actual_pickup"), ["actual_pickup", "rental_id"], "new_id", 5001,
            task_rows=1000),
        "version_history_ranged": lambda s, d: J.versions(
            A.history(s, d), "row_key", datetime(2024, 1, 10), datetime(2024, 1, 20), ["state", "amount"], task_rows=2),
        "merge_customer_stats": _upsert,
        "promo_usage": lambda s, d: J.bump_usage(A.promo_codes(s), A.requests(s, d)).select("promo_code", "current_uses"),
        "insert_defaults": lambda s, d: J.apply_defaults(_gappy_vehicles(s, d), J.vehicle_defaults()),
        "apply_updates": lambda s, d: _customer_updates(s, d)[0],
        "apply_updates_unknown": lambda s, d: _customer_updates(s, d)[1].drop("sent"),
        "soft_delete": lambda s, d: J.soft_delete(
            A.customers(s, d).select("customer_id", "is_active"),
            A.order_rentals(s, d, "DISPUTED").where(F.col("total_charge") > 450000), "customer_id"),
        "guarded_delete": lambda s, d: _guarded(s, d)[0],
        "guarded_delete_refused": lambda s, d: _guarded(s, d)[1],
        "purge_audit": lambda s, d: J.purge(A.history(s, d), datetime(2024, 1, 30), 10),
        "audit_diff": lambda s, d: J.payment_audit(J.snapshot_diff(*_audit_sides(s, d), "payment_id")),
        "audit_diff_digests": lambda s, d: J.payment_audit(digests.digest_diff(*_audit_sides(s, d), "payment_id")),
        "vehicle_state": lambda s, d: J.apply_vehicle_events(
            A.vehicles(s, d).select("vehicle_id", "status", "mileage"), A.vehicle_events_of(A.rentals(s, d))),
        "loyalty_award": lambda s, d: J.award_points(
            A.customers(s, d).select("customer_id", "loyalty_points"), A.order_rentals(s, d, "COMPLETED")),
        "as_of_state": lambda s, d: J.as_of(A.history(s, d), HISTORY_AS_OF, "row_key", ["state", "amount"]),
        "as_of_state_stored": _stored_as_of,
        "version_history": lambda s, d: J.versions(
            A.history(s, d), "row_key", datetime(2024, 1, 10), datetime(2024, 1, 20), ["state", "amount"]),
        "delete_ids": lambda s, d: J.delete_ids(
            A.order_rentals(s, d).select("rental_id", "customer_id"), _cheap(s, d), "rental_id"),
    }


def _looped_links(s: SparkSession, d: str) -> DataFrame:
    """Place links, with each region also pointing at the nation of its own number."""
    back = loaders.load(s, d, "region").select(
        F.concat(F.lit("R"), "r_regionkey").alias("src"), F.concat(F.lit("N"), "r_regionkey").alias("dst"))
    return A.place_links(s, d).unionByName(back)


def _checked_links(s: SparkSession, d: str) -> DataFrame:
    known = A.place_edges(s, d).where(F.col("name") != "ASIA")
    return tours.dependency_checks(_looped_links(s, d), known)


def tree_queries() -> dict[str, Query]:
    return {
        "hierarchy_recursive": lambda s, d: H.org_chart(A.place_edges(s, d)),
        "hierarchy_connect_by": lambda s, d: H.connect_by(A.place_edges(s, d)).orderBy("steps").drop("steps"),
        "tree_numbering": lambda s, d: tours.tree_numbering(A.place_edges(s, d)),
        "dependency_closure": lambda s, d: tours.dependency_summary(A.place_links(s, d)),
        "strong_components": lambda s, d: tours.strong_components(_looped_links(s, d)),
        "dependency_pairs": lambda s, d: H.closure(_looped_links(s, d)),
        "dependency_checks": _checked_links,
    }


def _run(s: SparkSession, start: Callable, *inputs) -> str:
    """Run a streaming job over what its folder holds now and return its output folder."""
    path = f"{checkpoint_dir(s)}/streams/{uuid4().hex}"
    start(*inputs, path).awaitTermination()
    return path


def _stream_audit(s: SparkSession, d: str) -> DataFrame:
    feed = A.payment_changes_of(A.payments_of(loaders.load_stream(s, d, "orders")))
    return jobs.read_audit(s, _run(s, jobs.stream_audit, feed))


def _stream_vehicle_state(s: SparkSession, d: str) -> DataFrame:
    path = _run(s, jobs.stream_vehicle_state, A.vehicle_events_of(A.rentals_of(loaders.load_stream(s, d, "lineitem"))))
    return jobs.read_vehicle_state(s, path, A.vehicles(s, d).select("vehicle_id", "status", "mileage"))


def _stream_monthly_revenue(s: SparkSession, d: str) -> DataFrame:
    clock, path = _folder(s, "clock"), _folder(s, "streams")
    jobs.tick(s, clock, END_OF_FEED)
    jobs.stream_monthly_revenue(A.rentals_of(loaders.load_stream(s, d, "lineitem")), path, clock=clock).awaitTermination()
    return jobs.read_monthly_revenue(s, path)


def stream_queries() -> dict[str, Query]:
    return {
        "stream_audit": _stream_audit,
        "stream_vehicle_state": _stream_vehicle_state,
        "stream_monthly_revenue": _stream_monthly_revenue,
    }


def all_queries() -> dict[str, Query]:
    plans = {**report_queries(), **lookup_queries(), **rule_queries(), **change_queries(), **tree_queries(),
             **stream_queries()}
    return {name: (lambda s, d, plan=plan: plain_types(plan(s, d))) for name, plan in plans.items()}
