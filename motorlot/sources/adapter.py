"""The stored tables seen as rental-domain tables.

Each function is a lazy projection of one or two stored tables; callers read only what they use.
``motorlot.plans.check_sql`` states the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from motorlot.sources.loaders import load

# Rental status by line flag and by order flag.
LINE_STATUS = {"R": "COMPLETED", "N": "ACTIVE", "A": "DISPUTED"}
ORDER_STATUS = {"F": "COMPLETED", "O": "ACTIVE", "P": "DISPUTED"}
PAYMENT_METHOD = {
    "1-URGENT": "CREDIT_CARD", "2-HIGH": "DEBIT_CARD", "3-MEDIUM": "CASH",
    "4-NOT SPECIFIED": "BANK_TRANSFER", "5-LOW": "DIGITAL_WALLET",
}
PAYMENT_STATUS = {"F": "COMPLETED", "O": "PENDING", "P": "REFUNDED"}


def _label(column: str, pairs: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{code}' then '{label}'" for code, label in pairs.items()) + " end"


def _only(df: DataFrame, column: str, pairs: dict[str, str], status: str | None) -> DataFrame:
    """Filter on the stored flag, which the scan can push down, instead of on the label."""
    if status is None:
        return df
    return df.where(F.col(column).isin([code for code, label in pairs.items() if label == status]))


def rentals(spark: SparkSession, folder: str, status: str | None = None) -> DataFrame:
    """Line-grain rentals without the customer. ``rental_ref`` is unique, ``rental_id`` nearly so."""
    return rentals_of(_only(load(spark, folder, "lineitem"), "l_returnflag", LINE_STATUS, status))


RENTAL_ID = "l_orderkey * 10 + l_linenumber"


def rentals_of(lines: DataFrame, *more: str) -> DataFrame:
    """Rental columns of line rows, and ``more`` columns as they are."""
    base, tax, share = "cast(l_extendedprice as decimal(10,2))", "cast(l_tax as decimal(4,2))", "cast(l_discount as decimal(4,2))"
    fuel = f"cast(round({base} * {tax}, 2) as decimal(10,2))"
    damage = f"cast(if({tax} = 0.08, 250, 0) as decimal(10,2))"
    late = f"cast(round({base} * {share}, 2) as decimal(10,2))"
    days = "cast(l_quantity as int)"
    pickup = f"l_shipdate - make_dt_interval({days})"
    closed = "l_returnflag != 'N'"
    return lines.selectExpr(
        f"{RENTAL_ID} as rental_id",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_shipdate as date)) as rental_ref",
        "l_orderkey as order_id",
        "cast(l_linenumber as bigint) as line_number",
        "l_partkey as vehicle_id",
        "l_suppkey as pickup_location",
        "l_partkey % 10 as dropoff_location",
        f"{pickup} as actual_pickup",
        "l_shipdate as actual_dropoff",
        f"date_sub(cast(l_shipdate as date), {days}) as pickup_date",
        "cast(l_shipdate as date) as dropoff_date",
        "l_partkey * 100 as odometer_out",
        f"if({closed}, l_partkey * 100 + {days} * 30, null) as odometer_in",
        "cast(100 as bigint) as fuel_level_out",
        f"if({closed}, 100 - cast(l_linenumber as bigint) * 5, null) as fuel_level_in",
        f"{base} as base_charge",
        f"{fuel} as fuel_charge",
        f"{damage} as damage_charge",
        f"nullif({late}, cast(0 as decimal(10,2))) as late_fee",
        f"if({closed}, cast({base} + {fuel} + {damage} + {late} as decimal(10,2)), null) as total_charge",
        f"{_label('l_returnflag', LINE_STATUS)} as status",
        f"if({tax} = 0.08, 'scratched', null) as damage_notes",
        *more,
    )


def with_customer(rows: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Customer of each line-grain rental."""
    orders = load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id")
    )
    return rows.join(orders, "order_id")


def lines_with_customer(spark: SparkSession, folder: str) -> DataFrame:
    """The stored columns from which ``rentals_of`` makes the rentals, with the customer of each: narrow rows to move."""
    lines = load(spark, folder, "lineitem").drop("l_linestatus").withColumnRenamed("l_orderkey", "order_id")
    return with_customer(lines, spark, folder).withColumnRenamed("order_id", "l_orderkey")


def order_rentals(spark: SparkSession, folder: str, status: str | None = None) -> DataFrame:
    """Order-grain rentals with a unique ``rental_id``."""
    orders = _only(load(spark, folder, "orders"), "o_orderstatus", ORDER_STATUS, status)
    return orders.selectExpr(
        "o_orderkey as rental_id", "o_custkey as customer_id", "o_orderdate as actual_pickup",
        "o_orderdate as actual_dropoff", "o_orderdate as created_at", "cast(o_totalprice as decimal(10,2)) as total_charge",
        f"{_label('o_orderstatus', ORDER_STATUS)} as status",
    )


def payments(spark: SparkSession, folder: str) -> DataFrame:
    return payments_of(load(spark, folder, "orders"))


def payments_of(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey as payment_id", "o_custkey as customer_id", "o_orderdate as payment_date",
        "cast(o_totalprice as decimal(10,2)) as amount",
        f"{_label('o_orderpriority', PAYMENT_METHOD)} as payment_method",
        f"{_label('o_orderstatus', PAYMENT_STATUS)} as status",
        "cast(1 + (o_custkey % 25) / 100 as decimal(10,6)) as exchange_rate",
    )


def vehicles(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "part").selectExpr(
        "p_partkey as vehicle_id", "p_type as category_name", "if(p_partkey % 7 != 0, p_partkey % 10, null) as location_id",
        "p_brand as make", "p_name as model", "cast(p_size % 15 + 2010 as bigint) as model_year",
        "split(p_name, ' ')[0] as color", "concat('PLT-', lpad(cast(p_partkey as string), 8, '0')) as license_plate",
        "p_partkey * 10 % 200000 as mileage",
        "case p_size % 4 when 0 then 'GASOLINE' when 1 then 'DIESEL' when 2 then 'HYBRID' else 'ELECTRIC' end as fuel_type",
        "if(p_size % 2 = 0, 'AUTOMATIC', 'MANUAL') as transmission", "cast(p_size as bigint) as seats",
        "case when p_partkey % 10 = 0 then 'MAINTENANCE' when p_partkey % 10 < 3 then 'RENTED' else 'AVAILABLE' end as status",
        "concat(split(p_name, ' '), array(p_type)) as features",
        "if(p_partkey % 5 = 0, cast(round(cast(p_retailprice as decimal(10,2)) * 0.05, 2) as decimal(10,2)), null) "
        "as daily_override",
        "date_add(date '2000-06-01', cast(p_partkey % 300 as int)) as last_service_date",
        "if(p_partkey % 11 != 0, date_add(date '2001-01-01', cast(p_partkey % 400 as int)), null) as insurance_expiry",
        "if(p_partkey % 10 = 3, 'N', 'Y') as is_active",
    )


def categories(spark: SparkSession, folder: str) -> DataFrame:
    """One row per vehicle category; PROMO has neither a weekly nor a monthly rate."""
    top = load(spark, folder, "part").groupBy("p_type").agg(F.max("p_retailprice").alias("top"))
    rates = top.selectExpr(
        "p_type as category_name", "cast(round(cast(top as decimal(10,2)) * 0.05, 2) as decimal(10,2)) as daily_rate")
    return rates.selectExpr(
        "category_name", "daily_rate",
        "if(category_name != 'PROMO', cast(daily_rate * 6 as decimal(10,2)), null) as weekly_rate",
        "if(category_name != 'PROMO', cast(daily_rate * 20 as decimal(10,2)), null) as monthly_rate",
    )


def locations(spark: SparkSession, folder: str) -> DataFrame:
    nations = load(spark, folder, "nation").join(
        load(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return load(spark, folder, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("location_id"), F.col("n_name").alias("location_name"), F.col("r_name").alias("region_name")
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    last = "split(c_name, '#')[1]"
    return load(spark, folder, "customer").selectExpr(
        "c_custkey as customer_id", "split(c_name, '#')[0] as first_name", f"{last} as last_name",
        f"if(c_custkey % 13 = 0, concat('broken.', {last}), concat(lower(c_mktsegment), '.', {last}, '@example.com')) as email",
        f"concat_ws('-', 'DL', c_nationkey, {last}) as license_number",
        "date_add(date '2000-01-01', cast(c_custkey % 1000 as int)) as license_expiry",
        "date_add(date '1950-01-01', cast(c_custkey % 18000 as int)) as date_of_birth",
        "if(c_custkey % 17 != 0, cast(greatest(0, floor(cast(c_acctbal as decimal(12,2)))) as bigint), null) as loyalty_points",
        "named_struct('street', c_mktsegment, 'city', concat('City ', c_nationkey)) as address",
        "if(c_custkey % 10 = 0, 'N', 'Y') as is_active",
    )


def maintenance(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "lineitem").where(F.col("l_returnflag") == "A").selectExpr(
        "l_partkey as vehicle_id", "cast(round(cast(l_extendedprice as decimal(10,2)) * 0.05, 2) as decimal(10,2)) as cost",
        "if(l_linestatus = 'F', 'COMPLETED', 'SCHEDULED') as status", "l_shipdate as start_date",
    )


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Row changes over time: a signup inserts the row, an error deletes it, anything else updates it."""
    return load(spark, folder, "events").selectExpr(
        "user_id as row_key", "event_id as seq", "ts as changed_at",
        "case event_type when 'signup' then 'INSERT' when 'error' then 'DELETE' else 'UPDATE' end as operation",
        "event_type as state", "cast(value as decimal(10,2)) as amount",
    )


def place_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Region, nation and supplier as one tree; regions have no parent."""
    regions = load(spark, folder, "region").select(
        F.concat(F.lit("R"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent"),
        F.col("r_name").alias("name"),
    )
    nations = load(spark, folder, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey")).alias("id"),
        F.concat(F.lit("R"), F.col("n_regionkey")).alias("parent"), F.col("n_name").alias("name"),
    )
    suppliers = load(spark, folder, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("id"),
        F.concat(F.lit("N"), F.col("s_nationkey")).alias("parent"), F.col("s_name").alias("name"),
    )
    return regions.unionByName(nations).unionByName(suppliers)


def promo_codes(spark: SparkSession) -> DataFrame:
    """A small fixed promotion list: percent, fixed, unlimited, used up, inactive and expired codes."""
    rows = ", ".join(
        f"('{code}', '{kind}', {value}, {most}, {used}, date '{start}', date '{end}', '{active}')"
        for code, kind, value, most, used, start, end, active in PROMOS
    )
    return spark.sql(
        "select promo_code, discount_type, cast(discount_value as decimal(8,2)) discount_value, "
        "cast(max_uses as bigint) max_uses, cast(current_uses as bigint) current_uses, valid_from, valid_to, is_active "
        f"from values {rows} as t(promo_code, discount_type, discount_value, max_uses, current_uses, "
        "valid_from, valid_to, is_active)"
    )


PROMOS = [
    ("TEN", "PERCENT", 10, 500, 3, "2001-01-01", "2001-12-31", "Y"),
    ("FLAT50", "FIXED", 50, 60, 10, "2001-01-01", "2001-07-15", "Y"),
    ("FULL", "PERCENT", 15, 20, 20, "2001-01-01", "2001-12-31", "Y"),
    ("OFF", "PERCENT", 20, "null", 0, "2001-01-01", "2001-12-31", "N"),
    ("OLD", "FIXED", 75, "null", 0, "1999-01-01", "1999-12-31", "Y"),
]


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Booking requests: the active line-grain rentals, some with a promotion code."""
    codes = {1: "TEN", 2: "FLAT50", 3: "FULL", 4: "OFF", 5: "OLD", 6: "GHOST"}
    code = None
    for line, name in codes.items():
        test = F.col("line_number") == line
        code = F.when(test, name) if code is None else code.when(test, name)
    return with_customer(rentals(spark, folder, "ACTIVE"), spark, folder).select(
        "rental_ref", "rental_id", "customer_id", "vehicle_id", "pickup_location", "pickup_date", "dropoff_date",
        code.alias("promo_code"),
    )


def payment_changes_of(rows: DataFrame) -> DataFrame:
    """A change feed: completed payments are inserted, refunded ones deleted, pending ones updated."""
    row = F.struct("amount", "payment_method", "status")
    before = F.struct((F.col("amount") + 5).cast("decimal(10,2)").alias("amount"), "payment_method", F.lit("FAILED").alias("status"))
    operation = F.when(F.col("status") == "COMPLETED", "INSERT").when(F.col("status") == "REFUNDED", "DELETE").otherwise("UPDATE")
    return rows.select(
        "payment_id", operation.alias("operation"), F.when(operation != "INSERT", before).alias("old"),
        F.when(operation != "DELETE", row).alias("new"),
    )


def vehicle_events_of(rows: DataFrame) -> DataFrame:
    """Events of line-grain rentals: every start, the return of completed ones, a workshop visit for
    disputed ones. Returns on line 7 carry no odometer reading."""
    reading = F.when(F.col("line_number") != 7, F.col("odometer_in"))
    nothing = F.lit(None).cast("long")

    def event(when, name, suffix, odometer):
        return F.struct(F.col(when).alias("happened_at"), F.lit(name).alias("event"),
                        F.concat("rental_ref", F.lit(suffix)).alias("seq"), odometer.alias("odometer"))

    happened = F.array(
        event("actual_pickup", "START", "-A", nothing),
        F.when(F.col("status") == "COMPLETED", event("actual_dropoff", "COMPLETE", "-B", reading)),
        F.when(F.col("status") == "DISPUTED", event("actual_dropoff", "MAINTENANCE", "-C", nothing)),
    )
    return rows.select("vehicle_id", F.inline(F.filter(happened, lambda e: e.isNotNull())))


def reservations(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("reservation_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_custkey").alias("vehicle_id"), (F.col("o_custkey") % 10).alias("pickup_location"),
        ((F.col("o_custkey") + 1) % 10).alias("dropoff_location"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "CONFIRMED")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "CANCELLED").otherwise("PENDING").alias("status"),
    )


def pickups(spark: SparkSession, folder: str) -> DataFrame:
    """Requests to start a reserved rental."""
    return load(spark, folder, "orders").where(F.col("o_orderstatus") == "O").select(
        F.col("o_orderkey").alias("reservation_id"), (F.col("o_orderkey") * 2).alias("odometer_out"),
        (F.col("o_custkey") % 4 + 6001).alias("employee_out"),
    )


def returns(spark: SparkSession, folder: str) -> DataFrame:
    """Open rentals with their reservation (none on line 7) and the readings at return (no fuel on line 6)."""
    line = F.col("line_number")
    code = F.when(line == 1, "TEN").when(line == 2, "FLAT50").when(line == 5, "OLD")
    return rentals(spark, folder, "ACTIVE").withColumns({
        "reserved_dropoff": F.when(line != 7, F.col("dropoff_date")), "promo_code": code,
        "fuel_level_in": F.when(line != 6, 100 - line * 5),
    })


def place_links(spark: SparkSession, folder: str) -> DataFrame:
    """Place edges as (src, dst): each place depends on the one that holds it."""
    return place_edges(spark, folder).where(F.col("parent").isNotNull()).select(
        F.col("id").alias("src"), F.col("parent").alias("dst"))
