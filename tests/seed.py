"""Literal rows of a small rental business (fixed values)."""

from datetime import date, datetime
from decimal import Decimal

D = Decimal

RENTALS = [
    # id, customer, vehicle, place, pickup, dropoff, base, fuel, damage, late, total, status
    (4001, 1001, 2001, 7001, datetime(2024, 1, 10, 9), datetime(2024, 1, 15, 10, 30), D(225), D(60), D(0), D(0), D(285), "COMPLETED"),
    (4002, 1002, 2003, 7002, datetime(2024, 2, 5, 14), datetime(2024, 2, 12, 14), D(595), D(0), D(0), D(0), D(595), "COMPLETED"),
    (4003, 1003, 2005, 7001, datetime(2024, 3, 1, 10), datetime(2024, 3, 8, 10), D(1050), D(30), D(0), D(0), D(1080), "COMPLETED"),
    (4004, 1001, 2006, 7003, datetime(2024, 4, 10, 8), datetime(2024, 4, 14, 9), D(300), D(0), D(0), D(0), D(300), "COMPLETED"),
]
RENTAL_SCHEMA = (
    "rental_id long, customer_id long, vehicle_id long, pickup_location long, actual_pickup timestamp_ntz, "
    "actual_dropoff timestamp_ntz, base_charge decimal(10,2), fuel_charge decimal(8,2), damage_charge decimal(8,2), "
    "late_fee decimal(8,2), total_charge decimal(10,2), status string"
)
CUSTOMERS = [
    (1001, "Alice", "Brown", 1250), (1002, "Bob", "Smith", 3800), (1003, "Carol", "Williams", 5200),
    (1004, "David", "Lee", 300), (1005, "Emma", "Davis", 780),
]
VEHICLES = [
    (2001, "Economy", "Toyota", "Corolla", 2022, "ABC-1001", "GASOLINE"), (2002, "Economy", "Honda", "Civic", 2023, "ABC-1002", "GASOLINE"),
    (2003, "SUV", "Ford", "Explorer", 2023, "XYZ-2001", "GASOLINE"), (2004, "SUV", "Chevrolet", "Tahoe", 2022, "XYZ-2002", "GASOLINE"),
    (2005, "Luxury", "BMW", "5 Series", 2024, "LUX-3001", "GASOLINE"), (2006, "Electric", "Tesla", "Model 3", 2024, "EV-4001", "ELECTRIC"),
    (2007, "Compact", "Nissan", "Altima", 2022, "ABC-1003", "GASOLINE"),
]
CATEGORIES = [
    ("Economy", D(45), D(270), D(900)), ("Compact", D(55), D(330), D(1100)), ("SUV", D(85), D(510), D(1700)),
    ("Luxury", D(150), D(900), D(3000)), ("Electric", D(75), D(450), D(1500)), ("Van", D(95), D(570), D(1900)),
    ("Bare", D(45), None, None), ("NoWeek", D(45), None, D(900)),
]
LOCATIONS = [(7001, "Downtown Branch"), (7002, "Airport Terminal A"), (7003, "North Side Location")]
EMPLOYEES = [
    (6001, "Sarah Johnson", None), (6002, "Mike Peters", 6001), (6003, "Linda Torres", None), (6004, "James Wong", 6003),
]
PROMOS = [
    ("SUMMER24", "PERCENT", D(10), 500, 0, date(2024, 6, 1), date(2024, 8, 31), "Y"),
    ("FLAT50", "FIXED", D(50), 200, 0, date(2024, 1, 1), date(2025, 12, 31), "Y"),
    ("LOYALTY15", "PERCENT", D(15), None, 0, date(2024, 1, 1), date(2025, 12, 31), "Y"),
    ("SPENT", "PERCENT", D(5), 2, 2, date(2024, 1, 1), date(2025, 12, 31), "Y"),
]
PROMO_SCHEMA = ("promo_code string, discount_type string, discount_value decimal(8,2), max_uses long, current_uses long, "
                "valid_from date, valid_to date, is_active string")


def rentals(spark):
    return spark.createDataFrame(RENTALS, RENTAL_SCHEMA)


def customers(spark):
    return spark.createDataFrame(CUSTOMERS, "customer_id long, first_name string, last_name string, loyalty_points long")


def vehicles(spark):
    return spark.createDataFrame(
        VEHICLES, "vehicle_id long, category_name string, make string, model string, model_year long, license_plate string, fuel_type string")


def categories(spark):
    return spark.createDataFrame(
        CATEGORIES, "category_name string, daily_rate decimal(8,2), weekly_rate decimal(8,2), monthly_rate decimal(8,2)")


def locations(spark):
    return spark.createDataFrame(LOCATIONS, "location_id long, location_name string")


def employees(spark):
    return spark.createDataFrame(EMPLOYEES, "id long, name string, parent long")


def promos(spark):
    return spark.createDataFrame(PROMOS, PROMO_SCHEMA)


def rows(df, *columns):
    """Rows as sorted tuples, decimals as floats."""
    picked = df.select(*columns) if columns else df
    clean = [tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in picked.collect()]
    return sorted(clean, key=repr)
