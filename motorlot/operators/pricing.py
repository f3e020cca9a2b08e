"""Prices, promotions and loyalty, as column rules over joined tables.

A price divides weekly rates by seven. It is kept as its exact seventh multiple (``sevenths``) until
the final rounding, so a discount never works on a rounded base.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from motorlot.functions.money import ratio

# Period lengths, fallback shares, tier cuts and tier discounts in percent.
MONTH_DAYS, WEEK_DAYS = 28, 7
MONTHLY_SHARE, WEEKLY_SHARE = "0.65", "0.80"
TIER_CUTS = ((500, "BRONZE"), (2000, "SILVER"), (5000, "GOLD"))
TOP_TIER = "PLATINUM"
TIER_DISCOUNT = {"GOLD": 5, "PLATINUM": 10}


def tier(points: Column) -> Column:
    """Tier by points; unknown points fall through to the top tier."""
    result = None
    for cut, name in TIER_CUTS:
        result = F.when(points < cut, name) if result is None else result.when(points < cut, name)
    return result.otherwise(TOP_TIER)


def rate_table(vehicles: DataFrame, categories: DataFrame) -> DataFrame:
    """Rates of each vehicle; its own daily rate beats the one of its category."""
    return vehicles.select("vehicle_id", "category_name", "daily_override").join(categories, "category_name").select(
        "vehicle_id", F.coalesce("daily_override", "daily_rate").alias("daily_rate"), "weekly_rate", "monthly_rate"
    )


def booked_days(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(1), F.datediff(end, start))


def sevenths(days: Column, fix_fallback: bool = False) -> Column:
    """Seven times the tiered price for a number of days.

    From 28 days whole 28-day periods cost the monthly rate and spare days a seventh of the weekly
    rate; from 7 days whole weeks cost the weekly rate and spare days the daily rate. A missing
    weekly or monthly rate falls back to a share of the daily rate, which counts for the whole
    period unless ``fix_fallback`` scales it to the length of the period.
    """
    daily = F.col("daily_rate")
    weekly = daily * F.lit(WEEKLY_SHARE).cast("decimal(3,2)") * F.lit(WEEK_DAYS if fix_fallback else 1)
    monthly = daily * F.lit(MONTHLY_SHARE).cast("decimal(3,2)") * F.lit(MONTH_DAYS if fix_fallback else 1)
    weekly = F.coalesce(F.col("weekly_rate"), weekly).cast("decimal(14,4)")
    monthly = F.coalesce(F.col("monthly_rate"), monthly).cast("decimal(14,4)")

    def periods(length: int) -> Column:
        return F.floor(days / length).cast("int")

    price = (
        F.when(days >= MONTH_DAYS, periods(MONTH_DAYS) * 7 * monthly + (days % MONTH_DAYS) * weekly)
        .when(days >= WEEK_DAYS, periods(WEEK_DAYS) * 7 * weekly + (days % WEEK_DAYS) * 7 * daily)
        .otherwise(days * 7 * daily)
    )
    return price.cast("decimal(18,4)")


def price(bookings: DataFrame, rates: DataFrame, start: str, end: str | Column, fix_fallback: bool = False) -> DataFrame:
    """Add ``days``, ``daily_rate``, ``sevenths`` and the rounded ``base_price``; unknown vehicles get nulls."""
    end = F.col(end) if isinstance(end, str) else end
    priced = bookings.join(rates, "vehicle_id", "left").withColumn("days", booked_days(F.col(start), F.to_date(end)))
    priced = priced.withColumn("sevenths", sevenths(F.col("days"), fix_fallback))
    return priced.withColumn("base_price", ratio(F.col("sevenths") * 100, F.lit(700))).drop("weekly_rate", "monthly_rate")


def apply_promo(priced: DataFrame, promos: DataFrame, as_of: datetime) -> DataFrame:
    """Add ``price``: the base less the discount of an active code in its validity span.

    Without a code the base stays; an unknown, inactive or expired code leaves no price.
    """
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    valid = promos.where((F.col("is_active") == "Y") & now.between(F.col("valid_from"), F.col("valid_to"))).select(
        "promo_code", "discount_type", "discount_value"
    )
    value, base = F.col("discount_value"), F.col("sevenths")
    percent = ratio(base * (F.lit(100) - value) * 10000, F.lit(7_000_000))
    fixed = F.when(value * 7 < base, ratio((base - value * 7) * 100, F.lit(700))).otherwise(0)
    return priced.join(valid, "promo_code", "left").withColumn(
        "price",
        F.when(F.col("promo_code").isNull(), F.col("base_price"))
        .when(F.col("discount_type") == "PERCENT", percent)
        .when(F.col("discount_type") == "FIXED", fixed)
        .when(F.col("discount_type").isNotNull(), F.col("base_price")).cast("decimal(18,2)"),
    ).drop("discount_type", "discount_value")


def apply_loyalty(priced: DataFrame, customers: DataFrame, how: str = "inner") -> DataFrame:
    """Add ``tier`` and ``cost``, the price less the discount of the customer's tier."""
    percent = F.lit(0)
    for name, share in TIER_DISCOUNT.items():
        percent = F.when(F.col("tier") == name, share).otherwise(percent)
    tiers = customers.select("customer_id", tier(F.col("loyalty_points")).alias("tier"))
    return priced.join(tiers, "customer_id", how).withColumn("cost", ratio(F.col("price") * (F.lit(100) - percent), F.lit(100)))


def check_promos(requests: DataFrame, promos: DataFrame, as_of: datetime) -> DataFrame:
    """Add ``promo_check``: OK, or why a given code may not be used."""
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    codes = promos.select(
        "promo_code", F.lit(True).alias("_known"), F.col("is_active").alias("_active"), F.col("valid_from").alias("_from"),
        F.col("valid_to").alias("_to"), F.col("max_uses").alias("_most"), F.col("current_uses").alias("_used"),
    )
    return requests.join(codes, "promo_code", "left").withColumn(
        "promo_check",
        F.when(F.col("promo_code").isNull(), "OK")
        .when(F.col("_known").isNull(), "INVALID_PROMO")
        .when((F.col("_active") == "N") | ~now.between(F.col("_from"), F.col("_to")), "PROMO_EXPIRED_OR_INACTIVE")
        .when(F.col("_used") >= F.col("_most"), "PROMO_LIMIT_REACHED").otherwise("OK"),
    ).drop("_known", "_active", "_from", "_to", "_most", "_used")
