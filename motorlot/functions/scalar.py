"""Column functions with the semantics of the database expressions they stand for.

Differences from the plain Spark functions are noted where there are any.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

# Status labels, charge tiers and the address pattern of the reports.
STATUS_LABELS = {"ACTIVE": "On Road", "COMPLETED": "Returned", "DISPUTED": "Under Review"}
STATUS_OTHER = "Unknown"
CHARGE_TIERS = ((1000, "Premium"), (500, "Standard"), (0, "Economy"))
CHARGE_OTHER = "Pending"
EMAIL_PATTERN = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"


def text(*parts) -> Column:
    """Joined text that skips nulls; a bare null operand would make the result null."""
    return F.concat_ws("", *parts)


def decode(column: Column, pairs: dict, default=None) -> Column:
    """First pair whose key equals the value; a null key matches a null value."""
    result = None
    for key, value in pairs.items():
        test = column.eqNullSafe(F.lit(key))
        result = F.when(test, F.lit(value)) if result is None else result.when(test, F.lit(value))
    return result.otherwise(F.lit(default))


def tier_label(column: Column) -> Column:
    result = None
    for cut, label in CHARGE_TIERS:
        result = F.when(column > cut, label) if result is None else result.when(column > cut, label)
    return result.otherwise(CHARGE_OTHER)


def greatest_strict(*columns: Column) -> Column:
    """Null as soon as one value is null; Spark's greatest skips nulls."""
    return F.when(_any_null(columns), F.lit(None)).otherwise(F.greatest(*columns))


def least_strict(*columns: Column) -> Column:
    return F.when(_any_null(columns), F.lit(None)).otherwise(F.least(*columns))


def _any_null(columns) -> Column:
    test = columns[0].isNull()
    for c in columns[1:]:
        test = test | c.isNull()
    return test


def truncate_number(column: Column) -> Column:
    """Whole part, towards zero."""
    return F.when(column >= 0, F.floor(column)).otherwise(F.ceil(column))


def add_months(day: Column, months: int) -> Column:
    """The last day of a month stays a last day; Spark keeps the day number."""
    moved = F.add_months(day, months)
    return F.when(day == F.last_day(day), F.last_day(moved)).otherwise(moved)


def months_between(end: Column, start: Column, digits: int = 2) -> Column:
    return F.round(F.months_between(end, start, False).cast("decimal(20,10)"), digits)


def week_start(moment: Column) -> Column:
    return F.trunc(moment, "WEEK")


def padded_day_text(moment: Column) -> Column:
    """Day and month names blank-padded to nine characters, as in a 'Day, DD Month YYYY' mask."""
    return F.concat(
        F.rpad(F.date_format(moment, "EEEE"), 9, " "), F.lit(", "), F.date_format(moment, "dd "),
        F.rpad(F.date_format(moment, "MMMM"), 9, " "), F.date_format(moment, " yyyy HH:mm:ss"),
    )


def age(born: Column, as_of: Column) -> Column:
    return F.floor(F.months_between(as_of, born, False) / 12).cast("long")


def elapsed_hours(start: Column, as_of: datetime, digits: int = 1) -> Column:
    """Hours up to ``as_of``. Taken from the interval, so no session time zone plays a part."""
    gap = F.lit(str(as_of)).cast("timestamp_ntz") - start
    parts = [F.extract(F.lit(unit), gap).cast("decimal(16,6)") * seconds
             for unit, seconds in (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1))]
    total = (parts[0] + parts[1] + parts[2] + parts[3]).cast("decimal(18,6)")
    return F.round(total / F.lit(3600).cast("decimal(4,0)"), digits)


def nth_position(column: Column, part: str, n: int) -> Column:
    """Place of the n-th occurrence, 0 when there are fewer; occurrences may not overlap."""
    head = F.substring_index(column, part, n)
    return F.when(F.length(head) < F.length(column), F.length(head) + 1).otherwise(0)


def nth_match(column: Column, pattern: str, n: int) -> Column:
    """The n-th match of a pattern, null when there are fewer."""
    return F.try_element_at(F.regexp_extract_all(column, F.lit(pattern), F.lit(0)), F.lit(n))


def to_number(column: Column) -> Column:
    """Number in a text, null when the text is none."""
    return column.try_cast("decimal(18,2)")


def money_text(column: Column) -> Column:
    """Amount with thousands separators and two decimals, blank-padded to eleven characters."""
    return F.to_char(column, F.lit("999,999.00"))


def currency(amount: Column, rate: Column) -> Column:
    return F.round(amount * rate, 2)


# ---- projections that apply whole groups of functions --------------------------------------------

def conditional_functions(rentals: DataFrame, keys: list[str]) -> DataFrame:
    return rentals.select(
        *keys,
        decode(F.col("status"), STATUS_LABELS, STATUS_OTHER).alias("status_label"),
        F.nvl("total_charge", F.lit(0).cast("decimal(10,2)")).alias("safe_charge"),
        F.nvl2("damage_notes", F.lit("Has Damage"), F.lit("No Damage")).alias("damage_status"),
        F.nullif("fuel_charge", F.lit(0).cast("decimal(10,2)")).alias("fuel_charge_if_any"),
        F.coalesce("late_fee", F.lit(0).cast("decimal(10,2)")).alias("late_amt"),
        tier_label(F.col("total_charge")).alias("rental_tier"),
    )


def numeric_functions(rentals: DataFrame, keys: list[str]) -> DataFrame:
    base, late = F.col("base_charge"), F.col("late_fee")
    days = F.datediff("dropoff_date", "pickup_date")
    return rentals.select(
        *keys,
        F.round(base / F.lit(8), 1).alias("rounded"), F.floor(base).alias("floored"), F.ceil(base).alias("ceiled"),
        (days % 7).alias("spare_days"), F.floor(days / 7).alias("weeks"),
        greatest_strict(base, late).alias("higher"), least_strict(base, late).alias("lower"),
        truncate_number(-base).alias("truncated"),
    )


def date_functions(rentals: DataFrame, keys: list[str], as_of: datetime) -> DataFrame:
    pickup, dropoff = F.col("actual_pickup"), F.col("actual_dropoff")
    day = F.to_date(pickup)
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    return rentals.select(
        *keys,
        months_between(dropoff, pickup).alias("months_rented"), add_months(day, 1).alias("one_month_later"),
        F.trunc(pickup, "MM").alias("month_start"), week_start(pickup).alias("week_start"),
        F.trunc(pickup, "YEAR").alias("year_start"), day.alias("pickup_day"),
        F.year(pickup).alias("rental_year"), F.month(pickup).alias("rental_month"),
        padded_day_text(pickup).alias("formatted_date"), F.last_day(pickup).alias("last_of_month"),
        F.next_day(pickup, "MON").alias("next_monday"), F.to_date(F.date_format(pickup, "yyyy-MM-dd"), "yyyy-MM-dd").alias("parsed"),
        F.date_add(day, 7).alias("week_later"), F.date_sub(day, 30).alias("month_before"),
        (pickup + F.make_ym_interval(F.lit(0), F.lit(1))).alias("plus_interval"), now.alias("as_of"),
    )


def string_functions(customers: DataFrame) -> DataFrame:
    email, last = F.col("email"), F.col("last_name")
    at = F.instr(email, "@")
    key = F.col("customer_id").cast("string")
    return customers.where(F.col("is_active") == "Y").select(
        "customer_id",
        F.when(at > 1, F.substring(email, F.lit(1), at - 1)).alias("email_user"),
        F.substring(email, at + 1, F.length(email)).alias("email_domain"),
        at.alias("at_position"), nth_position(F.col("license_number"), "-", 2).alias("second_dash"),
        F.trim(F.concat(F.lit("  "), F.col("first_name"), F.lit(" "))).alias("trimmed_name"),
        F.ltrim(F.concat(F.lit("  "), F.col("first_name"))).alias("left_trimmed"),
        F.rtrim(F.concat(F.col("first_name"), F.lit("  "))).alias("right_trimmed"),
        F.replace(F.col("license_number"), F.lit("-"), F.lit("")).alias("license_clean"),
        F.initcap(F.lower(F.col("first_name"))).alias("proper_name"),
        F.upper(email).alias("upper_email"), F.lower(F.col("first_name")).alias("lower_name"),
        F.lpad(key, 8, "0").alias("padded_id"), F.rpad(F.col("first_name"), 10, " ").alias("padded_name"),
        F.length(email).alias("email_len"), F.octet_length(email).alias("email_bytes"),
        F.ascii(F.col("first_name")).alias("first_code"), F.char(F.ascii(F.col("first_name"))).alias("first_letter"),
        text(F.col("first_name"), F.lit(None).cast("string"), F.lit(" "), last).alias("joined"),
        to_number(last).alias("name_number"), to_number(F.col("first_name")).alias("not_a_number"),
        F.trim(money_text(F.col("loyalty_points").cast("decimal(8,2)"))).alias("points_text"),
    )


def regex_functions(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id",
        F.when(F.col("email").rlike(EMAIL_PATTERN), "Valid").otherwise("Invalid").alias("email_valid"),
        F.regexp_replace("license_number", "[^A-Z0-9]", "").alias("license_alphanum"),
        nth_match(F.col("email"), "[^@]+", 2).alias("domain_part"),
    )


def currency_convert(payments: DataFrame) -> DataFrame:
    return payments.select("payment_id", "amount", currency(F.col("amount"), F.col("exchange_rate")).alias("converted"))
