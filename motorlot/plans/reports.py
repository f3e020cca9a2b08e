"""Revenue, customer and vehicle reports.

Facts are reduced first and joined to names afterwards; rollups, cubes and grouping sets run over
the finest groups instead of over copies of every fact row. Reports come sorted; results with one
row per rental are left unsorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from motorlot.functions.money import mean, ratio
from motorlot.operators.ordered import cume_dist, group_sizes, ntile, ordered_scan, percent_rank
from motorlot.session import TASK_ROWS, checkpointed


def tally() -> Column:
    return F.count(F.lit(1))


def completed(rentals: DataFrame) -> DataFrame:
    return rentals.where(F.col("status") == "COMPLETED")


def month_of(column: str) -> Column:
    return F.trunc(column, "MM")


def month_label(column: str = "month") -> Column:
    return F.date_format(column, "yyyy-MM")


def _day(value: date) -> Column:
    return F.lit(value.isoformat()).cast("date")


def _moment(value: datetime) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


# ---- grouped reports ---------------------------------------------------------------------------

def dashboard_stats(rentals: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Count, revenue, mean and highest charge by status over the last days."""
    start = F.date_sub(F.to_date(_moment(as_of)), days)
    return (
        rentals.where(F.to_date("created_at") >= start).groupBy("status")
        .agg(tally().alias("cnt"), F.sum("total_charge").alias("total_revenue"),
             mean(F.sum("total_charge"), F.count("total_charge")).alias("avg_charge"),
             F.max("total_charge").alias("max_charge"))
        .orderBy("status")
    )


def monthly_summary(rentals: DataFrame) -> DataFrame:
    return (
        completed(rentals).groupBy(month_of("actual_dropoff").alias("revenue_month"))
        .agg(tally().alias("rental_count"), F.sum("total_charge").alias("total_revenue"),
             mean(F.sum("total_charge"), F.count("total_charge")).alias("avg_charge"),
             F.max("total_charge").alias("max_charge"), F.min("total_charge").alias("min_charge"))
    )


def repeat_customers(customers: DataFrame, rentals: DataFrame, least: int = 2) -> DataFrame:
    """Customers with several rentals and the list of their pickup days."""
    days = dates_listed(rentals, "customer_id", "actual_pickup", " | ")
    days = days.where(F.col("items") >= least)
    return days.join(customers, "customer_id").select(
        "customer_id", F.concat_ws(" ", "first_name", "last_name").alias("customer"),
        F.col("items").alias("rental_count"), F.col("listed").alias("rental_dates"),
    )


def _in_span(rentals: DataFrame, start: date, end: date) -> DataFrame:
    return completed(rentals).where(F.to_date("actual_dropoff").between(_day(start), _day(end)))


def revenue_report(rentals: DataFrame, start: date, end: date) -> DataFrame:
    """Eight measures by month of return, with a TOTAL row."""
    parts = ["total_charge", "base_charge", "fuel_charge", "damage_charge", "late_fee"]
    months = _in_span(rentals, start, end).groupBy(month_of("actual_dropoff").alias("month")).agg(
        tally().alias("n"), F.count("total_charge").alias("charged"), *[F.sum(c).alias(c) for c in parts]
    )
    return (
        months.rollup("month")
        .agg(F.grouping("month").alias("is_total"), F.sum("n").alias("rental_count"),
             F.sum("total_charge").alias("total_revenue"),
             ratio(F.sum("total_charge"), F.sum("charged")).alias("avg_revenue"),
             F.sum("base_charge").alias("base_rev"), F.sum("fuel_charge").alias("fuel_rev"),
             F.sum("damage_charge").alias("damage_rev"), F.sum("late_fee").alias("late_fees"))
        .orderBy(F.col("month").asc_nulls_last())
        .select(F.when(F.col("is_total") == 1, "TOTAL").otherwise(month_label()).alias("period"),
                "rental_count", "total_revenue", "avg_revenue", "base_rev", "fuel_rev", "damage_rev", "late_fees")
    )


def revenue_by_month(rentals: DataFrame, start: date, end: date) -> DataFrame:
    """Rental count and revenue by month label, with a TOTAL row."""
    months = _in_span(rentals, start, end).groupBy(month_of("actual_dropoff").alias("month")).agg(
        tally().alias("n"), F.sum("total_charge").alias("revenue")
    )
    return months.rollup("month").agg(
        F.grouping("month").alias("is_total"), F.sum("n").alias("rental_count"), F.sum("revenue").alias("total_revenue")
    ).select(
        F.when(F.col("is_total") == 1, "TOTAL").otherwise(month_label()).alias("period_label"),
        "rental_count", "total_revenue",
    ).orderBy("period_label")


def _place_category_month(rentals, vehicles, locations) -> DataFrame:
    """Finest groups of the location reports: (location, category, month).

    Categories are few, so the fact rows shrink right after the vehicle join; places are named on the groups.
    """
    fine = (
        completed(rentals).join(vehicles.select("vehicle_id", "category_name"), "vehicle_id")
        .groupBy("pickup_location", "category_name", month_of("actual_dropoff").alias("month"))
        .agg(tally().alias("n"), F.sum("total_charge").alias("revenue"))
    )
    return (
        fine.join(locations.select(F.col("location_id").alias("pickup_location"), "location_name"), "pickup_location")
        .groupBy("location_name", "category_name", "month")
        .agg(F.sum("n").alias("n"), F.sum("revenue").alias("revenue"))
    )


def _totals(grouped) -> DataFrame:
    return grouped.agg(
        F.sum("n").alias("rentals"), F.sum("revenue").alias("revenue"),
        F.grouping("location_name").cast("long").alias("is_loc_total"),
        F.grouping("category_name").cast("long").alias("is_cat_total"),
    )


def _labelled(df: DataFrame) -> DataFrame:
    return (
        df.orderBy(*[F.col(c).asc_nulls_last() for c in ("location_name", "category_name", "month")])
        .select(
            F.when(F.col("is_loc_total") == 1, "ALL LOCATIONS").otherwise(F.col("location_name")).alias("location"),
            F.when(F.col("is_cat_total") == 1, "ALL CATEGORIES").otherwise(F.col("category_name")).alias("category"),
            month_label().alias("month"), "rentals", "revenue", "is_loc_total", "is_cat_total",
            (F.col("is_loc_total") * 2 + F.col("is_cat_total")).alias("grouping_level"),
        )
    )


def revenue_rollup(rentals: DataFrame, vehicles: DataFrame, locations: DataFrame) -> DataFrame:
    """Revenue by location, category and month with subtotals and a grand total."""
    fine = _place_category_month(rentals, vehicles, locations)
    return _labelled(_totals(fine.rollup("location_name", "category_name", "month")))


def customers_rollup(rentals: DataFrame, vehicles: DataFrame, locations: DataFrame) -> DataFrame:
    """Different customers by location, category and month with subtotals and a grand total, exact.

    Each customer counts once in every cell it is in. Its cells are put in the order of the names, where the first one of
    each place and category, of each place and of all carries the count of that level, so counts add up over the cells.
    Rentals are merged to a row for each customer and cell before they are sorted, so a customer with very many rentals has
    no more rows than there are cells. Rentals without a customer count for none.
    """
    named = completed(rentals).join(vehicles.select("vehicle_id", "category_name"), "vehicle_id").join(
        locations.select(F.col("location_id").alias("pickup_location"), "location_name"), "pickup_location")
    names = ["location_name", "category_name", "month"]
    visits = named.where(F.col("customer_id").isNotNull()).select(
        "customer_id", "location_name", "category_name", month_of("actual_dropoff").alias("month")).distinct()
    for k in range(len(names)):
        line = Window.partitionBy("customer_id", *names[:k]).orderBy(*names[k:])
        visits = visits.withColumn(f"first_{k}", (F.row_number().over(line) == 1).cast("long"))
    firsts = [f"first_{k}" for k in range(len(names))]
    cells = visits.groupBy(*names).agg(F.count(F.lit(1)).alias("first_3"), *[F.sum(c).alias(c) for c in firsts])
    levels = cells.rollup(*names).agg(
        sum(F.grouping(c).cast("int") for c in names).alias("level"), *[F.sum(c).alias(c) for c in [*firsts, "first_3"]])
    return levels.select(
        F.when(F.col("level") >= 3, "ALL LOCATIONS").otherwise(F.col("location_name")).alias("location"),
        F.when(F.col("level") >= 2, "ALL CATEGORIES").otherwise(F.col("category_name")).alias("category"),
        month_label().alias("month"), "level",
        F.element_at(F.array("first_3", *firsts[::-1]), F.col("level") + 1).alias("customers"))


def revenue_grouping_sets(rentals: DataFrame, vehicles: DataFrame, locations: DataFrame,
                          sets: Sequence[Sequence[str]]) -> DataFrame:
    """The same measures for chosen sets of the three grouping columns."""
    fine = _place_category_month(rentals, vehicles, locations)
    columns = ["location_name", "category_name", "month"]
    return _labelled(_totals(fine.groupingSets([[F.col(c) for c in s] for s in sets], *columns)))


def revenue_cube(rentals: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Revenue for every combination of category and fuel."""
    fine = completed(rentals).groupBy("vehicle_id").agg(tally().alias("n"), F.sum("total_charge").alias("revenue"))
    fine = fine.join(vehicles.select("vehicle_id", "category_name", "fuel_type"), "vehicle_id")
    fine = fine.groupBy("category_name", "fuel_type").agg(F.sum("n").alias("n"), F.sum("revenue").alias("revenue"))

    def label(column: str) -> Column:
        return F.when(F.col(f"all_{column}") == 1, "ALL").otherwise(F.col(column))

    return (
        fine.cube("category_name", "fuel_type")
        .agg(F.sum("n").alias("rentals"), F.sum("revenue").alias("revenue"),
             F.grouping("category_name").alias("all_category_name"), F.grouping("fuel_type").alias("all_fuel_type"))
        .orderBy(F.col("category_name").asc_nulls_last(), F.col("fuel_type").asc_nulls_last())
        .select(label("category_name").alias("category"), label("fuel_type").alias("fuel_type"), "rentals", "revenue")
    )


def _category_month(rentals: DataFrame, vehicles: DataFrame) -> DataFrame:
    return (
        completed(rentals).join(vehicles.select("vehicle_id", "category_name"), "vehicle_id")
        .groupBy("category_name", month_of("actual_dropoff").alias("month"))
        .agg(tally().alias("n"), F.sum("total_charge").alias("revenue"))
    )


def pivot_monthly(rentals: DataFrame, vehicles: DataFrame, months: Sequence[str]) -> DataFrame:
    """Revenue and count of each listed month as columns; a month without rentals counts 0.

    A category whose rentals all lie in other months keeps its row.
    """
    fine = _category_month(rentals, vehicles)
    cells = fine.withColumn("rev_month", month_label()).groupBy("category_name").pivot("rev_month", list(months)).agg(
        F.sum("revenue").alias("revenue"), F.sum("n").alias("cnt")
    )
    columns = []
    for m in months:
        name = datetime.strptime(m, "%Y-%m").strftime("%b_%Y").lower()
        columns.append(F.col(f"{m}_revenue").alias(f"{name}_revenue"))
        columns.append(F.coalesce(F.col(f"{m}_cnt"), F.lit(0)).alias(f"{name}_cnt"))
    return cells.select("category_name", *columns).orderBy("category_name")


def pivot_conditional(rentals: DataFrame, vehicles: DataFrame, months: Sequence[str]) -> DataFrame:
    """Pivot by conditional sums."""
    fine = _category_month(rentals, vehicles)
    sums = [
        F.sum(F.when(F.col("month") == F.lit(f"{m}-01").cast("date"), F.col("revenue")))
        .alias(datetime.strptime(m, "%Y-%m").strftime("%b").lower())
        for m in months
    ]
    return fine.groupBy("category_name").agg(*sums).orderBy("category_name")


# Charge columns and the labels of their rows (fixed values).
CHARGE_LABELS = {"base_charge": "BASE", "fuel_charge": "FUEL", "damage_charge": "DAMAGE", "late_fee": "LATE_FEE"}


def unpivot_charges(rentals: DataFrame, keys: Sequence[str] = ("rental_id",)) -> DataFrame:
    """One row per charge of a rental; empty charges give no row."""
    pairs = F.array(*[
        F.struct(F.lit(label).alias("charge_type"), F.col(c).cast("decimal(10,2)").alias("amount"))
        for c, label in CHARGE_LABELS.items()
    ])
    return rentals.select(*keys, F.inline(pairs)).where(F.col("amount").isNotNull())


def first_rentals(rentals: DataFrame, rows: int, order: Sequence[str]) -> DataFrame:
    """The first rows by key, as a stable form of an unordered row limit."""
    return rentals.orderBy(*order).limit(rows)


def unpivot_first(rentals: DataFrame, rows: int = 10, keys: Sequence[str] = ("rental_id",)) -> DataFrame:
    """Charge rows of the first rentals by key."""
    chosen = first_rentals(rentals.select(*keys), rows, keys)
    return unpivot_charges(rentals.join(chosen, list(keys), "left_semi"), keys)


# ---- totals of entities ------------------------------------------------------------------------

def customer_spend(customers: DataFrame, rentals: DataFrame) -> DataFrame:
    spend = completed(rentals).groupBy("customer_id").agg(F.sum("total_charge").alias("total_spend"))
    return customers.join(spend, "customer_id").select(
        "customer_id", F.concat_ws(" ", "first_name", "last_name").alias("customer_name"), "total_spend"
    )


def customer_spend_rank(customers: DataFrame, rentals: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Customers ranked by spend, with their share of all spend."""
    spend = checkpointed(customer_spend(customers, rentals).withColumn("_down", -F.col("total_spend")))
    scan = ordered_scan(spend, ["_down"], ["customer_id"], sums=["total_spend"], task_rows=task_rows)
    return scan.select(
        "customer_id", "customer_name", "total_spend", F.col("rank_num").alias("spend_rank"),
        F.col("dense_num").alias("dense_rank"), F.col("row_num").alias("rn"),
        ratio(F.col("total_spend"), F.col("total_total_spend"), 100).alias("pct_of_total"),
    )


def top_vehicles_by_category(rentals: DataFrame, vehicles: DataFrame, top: int = 3) -> DataFrame:
    """Best earning vehicles of each category and their share of it."""
    revenue = completed(rentals).groupBy("vehicle_id").agg(
        F.sum("total_charge").alias("total_revenue"), tally().alias("rental_count")
    )
    named = revenue.join(vehicles.select("vehicle_id", "make", "model", "model_year", "category_name"), "vehicle_id")
    # Both totals are kept, so this branch needs the same vehicle sums as the ranking and Spark reuses them.
    totals = named.groupBy("category_name").agg(
        F.sum("total_revenue").alias("cat_revenue"), F.sum("rental_count").alias("cat_rentals"))
    best = Window.partitionBy("category_name").orderBy(F.col("total_revenue").desc_nulls_last())
    ranked = named.withColumn("cat_rank", F.rank().over(best)).where(F.col("cat_rank") <= top)
    return ranked.join(totals, "category_name").select(
        "category_name",
        F.format_string("%s %s (%d)", "make", "model", "model_year").alias("vehicle"),
        "vehicle_id", "total_revenue", "rental_count",
        ratio(F.col("total_revenue"), F.col("cat_revenue"), 100).alias("pct_of_category"), "cat_rank", "cat_rentals",
    ).orderBy("category_name", "cat_rank", "vehicle_id")


def top_with_ties(df: DataFrame, value: str, rows: int) -> DataFrame:
    """The highest rows, with every row that equals the last of them.

    The limit value comes from a bounded top-k, so ties are never gathered in one task.
    """
    least = df.select(value).orderBy(F.col(value).desc_nulls_last()).limit(rows).agg(F.min(value).alias("_least"))
    return df.join(F.broadcast(least), F.col(value) >= F.col("_least")).drop("_least")


def top_vehicles(rentals: DataFrame, vehicles: DataFrame, rows: int = 5) -> DataFrame:
    revenue = completed(rentals).groupBy("vehicle_id").agg(F.sum("total_charge").alias("revenue"))
    return top_with_ties(revenue, "revenue", rows).join(
        vehicles.select("vehicle_id", "make", "model"), on="vehicle_id"
    ).select("vehicle_id", "make", "model", "revenue").orderBy(F.desc("revenue"), "vehicle_id")


def page(df: DataFrame, value: str, key: str, skip: int, rows: int) -> DataFrame:
    """A page of rows by falling value; the key settles ties."""
    return numbered_page(df, value, key, skip + 1, skip + rows).drop("rn")


# A page that ends at or before this row is cut from a top-k.
SHALLOW_ROWS = 10_000


def numbered_page(df: DataFrame, value: str, key: str, first: int, last: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows first..last of that order with their row number.

    The depth of the page decides, not the size of the table: the rows up to a shallow page's end are a top-k that every
    task cuts for itself. For a deep page rows are numbered by an ordered scan, so it is no more work for one task than
    the first.
    """
    if last <= SHALLOW_ROWS:
        order = [F.col(value).desc_nulls_last(), F.col(key).asc()]
        top = df.orderBy(*order).limit(last).withColumn("rn", F.row_number().over(Window.orderBy(*order)))
        return top.where(F.col("rn") >= first).orderBy("rn")
    rows = df.withColumn("_none", F.col(value).isNull()).withColumn("_down", -F.col(value))
    scan = ordered_scan(rows, ["_none", "_down"], [key], ranks=False, task_rows=task_rows)
    return scan.where(F.col("row_num").between(first, last)).select(*df.columns, F.col("row_num").cast("int").alias("rn")).orderBy("rn")


def vehicle_profitability(vehicles: DataFrame, rentals: DataFrame, maintenance: DataFrame) -> DataFrame:
    """Revenue, upkeep, profit and cost share of every vehicle."""
    revenue = completed(rentals).groupBy("vehicle_id").agg(F.sum("total_charge").alias("revenue"))
    upkeep = maintenance.where(F.col("status") == "COMPLETED").groupBy("vehicle_id").agg(F.sum("cost").alias("cost"))
    zero = F.lit(0).cast("decimal(20,2)")
    earned, spent = F.coalesce("revenue", zero), F.coalesce("cost", zero)
    return (
        vehicles.join(revenue, "vehicle_id", "left").join(upkeep, "vehicle_id", "left")
        .select("vehicle_id", F.concat_ws(" ", "make", "model").alias("vehicle"), "model_year",
                earned.alias("total_revenue"), spent.alias("total_maint_cost"), (earned - spent).alias("net_profit"),
                ratio(spent, earned, 100).alias("cost_ratio_pct"))
    )


def cohort_ltv(rentals: DataFrame) -> DataFrame:
    """Spend by month of first rental and months since."""
    done = F.col("status") == "COMPLETED"
    activity = rentals.groupBy("customer_id", month_of("actual_pickup").alias("month")).agg(
        F.sum(F.when(done, F.col("total_charge"))).alias("spend"), F.count(F.when(done, 1)).alias("n")
    )
    # A customer has one row per month here, so the window groups are small, and counting rows
    # counts distinct customers.
    first = F.min("month").over(Window.partitionBy("customer_id"))
    return (
        activity.withColumn("cohort_month", first).where(F.col("n") > 0)
        .groupBy("cohort_month", F.months_between("month", "cohort_month").cast("long").alias("months_since_first"))
        .agg(tally().alias("active_customers"), F.sum("spend").alias("cohort_revenue"),
             ratio(F.sum("spend"), F.count("spend")).alias("avg_clv"))
        .orderBy("cohort_month", "months_since_first")
    )


# ---- monthly series: windows run over one row per month ------------------------------------------

def _monthly(rentals: DataFrame) -> DataFrame:
    return completed(rentals).groupBy(month_of("actual_dropoff").alias("month")).agg(
        tally().alias("n"), F.count("total_charge").alias("charged"), F.sum("total_charge").alias("revenue")
    )


def by_month():
    return Window.orderBy("month")


def revenue_dashboard(rentals: DataFrame) -> DataFrame:
    """Monthly revenue with a running total and a three-month mean."""
    recent = by_month().rowsBetween(-2, 0)
    return _monthly(rentals).withColumns({
        "running_total": F.sum("revenue").over(by_month().rowsBetween(Window.unboundedPreceding, 0)),
        "moving_avg_3m": ratio(F.sum("revenue").over(recent), F.count("revenue").over(recent)),
    }).orderBy("month").select(
        F.date_format("month", "MMM yyyy").alias("month"), F.col("n").alias("rentals"),
        F.col("revenue").alias("total_revenue"), ratio(F.col("revenue"), F.col("charged")).alias("avg_revenue"),
        "running_total", "moving_avg_3m",
    )


def period_growth(rentals: DataFrame) -> DataFrame:
    """Change of revenue against the month before, in percent."""
    before = F.lag("revenue").over(by_month())
    return _monthly(rentals).withColumn("prev_period_revenue", before).orderBy("month").select(
        month_label().alias("period"), F.col("n").alias("rental_count"), "revenue", "prev_period_revenue",
        ratio(F.col("revenue") - F.col("prev_period_revenue"), F.col("prev_period_revenue"), 100).alias("growth_pct"),
    )


def latest_periods(monthly: DataFrame, periods: int = 6) -> DataFrame:
    """The most recent distinct months."""
    rank = F.dense_rank().over(Window.orderBy(F.col("month").desc()))
    return monthly.withColumn("_rk", rank).where(F.col("_rk") <= periods).drop("_rk")


# Growth factors of the appended forecast rows (fixed values).
FORECAST_FACTORS = ("1.00", "1.05", "1.10")


def revenue_forecast(rentals: DataFrame, months: Sequence[str], periods: int = 6,
                     factors: Sequence[str] = FORECAST_FACTORS) -> DataFrame:
    """Latest months followed by forecast rows: the mean of the named months times each factor.

    Only named months among the latest ones count, as in a cell model over those rows.
    """
    actual = latest_periods(_monthly(rentals), periods).select(month_label().alias("period"), "revenue")
    named = actual.where(F.col("period").isin(list(months))).agg(
        F.sum("revenue").alias("total"), F.count("revenue").alias("n")
    )
    steps = F.array(*[
        F.struct(F.lit(f"FORECAST_{i}").alias("period"), F.lit(f).cast("decimal(4,2)").alias("factor"))
        for i, f in enumerate(factors, 1)
    ])
    forecast = named.select("total", "n", F.inline(steps)).select(
        "period",
        # total * factor has four decimals: scale to whole units before the exact division.
        ratio((F.col("total").cast("decimal(22,2)") * F.col("factor") * 100).cast("decimal(22,2)"),
              F.col("n") * 100, digits=4).alias("revenue"),
    )
    return actual.select("period", F.col("revenue").cast("decimal(26,4)").alias("revenue")).unionByName(
        forecast.select("period", F.col("revenue").cast("decimal(26,4)").alias("revenue"))
    ).orderBy("period")


def kpi_summary(rentals: DataFrame, vehicles: DataFrame, customers: DataFrame, as_of: datetime) -> DataFrame:
    """Active rentals, recent completed revenue, available vehicles and active customers in one row."""
    recent = F.to_date("created_at") >= F.date_sub(F.to_date(_moment(as_of)), 30)
    facts = rentals.agg(
        F.count(F.when(F.col("status") == "ACTIVE", 1)).alias("active_rentals"),
        F.coalesce(F.sum(F.when((F.col("status") == "COMPLETED") & recent, F.col("total_charge"))), F.lit(0))
        .alias("completed_revenue"),
    )
    fleet = vehicles.agg(
        F.count(F.when((F.col("is_active") == "Y") & (F.col("status") == "AVAILABLE"), 1)).alias("available_vehicles")
    )
    people = customers.agg(F.count(F.when(F.col("is_active") == "Y", 1)).alias("active_customers"))
    rows = facts.unionByName(fleet, True).unionByName(people, True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


# ---- ordered columns ---------------------------------------------------------------------------

def running_totals(rentals: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Running sum, moving mean over seven rows, neighbours and edge values by return time."""
    def nearby(w):
        return w.rowsBetween(-6, 0)

    rows = completed(rentals).select("rental_id", "actual_dropoff", "total_charge")
    scan = ordered_scan(
        rows, ["actual_dropoff"], ["rental_id"], sums=["total_charge"], edges=["total_charge"], ranks=False, reach=6,
        task_rows=task_rows, neighbours={
            "moving_avg_7": lambda w: mean(F.sum("total_charge").over(nearby(w)), F.count("total_charge").over(nearby(w))),
            "prev_rental_amt": lambda w: F.expr("lag(total_charge, 1, cast(0 as decimal(10,2)))").over(w),
            "next_rental_amt": lambda w: F.expr("lead(total_charge, 1, cast(0 as decimal(10,2)))").over(w),
        },
    )
    return scan.select(
        "rental_id", "actual_dropoff", "total_charge", F.col("run_total_charge").alias("running_total"),
        "moving_avg_7", "prev_rental_amt", "next_rental_amt",
        F.col("first_total_charge").alias("first_rental"), F.col("last_total_charge").alias("last_rental"),
    )


def charge_distribution(rentals: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Quartile, percent rank and cumulative share of each charge."""
    rows = completed(rentals).select("rental_id", "total_charge")
    scan = ordered_scan(rows, ["total_charge"], ["rental_id"], task_rows=task_rows)
    return scan.select(
        "rental_id", "total_charge", ntile(4).alias("quartile"), percent_rank().alias("pct_rank"),
        cume_dist().alias("cum_dist"),
    )


def location_cumulative(rentals: DataFrame, locations: DataFrame) -> DataFrame:
    """Monthly revenue of a place, its running sum and its share of the month."""
    fine = completed(rentals).groupBy("pickup_location", month_of("actual_dropoff").alias("month")).agg(
        F.sum("total_charge").alias("rev")
    )
    named = fine.join(locations.select(F.col("location_id").alias("pickup_location"), "location_name"), "pickup_location")
    return named.groupBy("location_name", "month").agg(F.sum("rev").alias("monthly_rev")).withColumns({
        "cumulative_loc_rev": F.sum("monthly_rev").over(Window.partitionBy("location_name").orderBy("month")),
        "pct_of_month": F.col("monthly_rev").cast("double")
        / F.nullif(F.sum("monthly_rev").over(Window.partitionBy("month")).cast("double"), F.lit(0.0)) * 100,
    }).withColumn("month", month_label()).orderBy("location_name", "month")


def customer_history(rentals: DataFrame, vehicles: DataFrame, customer_id: int | None = None,
                     key: str = "rental_id", task_rows: int = TASK_ROWS) -> DataFrame:
    """Completed rentals of one or all customers with running spend and charge rank."""
    rows = completed(rentals)
    if customer_id is not None:
        rows = rows.where(F.col("customer_id") == customer_id)
    rows = rows.select("customer_id", key, "vehicle_id", "actual_pickup", "actual_dropoff", "total_charge",
                       (-F.col("total_charge")).alias("_down"))
    rows = checkpointed(rows)  # read by the sizes and by both scans
    sizes = group_sizes(rows, ["customer_id"])
    spent = ordered_scan(rows, ["actual_pickup"], [key], ["customer_id"], sums=["total_charge"], ranks=False,
                         task_rows=task_rows, sizes=sizes)
    spent = spent.select(*rows.columns, F.col("run_total_charge").alias("running_total"))
    ranked = ordered_scan(spent, ["_down"], [key], ["customer_id"], task_rows=task_rows, sizes=sizes, costly=True)
    cars = vehicles.select("vehicle_id", F.concat_ws(" ", "make", "model").alias("vehicle"), "license_plate")
    return ranked.join(cars, "vehicle_id").select(
        "customer_id", key, "vehicle", "license_plate", "actual_pickup", "actual_dropoff", "total_charge",
        "running_total", F.col("rank_num").alias("charge_rank"),
    ).orderBy("customer_id", F.col("actual_pickup").desc(), key)


# ---- lists -------------------------------------------------------------------------------------

def listagg(df: DataFrame, group: Sequence[str] | str, value: str, separator: str) -> DataFrame:
    """Values of a group as one ordered text. The text is the result row, so it holds the whole group."""
    keys = [group] if isinstance(group, str) else list(group)
    return df.groupBy(*keys).agg(
        F.count(value).alias("items"),
        F.array_join(F.transform(F.array_sort(F.collect_list(value)), lambda v: v.cast("string")), separator).alias("listed"),
    )


def dates_listed(df: DataFrame, group: str, moment: str, separator: str) -> DataFrame:
    """Days of a group as one ordered text; equal days are counted first, so a busy group stays short."""
    days = df.where(F.col(moment).isNotNull()).groupBy(group, F.to_date(moment).alias("day")).agg(tally().alias("n"))
    text = F.transform(
        F.array_sort(F.collect_list(F.struct("day", "n"))),
        lambda d: F.array_join(F.array_repeat(F.date_format(d["day"], "yyyy-MM-dd"), d["n"].cast("int")), separator),
    )
    return days.groupBy(group).agg(F.sum("n").alias("items"), F.array_join(text, separator).alias("listed"))


def features_listed(vehicles: DataFrame) -> DataFrame:
    """Features of each vehicle as ordered text; a vehicle without features has no row."""
    listed = F.array_join(F.array_sort(F.filter("features", lambda f: f.isNotNull())), ", ")
    return vehicles.where(F.size("features") > 0).select(
        "vehicle_id", F.concat_ws(" ", "make", "model").alias("vehicle"), listed.alias("features")
    )


def unnest(df: DataFrame, column: str, name: str, keep: Sequence[str]) -> DataFrame:
    """One row per element of a collection column."""
    return df.select(*keep, F.explode(column).alias(name))
