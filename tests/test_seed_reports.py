from datetime import date

import pytest
import seed
from seed import rows

from motorlot.plans import lookups as L, reports as R


def test_spend_rank(spark):
    got = rows(R.customer_spend_rank(seed.customers(spark), seed.rentals(spark)),
               "customer_id", "total_spend", "spend_rank", "dense_rank", "rn", "pct_of_total")
    assert got == [(1001, 585.0, 3, 3, 3, 25.88), (1002, 595.0, 2, 2, 2, 26.33), (1003, 1080.0, 1, 1, 1, 47.79)]


@pytest.mark.parametrize("task_rows", [100, 0])
def test_running_totals(spark, task_rows):
    got = R.running_totals(seed.rentals(spark), task_rows=task_rows).orderBy("rental_id").collect()
    assert [float(r.running_total) for r in got] == [285, 880, 1960, 2260]
    assert [round(r.moving_avg_7, 4) for r in got] == [285, 440, 653.3333, 565]
    assert [float(r.prev_rental_amt) for r in got] == [0, 285, 595, 1080]
    assert [float(r.next_rental_amt) for r in got] == [595, 1080, 300, 0]
    assert {float(r.first_rental) for r in got} == {285} and {float(r.last_rental) for r in got} == {300}


@pytest.mark.parametrize("task_rows", [100, 0])
def test_charge_distribution(spark, task_rows):
    got = R.charge_distribution(seed.rentals(spark), task_rows=task_rows).orderBy("rental_id").collect()
    assert [r.quartile for r in got] == [1, 3, 4, 2]
    assert [r.pct_rank for r in got] == pytest.approx([0, 2 / 3, 1, 1 / 3])
    assert [r.cum_dist for r in got] == [.25, .75, 1, .5]


def test_location_cumulative(spark):
    got = rows(R.location_cumulative(seed.rentals(spark), seed.locations(spark)), "location_name", "cumulative_loc_rev", "pct_of_month")
    assert got == [("Airport Terminal A", 595.0, 100.0), ("Downtown Branch", 1365.0, 100.0), ("Downtown Branch", 285.0, 100.0),
                   ("North Side Location", 300.0, 100.0)]


def test_revenue_report(spark):
    got = R.revenue_report(seed.rentals(spark), date(2024, 1, 1), date(2024, 4, 30)).collect()
    assert [r.period for r in got] == ["2024-01", "2024-02", "2024-03", "2024-04", "TOTAL"]
    assert [float(r.total_revenue) for r in got] == [285, 595, 1080, 300, 2260]
    last = got[-1]
    assert (last.rental_count, float(last.avg_revenue), float(last.base_rev), float(last.fuel_rev), float(last.damage_rev),
            float(last.late_fees)) == (4, 565, 2170, 90, 0, 0)


def test_growth_forecast_and_dashboard(spark):
    growth = R.period_growth(seed.rentals(spark)).collect()
    assert [None if r.growth_pct is None else float(r.growth_pct) for r in growth] == [None, 108.77, 81.51, -72.22]
    forecast = dict(rows(R.revenue_forecast(seed.rentals(spark), ["2024-01", "2024-02", "2024-03"]), "period", "revenue"))
    assert (forecast["FORECAST_1"], forecast["FORECAST_2"], forecast["FORECAST_3"]) == (653.3333, 686.0, 718.6667)
    dashboard = R.revenue_dashboard(seed.rentals(spark)).collect()
    assert [float(r.moving_avg_3m) for r in dashboard] == [285, 440, 653.33, 658.33]
    assert dashboard[0].month == "Jan 2024"


def test_cohorts_and_pivot(spark):
    got = rows(R.cohort_ltv(seed.rentals(spark)), "cohort_month", "months_since_first", "active_customers", "cohort_revenue")
    assert got == [(date(2024, 1, 1), 0, 1, 285.0), (date(2024, 1, 1), 3, 1, 300.0), (date(2024, 2, 1), 0, 1, 595.0),
                   (date(2024, 3, 1), 0, 1, 1080.0)]
    months = [f"2024-0{m}" for m in range(1, 7)]
    pivot = {r.category_name: r.asDict() for r in R.pivot_monthly(seed.rentals(spark), seed.vehicles(spark), months).collect()}
    assert set(pivot) == {"Economy", "SUV", "Luxury", "Electric"}
    assert float(pivot["SUV"]["feb_2024_revenue"]) == 595 and pivot["SUV"]["feb_2024_cnt"] == 1
    assert pivot["SUV"]["jan_2024_revenue"] is None and pivot["SUV"]["jan_2024_cnt"] == 0


@pytest.mark.parametrize("task_rows", [100, 0])
def test_customer_history(spark, task_rows):
    got = rows(R.customer_history(seed.rentals(spark), seed.vehicles(spark), 1001, task_rows=task_rows),
               "rental_id", "running_total", "charge_rank")
    assert got == [(4001, 285.0, 2), (4004, 585.0, 1)]


def test_utilization(spark):
    got = dict(rows(L.vehicle_utilization(seed.vehicles(spark), seed.rentals(spark), date(2024, 1, 1), date(2024, 2, 1))))
    assert got[2001] == 16.13 and got[2002] == 0
    assert set(dict(rows(L.vehicle_utilization(seed.vehicles(spark), seed.rentals(spark), date(2024, 2, 1), date(2024, 2, 1)))).values()) == {0.0}


def test_rollup_keeps_real_nulls_apart_from_totals(spark):
    places = spark.createDataFrame([(7001, None), (7002, "B"), (7003, "B")], "location_id long, location_name string")
    got = R.revenue_rollup(seed.rentals(spark), seed.vehicles(spark), places).collect()
    assert len([r for r in got if r.is_loc_total == 1]) == 1
    assert {float(r.revenue) for r in got if r.location is None and r.is_cat_total == 1} == {1365.0}


def test_ties_are_kept(spark):
    df = spark.createDataFrame([(1, 9), (2, 8), (3, 8), (4, 8), (5, 1), (6, None)], "id long, v long")
    assert rows(R.top_with_ties(df, "v", 2), "id") == [(1,), (2,), (3,), (4,)]


def test_listed_days_repeat(spark):
    twice = seed.rentals(spark).unionByName(seed.rentals(spark))
    got = {r.customer_id: r.listed for r in R.dates_listed(twice, "customer_id", "actual_pickup", " | ").collect()}
    assert got[1001] == "2024-01-10 | 2024-01-10 | 2024-04-10 | 2024-04-10"
