"""Rental tables and their functions for use from Spark SQL.

``register`` publishes temporary views over the given tables and temporary SQL functions, so that
``select * from active_rentals(7001)`` or ``select loyalty_tier(points)`` work in a session. The
functions are plain SQL and are inlined by the optimizer.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from motorlot.operators.pricing import TIER_CUTS, TOP_TIER


def register(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    """Publish ``rentals``, ``customers`` and ``vehicles`` (and any other table given) and the functions."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    for text in (_TIER, _USD, _ACTIVE, _REVENUE, _UTILIZATION):
        spark.sql(text)


_TIER = (
    "create or replace temporary function loyalty_tier(points bigint) returns string return case "
    + " ".join(f"when points < {cut} then '{name}'" for cut, name in TIER_CUTS) + f" else '{TOP_TIER}' end"
)

_USD = "create or replace temporary function to_usd(amount decimal(18,2)) returns decimal(18,2) return amount"

_ACTIVE = """
    create or replace temporary function active_rentals(place bigint default null)
    returns table (rental_id bigint, customer_name string, vehicle_info string, pickup_date timestamp_ntz, total_charge decimal(10,2))
    return select rental_id, concat_ws(' ', first_name, last_name), concat(make, ' ', model, ' (', model_year, ')'),
                  actual_pickup, total_charge
             from rentals join customers using (customer_id) join vehicles using (vehicle_id)
            where rentals.status = 'ACTIVE' and (place is null or pickup_location = place)"""

_REVENUE = """
    create or replace temporary function revenue_by_month(first_day date, last_day date)
    returns table (period_label string, rental_count bigint, total_revenue decimal(20,2))
    return select if(grouping(month) = 1, 'TOTAL', date_format(month, 'yyyy-MM')), sum(n), cast(sum(revenue) as decimal(20,2))
             from (select trunc(actual_dropoff, 'MM') as month, count(*) as n, sum(total_charge) as revenue
                     from rentals where status = 'COMPLETED' and to_date(actual_dropoff) between first_day and last_day
                    group by all)
            group by rollup (month)"""

_UTILIZATION = """
    create or replace temporary function vehicle_utilization(first_day date, last_day date)
    returns table (vehicle_id bigint, utilization_pct decimal(18,2))
    return select vehicle_id, cast(if(last_day <= first_day, 0, round(coalesce(days, 0) * 100
                  / cast(nullif(datediff(last_day, first_day), 0) as decimal(10,0)), 2)) as decimal(18,2))
             from vehicles left join (
                  select vehicle_id, sum(used_days) as days
                    from (select vehicle_id, datediff(least(to_date(actual_dropoff), last_day), greatest(to_date(actual_pickup), first_day)) as used_days
                            from rentals
                           where status = 'COMPLETED' and to_date(actual_pickup) < last_day
                             and actual_dropoff > cast(first_day as timestamp_ntz))
                   group by vehicle_id) used using (vehicle_id)"""
