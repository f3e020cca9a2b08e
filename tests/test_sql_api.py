from datetime import date

import seed
from pyspark.sql import functions as F
from seed import rows

from motorlot.plans import lookups as L, reports as R
from motorlot.plans.sql_api import register


def test_functions_match_the_dataframe_forms(spark):
    rentals = seed.rentals(spark).withColumn("status", F.when(F.col("rental_id") == 4004, "ACTIVE").otherwise(F.col("status")))
    register(spark, {"rentals": rentals, "customers": seed.customers(spark), "vehicles": seed.vehicles(spark)})
    span = (date(2024, 1, 1), date(2024, 2, 29))
    assert rows(spark.sql("select * from revenue_by_month(date '2024-01-01', date '2024-02-29')")) == rows(R.revenue_by_month(rentals, *span))
    assert rows(spark.sql("select rental_id, vehicle_info from active_rentals()")) == [(4004, "Tesla Model 3 (2024)")]
    assert rows(spark.sql("select rental_id from active_rentals(7001)")) == []
    want = rows(L.vehicle_utilization(seed.vehicles(spark), rentals, *span))
    assert rows(spark.sql("select * from vehicle_utilization(date '2024-01-01', date '2024-02-29')")) == want
    assert rows(spark.sql("select loyalty_tier(p) from values (499), (500), (5000), (null) t(p)")) == [
        ("BRONZE",), ("PLATINUM",), ("PLATINUM",), ("SILVER",)]
