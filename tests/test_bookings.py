import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
import seed
from pyspark.sql import functions as F
from seed import rows

from motorlot.operators import overlap as O, pricing as P, rentals as Q
from motorlot.plans import lookups as L

D0 = date(2024, 1, 1)


def bookings(count, vehicles, seed_number):
    draw = random.Random(seed_number)
    out = []
    for i in range(count):
        start = D0 + timedelta(days=draw.randrange(60))
        vehicle = 1 if draw.random() < 0.4 else draw.randrange(2, vehicles)
        out.append((i, vehicle, start, start + timedelta(days=draw.randrange(0, 9)), draw.random() < 0.8))
    return out


SCHEMA = "id long, vehicle_id long, pickup_date date, dropoff_date date, able boolean"


def test_clash_counts(spark):
    data = bookings(300, 12, 1)
    got = dict(rows(O.clash_counts(spark.createDataFrame(data, SCHEMA), "vehicle_id", "pickup_date", "dropoff_date"), "id", "clashes"))
    proper = [b for b in data if b[2] < b[3]]
    for i, vehicle, start, end, _ in data:
        if start < end:
            want = sum(1 for o in proper if o[0] != i and o[1] == vehicle and o[2] < end and o[3] > start)
            assert got[i] == want
        else:
            assert got[i] is None


def test_touching_bookings_do_not_clash(spark):
    data = [(1, 1, D0, D0 + timedelta(3), True), (2, 1, D0 + timedelta(3), D0 + timedelta(5), True)]
    assert rows(O.clash_counts(spark.createDataFrame(data, SCHEMA), "vehicle_id", "pickup_date", "dropoff_date"), "id", "clashes") == [(1, 0), (2, 0)]


@pytest.mark.parametrize("fold_rows", [10_000, 30, 0])
def test_requests_are_decided_in_order(spark, fold_rows):
    asked = bookings(200, 10, 2)
    held = bookings(25, 10, 3)
    kept = {}
    for _, vehicle, start, end, _ in held:
        if start < end:
            kept.setdefault(vehicle, []).append((start, end))
    want = {}
    for i, vehicle, start, end, able in asked:
        if start < end:
            spans = kept.setdefault(vehicle, [])
            want[i] = any(s < end and e > start for s, e in spans)
            if able and not want[i]:
                spans.append((start, end))
    got = Q.clash_flags(spark.createDataFrame(asked, SCHEMA), spark.createDataFrame(held, SCHEMA).drop("able", "id"), "id", fold_rows)
    assert dict(rows(got, "id", "clash")) == want


@pytest.mark.parametrize("sweep_days", [1, 7, 1000])
def test_first_blocker(spark, sweep_days):
    asked, held = bookings(150, 6, 11), bookings(120, 6, 12)
    asked += [(900, None, D0, D0 + timedelta(3), True), (901, 77, D0, D0 + timedelta(3), True)]
    held += [(910, None, D0, D0 + timedelta(3), True), (911, 1, D0 - timedelta(400), D0 + timedelta(400), True), (912, 2, None, D0, True)]
    want = {}
    for i, vehicle, start, end, _ in asked:
        hits = [(s, k) for k, v, s, e, _ in held if v is not None and v == vehicle and s is not None and s < e and start < end and s < end and e > start]
        want[i] = min(hits, default=(None, None))
    stored = spark.createDataFrame(held, SCHEMA).toDF("booking", "vehicle_id", "s", "e", "able")
    got = O.first_blocker(spark.createDataFrame(asked, SCHEMA), stored, "vehicle_id", "pickup_date", "dropoff_date", "booking", "s", "e", sweep_days)
    assert {r.id: (r.blocker_start, r.blocker) for r in got.collect()} == want
    assert O.first_blocker(spark.createDataFrame(asked, SCHEMA), stored.limit(0), "vehicle_id", "pickup_date", "dropoff_date", "booking", "s", "e").where("blocker is not null").isEmpty()


def test_an_island_of_thousands_of_requests(spark):
    draw = random.Random(13)
    asked = [(i, 1, D0 + timedelta(draw.randrange(900)), None, draw.random() < 0.7) for i in range(3000)]
    asked = [(i, v, s, s + timedelta(draw.randrange(1, 9)), able) for i, v, s, _, able in asked]
    taken, want = [], {}
    for i, _, start, end, able in asked:
        want[i] = any(s < end and e > start for s, e in taken)
        if able and not want[i]:
            taken.append((start, end))
    for fold_rows in (500, 5000):
        got = Q.clash_flags(spark.createDataFrame(asked, SCHEMA), spark.createDataFrame([], "vehicle_id long, pickup_date date, dropoff_date date"), "id", fold_rows)
        assert dict(rows(got, "id", "clash")) == want


def rates(spark):
    cars = spark.createDataFrame(
        [(1, "Economy", None), (2, "SUV", None), (3, "Luxury", None), (4, "Van", None), (5, "Bare", None), (6, "NoWeek", None),
         (7, "SUV", Decimal(100))], "vehicle_id long, category_name string, daily_override decimal(8,2)")
    return P.rate_table(cars, seed.categories(spark))


def stay(spark, *items):
    data = [(i, v, code, D0, D0 + timedelta(days=days)) for i, (v, days, code) in enumerate(items)]
    return spark.createDataFrame(data, "i long, vehicle_id long, promo_code string, pickup_date date, dropoff_date date")


def test_tiered_prices(spark):
    stays = stay(spark, *[(v, n, None) for v, n in [(1, 5), (1, 10), (1, 30), (2, 7), (3, 7), (4, 28), (6, 10), (5, 30), (7, 3), (1, 0), (99, 3)]])
    got = [r.base_price for r in P.price(stays, rates(spark), "pickup_date", "dropoff_date").orderBy("i").collect()]
    assert [None if p is None else float(p) for p in got] == [225, 405, 977.14, 510, 900, 1900, 171, 39.54, 300, 45, None]
    scaled = P.price(stay(spark, (5, 30, None)), rates(spark), "pickup_date", "dropoff_date", fix_fallback=True).first()
    assert float(scaled.base_price) == round(45 * 0.65 * 28 + 2 * 45 * 0.8, 2)


def test_promotions(spark):
    stays = stay(spark, (1, 5, "FLAT50"), (1, 10, "LOYALTY15"), (1, 5, "SUMMER24"), (1, 5, "GHOST"), (1, 1, "FLAT50"), (1, 5, None))
    priced = P.price(stays, rates(spark), "pickup_date", "dropoff_date")
    got = [r.price for r in P.apply_promo(priced, seed.promos(spark), datetime(2025, 7, 1)).orderBy("i").collect()]
    assert [None if p is None else float(p) for p in got] == [175, 344.25, None, None, 0, 225]
    # First and last day of a code.
    for day in (datetime(2024, 6, 1), datetime(2024, 8, 31)):
        edge = P.apply_promo(priced.where("promo_code = 'SUMMER24'"), seed.promos(spark), day).first()
        assert float(edge.price) == 202.5


def test_promo_checks(spark):
    stays = stay(spark, *[(1, 5, c) for c in ("FLAT50", "SUMMER24", "GHOST", "SPENT", None)])
    got = [r.promo_check for r in P.check_promos(stays, seed.promos(spark), datetime(2025, 7, 1)).orderBy("i").collect()]
    assert got == ["OK", "PROMO_EXPIRED_OR_INACTIVE", "INVALID_PROMO", "PROMO_LIMIT_REACHED", "OK"]


def test_tiers(spark):
    df = spark.createDataFrame([(p,) for p in (499, 500, 1999, 2000, 4999, 5000, None)], "p long")
    got = [r.t for r in df.select(P.tier(F.col("p")).alias("t")).collect()]
    assert got == ["BRONZE", "SILVER", "SILVER", "GOLD", "GOLD", "PLATINUM", "PLATINUM"]


def test_settlement(spark):
    data = [
        ("a", 1, datetime(2024, 1, 1, 9), date(2024, 1, 1), date(2024, 1, 5), None, 100, 80, "dent", "ACTIVE"),
        ("b", 1, datetime(2024, 1, 5, 9), date(2024, 1, 5), None, None, 100, 100, "", "ACTIVE"),
        ("c", 1, datetime(2024, 1, 5, 9), date(2024, 1, 5), None, "GHOST", 50, None, None, "ACTIVE"),
        ("d", 1, datetime(2024, 1, 5, 9), date(2024, 1, 5), None, None, 100, 100, None, "COMPLETED"),
    ]
    returns = spark.createDataFrame(data, "ref string, vehicle_id long, actual_pickup timestamp_ntz, pickup_date date, reserved_dropoff date, "
                                          "promo_code string, fuel_level_out long, fuel_level_in long, damage_notes string, status string")
    got = rows(Q.settle(returns, rates(spark), seed.promos(spark), datetime(2024, 1, 7, 12)),
               "ref", "base_charge", "fuel_charge", "damage_charge", "late_fee", "total_charge")
    assert got == [("a", 270.0, 60.0, 250.0, 135.0, 715.0), ("b", 90.0, 0.0, 0.0, 0.0, 90.0), ("c", None, 0.0, 0.0, 0.0, 0.0)]


def test_begin_rentals(spark):
    reservations = spark.createDataFrame(
        [(1, 10, 5, 7, 8, "CONFIRMED"), (2, 11, 6, 7, 8, "PENDING"), (3, 12, 5, 7, 8, "CONFIRMED")],
        "reservation_id long, customer_id long, vehicle_id long, pickup_location long, dropoff_location long, status string")
    asked = spark.createDataFrame([(1, 500, 6001), (2, 600, 6001), (9, 1, 1)], "reservation_id long, odometer_out long, employee_out long")
    asked = asked.union(spark.createDataFrame([(1, 500, 6001), (1, 510, 6001), (3, 700, 1), (4, 1, 1)], asked.schema))
    reservations = reservations.union(spark.createDataFrame([(4, 12, 99, 7, 8, "CONFIRMED")], reservations.schema))
    cars = spark.createDataFrame([(5, "AVAILABLE", 1), (6, "AVAILABLE", 2)], "vehicle_id long, status string, mileage long")
    begun, after, fleet, refused = Q.begin_rentals(reservations, asked, cars, datetime(2024, 1, 1), 4001)
    assert rows(begun, "rental_id", "reservation_id", "odometer_out", "status") == [(4001, 1, 500, "ACTIVE")]
    assert rows(after, "reservation_id", "status") == [(1, "COMPLETED"), (2, "PENDING"), (3, "CONFIRMED"), (4, "CONFIRMED")]
    assert rows(fleet) == [(5, "RENTED", 1), (6, "AVAILABLE", 2)]
    assert rows(refused, "reservation_id", "odometer_out", "reason") == sorted([
        (1, 500, "NOT_CONFIRMED"), (1, 510, "NOT_CONFIRMED"), (2, 600, "NOT_CONFIRMED"), (3, 700, "NOT_AVAILABLE"),
        (4, 1, "NOT_AVAILABLE"), (9, 1, "NOT_CONFIRMED")], key=repr)


def test_latest_per_row(spark):
    cars = spark.createDataFrame([(1,), (2,)], "vehicle_id long")
    trips = spark.createDataFrame([(1, 10, 5), (1, 11, 7), (1, 12, 7)], "vehicle_id long, id long, at long")
    assert rows(L.latest_per_row(cars, trips, "vehicle_id", ["at", "id"], ["id"], "left")) == [(1, 12), (2, None)]


@pytest.mark.parametrize("fold_rows, few_uses", [(10_000, 10_000), (3, 10_000), (10_000, 1)])
def test_promotions_run_out_inside_a_batch(spark, monkeypatch, fold_rows, few_uses):
    monkeypatch.setattr(Q, "FEW_USES", few_uses)
    draw = random.Random(8)
    asked = []
    for i in range(160):
        start = D0 + timedelta(days=draw.randrange(300))
        vehicle = None if i % 20 == 0 else draw.randrange(1, 6)
        asked.append((i, draw.choice([1, 1, 1, 2]), vehicle, draw.choice(["A", "B", "C", None]), start, start + timedelta(days=draw.randrange(0, 6))))
    requests = spark.createDataFrame(asked, "id long, customer_id long, vehicle_id long, promo_code string, pickup_date date, dropoff_date date")
    promos = spark.createDataFrame(
        [("A", "PERCENT", Decimal(10), 9, 0, datetime(2024, 1, 1), datetime(2024, 12, 31), "Y"), ("B", "FIXED", Decimal(5), 8, 2, datetime(2024, 1, 1), datetime(2024, 12, 31), "Y"),
         ("C", "FIXED", Decimal(5), 3, 0, datetime(2024, 1, 1), datetime(2024, 12, 31), "Y")],
        "promo_code string, discount_type string, discount_value decimal(8,2), max_uses long, current_uses long, valid_from timestamp_ntz, valid_to timestamp_ntz, is_active string")
    people = spark.createDataFrame([(1, "Y", 10), (2, "N", 10)], "customer_id long, is_active string, loyalty_points long")
    held = [(1, D0, D0 + timedelta(days=20))]
    existing = spark.createDataFrame(held, "vehicle_id long, pickup_date date, dropoff_date date")

    spans, left, want = {1: [held[0][1:]]}, {"A": 9, "B": 6, "C": 3}, {}
    for i, who, vehicle, code, start, end in asked:
        clash = vehicle is not None and any(s < end and e > start for s, e in spans.get(vehicle, []))
        reason = ("INVALID_DATES" if end <= start else "VEHICLE_UNAVAILABLE" if clash else "CUSTOMER_NOT_FOUND" if who == 2
                  else "PROMO_LIMIT_REACHED" if code and not left[code] else None)
        want[i] = reason
        if not reason:
            spans.setdefault(vehicle, []).append((start, end))
            if code:
                left[code] -= 1
    assert left == {"A": 0, "B": 0, "C": 0}
    got = Q.decide_reservations(requests, existing, people, rates(spark), promos, datetime(2024, 6, 1), "id", fold_rows)
    assert dict(rows(got, "id", "reason")) == want


def test_chained_bookings_of_one_vehicle(spark):
    asked = [(i, 1, D0 + timedelta(days=3 * i), D0 + timedelta(days=3 * i + 2), True) for i in range(3000)]
    got = Q.clash_flags(spark.createDataFrame(asked, SCHEMA), spark.createDataFrame([], "vehicle_id long, pickup_date date, dropoff_date date"), "id", 2)
    assert got.where("clash").count() == 0 and got.count() == 3000


def test_listings_are_ordered(spark):
    people = spark.createDataFrame(
        [(3, "Bo", "Zed"), (1, "Al", "Zed"), (2, "Cy", "Ash"), (4, "Al", "Zed")], "customer_id long, first_name string, last_name string").selectExpr(
        "*", "'e' email", "'l' license_number", "date '2030-01-01' license_expiry", "date '1990-01-01' date_of_birth", "0L loyalty_points", "'Y' is_active")
    assert [r.customer_id for r in L.list_customers(people, datetime(2024, 1, 1)).collect()] == [2, 1, 4, 3]
    assert [r.customer_id for r in L.search_customers(people, "ZED", datetime(2024, 1, 1)).collect()] == [1, 4, 3]


@pytest.mark.parametrize("sweep_days, sweep_rows", [(7, 100), (7, 9), (1000, 20)])
def test_the_sweep_takes_more_tasks_for_more_rows(spark, sweep_days, sweep_rows):
    asked, held = bookings(150, 6, 21), bookings(120, 6, 22)
    asked += [(900, None, D0, D0 + timedelta(3), True), (901, 77, D0, D0 + timedelta(3), True), (902, 1, None, D0, True)]
    held += [(910, None, D0, D0 + timedelta(3), True), (911, 2, None, D0, True)]
    want = {i: any(v is not None and v == vehicle and s is not None and None not in (start, end) and s < e and start < end and s < end and e > start for _, v, s, e, _ in held)
            for i, vehicle, start, end, _ in asked}
    stored = spark.createDataFrame(held, SCHEMA).select("vehicle_id", F.col("pickup_date").alias("s"), F.col("dropoff_date").alias("e"))
    got = O.with_blocked(spark.createDataFrame(asked, SCHEMA), stored, "vehicle_id", "pickup_date", "dropoff_date", "s", "e", sweep_days, sweep_rows)
    assert dict(rows(got, "id", "blocked")) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    swept = sum(None not in x[1:4] and x[2] < x[3] for x in asked) + sum(None not in x[1:4] and x[2] < x[3] for x in held)
    tasks = -(-swept // sweep_rows)
    assert f", {tasks}), REPARTITION_BY_NUM" in plan and "SortAggregate" not in plan
