"""Digest comparison, stored timelines, trigram search, refreshed months, distinct customers."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from seed import rows

from motorlot.operators import changes as J, digests, trigrams
from motorlot.plans import lookups as L, reports as R
from motorlot.sources import adapter as A, lookup_store, sinks as K, timeline
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def sides(spark, count=20_000):
    old = spark.range(count).selectExpr("id", "cast(id % 97 as string) as a", "if(id % 5 = 0, null, id) as b")
    new = old.where("id != 77").withColumn("b", F.when(F.col("id") == 1234, F.lit(None)).otherwise(F.col("b"))).union(
        spark.createDataFrame([(count + 5, "x", None)], "id long, a string, b long"))
    return old, new


def test_digest_diff_equals_the_full_join(spark):
    old, new = sides(spark)
    for leaves, fan in ((16384, 128), (8, 4), (1, 1)):
        assert rows(digests.digest_diff(old, new, "id", leaves, fan)) == rows(J.snapshot_diff(old, new, "id"))
    assert digests.digest_diff(old, old, "id").count() == 0
    assert digests.digest_diff(old.limit(0), old, "id").count() == old.count()
    assert digests.digest_diff(old.limit(0), old.limit(0), "id").count() == 0


def test_only_changed_leaves_are_joined(spark):
    old, new = sides(spark, 200_000)
    changed = digests.changed_leaves(old, new, "id", 1024, 32)
    assert changed.count() == 3
    joined = digests.rows_in(old, "id", changed, 1024).count() + digests.rows_in(new, "id", changed, 1024).count()
    assert joined < 0.01 * (old.count() + new.count())


def test_a_null_moved_to_its_neighbour_is_a_change(spark):
    schema = "id long, a string, b string"
    old, new = spark.createDataFrame([(1, "x", None)], schema), spark.createDataFrame([(1, None, "x")], schema)
    assert digests.digest_diff(old, new, "id").count() == 1


HISTORY = "row_key long, seq long, changed_at timestamp_ntz, operation string, state string"


def history(spark, seed_number=3):
    draw, start = random.Random(seed_number), datetime(2024, 1, 1)
    items = []
    for seq in range(600):
        key = 1 if draw.random() < 0.3 else draw.randrange(2, 40)
        moment = start + timedelta(hours=6 * draw.randrange(0, 240))
        items.append((key, seq, moment, draw.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"]), f"s{draw.randrange(9)}"))
    return spark.createDataFrame(items, HISTORY)


def test_stored_timeline_gives_every_past_state(spark, tmp_path):
    path, h = str(tmp_path / "t"), history(spark)
    timeline.write_timeline(h, path, "row_key", ["state"], days=7)
    first = timeline.period_start((date(2024, 1, 20) - timeline.EPOCH).days // 7)
    for moment in (datetime(2023, 12, 1), datetime(2024, 1, 3, 5), datetime(first.year, first.month, first.day), datetime(2024, 1, 20, 6), datetime(2024, 2, 28), datetime(2025, 1, 1)):
        got = timeline.stored_as_of(spark, path, h.schema, moment, "row_key", ["state"], days=7)
        assert rows(got) == rows(J.as_of(h, moment, "row_key", ["state"]))


def test_other_periods_are_not_opened(spark, tmp_path):
    path, h, moment = tmp_path / "t", history(spark), datetime(2024, 1, 20, 6)
    timeline.write_timeline(h, str(path), "row_key", ["state"], days=7)
    period, spoilt = (moment.date() - timeline.EPOCH).days // 7, 0
    for folder in [*path.glob("*/period=*")]:
        if folder.name != f"period={period}":
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"no parquet")
                spoilt += 1
            for checksum in folder.glob(".*.crc"):
                checksum.unlink()
    assert spoilt > 3
    assert rows(timeline.stored_as_of(spark, str(path), h.schema, moment, "row_key", ["state"], days=7)) == rows(J.as_of(h, moment, "row_key", ["state"]))


def test_empty_timeline(spark, tmp_path):
    h = history(spark).limit(0)
    timeline.write_timeline(h, str(tmp_path / "t"), "row_key", ["state"])
    assert timeline.stored_as_of(spark, str(tmp_path / "t"), h.schema, datetime(2024, 1, 1), "row_key", ["state"]).count() == 0


@pytest.mark.parametrize("keyword", ["0001", "an", "", "AMBER", "zzzz", "aaaa", "ñand", "a b"])
def test_indexed_search_finds_what_a_scan_finds(spark, tmp_path, keyword):
    items = [(1, "Amber Lane", None), (2, "BAMBERG", "aaa"), (3, None, None), (4, "x", "y"), (5, "caaaat", "0001"), (6, "Ñandú", "a b c"), (7, "aaa", "aab")]
    items += [(10 + i, f"common word {i}", None) for i in range(300)]
    table = spark.createDataFrame(items, "id long, name string, code string")
    columns = [F.col("name"), F.col("code")]
    trigrams.write_index(table, "id", columns, str(tmp_path / "index"))
    found = trigrams.indexed(table, "id", str(tmp_path / "index"), keyword)
    test = L.matches(columns, keyword)
    assert rows(found.where(test)) == rows(table.where(test))
    if len(keyword) > 2:
        assert found.count() <= 3


def test_only_touched_months_are_rewritten(spark, tmp_path):
    path = tmp_path / "months"
    rentals = spark.createDataFrame(
        [(datetime(2024, m, d), Decimal(10 * m + d), "COMPLETED") for m in range(1, 7) for d in (3, 9)], "actual_dropoff timestamp_ntz, total_charge decimal(10,2), status string")
    K.write_revenue_months(rentals, str(path))

    def files():
        return {f.parent.name: f.name for f in path.glob("month=*/*.parquet")}

    before = files()
    march, june = F.month("actual_dropoff") == 3, F.month("actual_dropoff") == 6
    after = rentals.where(~june).withColumn("total_charge", F.when(march, F.lit(1)).otherwise(F.col("total_charge")).cast("decimal(10,2)"))
    K.refresh_revenue_months(after, rentals.where(march | june).union(after.where(march)), str(path))
    changed = {name for name, file in files().items() if before[name] != file}
    assert changed == {"month=2024-03", "month=2024-06"}
    got = K.read_revenue_months(rentals, str(path))
    assert rows(got) == rows(R.monthly_summary(after).select(*got.columns))


def test_distinct_customers_do_not_add_up(spark):
    rentals = spark.createDataFrame(
        [(c, v, 1, datetime(2024, m, 1), "COMPLETED") for c in (1, 2, 40_000, 900_000_000) for v in (1, 2) for m in (1, 2)] + [(None, 1, 1, datetime(2024, 1, 1), "COMPLETED"), (9, 1, 1, datetime(2024, 1, 1), "ACTIVE")],
        "customer_id long, vehicle_id long, pickup_location long, actual_dropoff timestamp_ntz, status string")
    cars = spark.createDataFrame([(1, "SUV"), (2, "Van")], "vehicle_id long, category_name string")
    places = spark.createDataFrame([(1, "Town")], "location_id long, location_name string")
    got = rows(R.customers_rollup(rentals, cars, places).select("level", "customers"))
    assert got == [(0, 4)] * 4 + [(1, 4)] * 2 + [(2, 4), (3, 4)]
    assert R.customers_rollup(rentals.limit(0), cars, places).count() == 0


def test_distinct_customers_are_counted_without_maps(spark):
    """Sparse maps of bits shrink in a shuffle and grow again in the sort of the task that merges them."""
    draw = random.Random(5)
    data = [(draw.choice([1, 1, 1, 2, 3, -4, 2**40, None]), draw.choice([1, 2, 3]), draw.choice([1, 2]), draw.choice([datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2025, 1, 3)]), "COMPLETED") for _ in range(400)]
    rentals = spark.createDataFrame(data, "customer_id long, vehicle_id long, pickup_location long, actual_dropoff timestamp_ntz, status string")
    cars, places = {1: "SUV", 2: "Van", 3: None}, {1: "Town", 2: "Port"}
    want = {}
    for customer, car, place, day, _ in data:
        if customer is not None:
            full = (places[place], cars[car], f"{day:%Y-%m}")
            for level in range(4):
                cell = full[:3 - level] + (None,) * level
                want.setdefault((level, "ALL LOCATIONS" if level == 3 else cell[0], "ALL CATEGORIES" if level >= 2 else cell[1], cell[2]), set()).add(customer)
    got = R.customers_rollup(rentals, spark.createDataFrame(list(cars.items()), "vehicle_id long, category_name string"), spark.createDataFrame(list(places.items()), "location_id long, location_name string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "bitmap" not in plan and "SortAggregate" not in plan
    counts = lambda found: sorted((level, place, str(kind), n) for level, place, kind, n in found)
    assert counts((r["level"], r["location"], r["category"], r["customers"]) for r in got.collect()) == counts((k[0], k[1], k[2], len(v)) for k, v in want.items())


def test_shallow_pages_are_top_rows(spark):
    rentals = R.completed(A.order_rentals(spark, DATA)).select("rental_id", "total_charge")
    top = R.numbered_page(rentals, "total_charge", "rental_id", 11, 20, task_rows=1)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
    limit, R.SHALLOW_ROWS = R.SHALLOW_ROWS, 5
    try:
        deep = R.numbered_page(rentals, "total_charge", "rental_id", 11, 20, task_rows=100)
        assert [tuple(r) for r in deep.collect()] == [tuple(r) for r in top.collect()] and top.count() == 10
    finally:
        R.SHALLOW_ROWS = limit


def rows_read(df):
    """Rows that the scan hands on: all rows of the row groups it opens."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.getClass().getName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookups_open_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "stored")
    table = spark.range(0, 200_000).selectExpr("id * 2 as id", "md5(cast(id as string)) as ref", "repeat(md5(cast(id + 7 as string)), 4) as load")
    lookup_store.write_lookup(table, "id", path, ("ref",), row_group_bytes=1 << 20)
    one, ref = lookup_store.lookup(spark, path, table.schema, "id", 5000), table.where("id = 9000").first()["ref"]
    assert rows(one) == rows(table.where("id = 5000")) and 0 < rows_read(one) <= 20_000
    assert rows_read(lookup_store.lookup(spark, path, table.schema, "id", 5001)) == 0
    by_ref = lookup_store.lookup(spark, path, table.schema, "ref", ref)
    assert rows(by_ref) == rows(table.where("id = 9000")) and rows_read(by_ref) <= 60_000
    assert rows_read(lookup_store.lookup(spark, path, table.schema, "ref", "0" * 32)) <= 20_000


def test_stored_columns_are_made_after_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "stored")
    table = spark.range(0, 20_000).selectExpr("id as n", "id % 7 as k")
    made = lambda rows: rows.selectExpr("n * 10 + k as id", "md5(cast(n as string)) as ref")
    lookup_store.write_lookup(table, "id", path, ("ref",), row_group_bytes=1 << 16, by=F.expr("n * 10 + k"), derived=made)
    want = made(table)
    assert rows(spark.read.parquet(path)) == rows(want)
    assert rows(lookup_store.lookup(spark, path, want.schema, "id", 50_000 + 5000 % 7)) == rows(want.where("ref = md5('5000')"))
    spans = sorted(tuple(r) for r in spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("id"), F.max("id")).select("min(id)", "max(id)").collect())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and len(spans) > 1


def test_rentals_are_the_same_from_narrow_rows(spark):
    booked = A.with_customer(A.rentals(spark, DATA), spark, DATA)
    made = A.rentals_of(A.lines_with_customer(spark, DATA), "customer_id").select(*booked.columns)
    assert made.dtypes == booked.dtypes and made.exceptAll(booked).isEmpty() and booked.exceptAll(made).isEmpty()
