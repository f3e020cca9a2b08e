from datetime import date, datetime
from decimal import Decimal

import pytest
import seed
from pyspark.sql import functions as F
from seed import rows

from motorlot.functions import scalar as S
from motorlot.operators.changes import apply_vehicle_events, payment_audit
from motorlot.plans.reports import monthly_summary
from motorlot.session import checkpointed
from motorlot.sources import adapter as A, loaders, sinks as K
from motorlot.sources.schemas import RENTAL_DOMAIN, STORED, schema_of
from motorlot.streaming import jobs


def test_schemas_parse():
    for table in [*STORED, *RENTAL_DOMAIN]:
        assert len(schema_of(table)) > 0


def test_partitioned_table(spark, tmp_path):
    path = str(tmp_path / "cars")
    cars = spark.createDataFrame([(i, 2010 + i % 16) for i in range(64)], "id long, model_year long")
    K.write_partitioned(cars, K.range_bucket("model_year"), path)
    assert {p.name for p in (tmp_path / "cars").iterdir() if p.is_dir()} == {f"bucket={b}" for b in ("legacy", "mid", "recent", "current")}
    schema = "id long, model_year long, bucket string"
    part = K.read_range(spark, path, schema, "model_year", 2016, 2021)
    assert rows(part) == rows(cars.where("model_year between 2016 and 2021"))
    plan = part._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: ["):].split("]")[0]
    assert "bucket" in filters and "mid" in filters and "recent" in filters and "legacy" not in filters
    read = {r[0].split("bucket=")[1].split("/")[0] for r in spark.read.schema(schema).parquet(path).where(F.col("bucket").isin("mid", "recent")).select(F.input_file_name()).distinct().collect()}
    assert read == {"mid", "recent"}
    assert K.buckets_between(2016, 2021) == ["mid", "recent"] and K.buckets_between(2024, 2030) == ["current"]


def test_refresh_overwrites(spark, tmp_path):
    path = str(tmp_path / "monthly")
    K.refresh_monthly_revenue(seed.rentals(spark).limit(1), path)
    stored = K.refresh_monthly_revenue(seed.rentals(spark), path)
    assert rows(stored, "revenue_month", "total_revenue") == rows(monthly_summary(seed.rentals(spark)), "revenue_month", "total_revenue")


def test_text_forms(spark):
    df = spark.createDataFrame([(1, "a<&\"b", None, datetime(2024, 1, 2, 3, 4, 5), date(2024, 1, 2))],
                               "id long, s string, n long, t timestamp_ntz, d date")
    got = df.select(K.xml_element("r", K.xml_element("s", K.xml_escaped(F.col("s"))), K.xml_element("n", K.xml_escaped(F.col("n"))),
                                  attributes={"id": F.col("id"), "q": F.col("s"), "x": F.col("n")}).alias("x")).first().x
    assert got == '<r id="1" q="a&lt;&amp;&quot;b"><s>a&lt;&amp;"b</s><n></n></r>'
    json = K.rows_to_json(df, {"id": "id", "n": "n", "t": "at", "d": "day"}).first().json
    assert json == '{"id":1,"n":null,"at":"2024-01-02 03:04:05","day":"2024-01-02"}'
    flat = loaders.flat_json_map(spark.createDataFrame([('{"a": 1, "b": null, "c": "x"}',), ("",), (None,)], "j string"), "j", "m")
    assert [r.m for r in flat.collect()][0] == {"a": "1", "c": "x"}


def test_samples(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(20000).coalesce(1).write.parquet(path)
    table = spark.read.parquet(path)
    blocks = K.sample_blocks(table, "id", 20, block_rows=500)
    ids = {r.id for r in blocks.collect()}
    assert 0 < len(ids) < 20000 and len(ids) % 500 == 0
    assert {i // 500 for i in ids} == {i // 500 for i in ids if i % 500 == 0}
    # The sample hangs on the key alone, not on files or tasks.
    assert rows(K.sample_rows(table, "id", 10, 7)) == rows(K.sample_rows(table.repartition(5), "id", 10, 7))
    assert 1700 < K.sample_rows(table, "id", 10, 7).count() < 2300


@pytest.mark.parametrize("day, months, want", [
    (date(2024, 2, 29), 1, date(2024, 3, 31)), (date(2024, 1, 31), 1, date(2024, 2, 29)), (date(2024, 1, 15), 1, date(2024, 2, 15)),
    (date(2023, 2, 28), 12, date(2024, 2, 29)),
])
def test_add_months(spark, day, months, want):
    df = spark.createDataFrame([(day,)], "d date")
    assert df.select(S.add_months(F.col("d"), months)).first()[0] == want


def test_null_rules(spark):
    df = spark.createDataFrame([(None, 5, "x"), (2, 1, None)], "a long, b long, s string")
    assert [r[0] for r in df.select(S.greatest_strict(F.col("a"), F.col("b"))).collect()] == [None, 2]
    assert [r[0] for r in df.select(S.text(F.col("s"), F.lit("-"))).collect()] == ["x-", "-"]
    assert [r[0] for r in df.select(S.decode(F.col("s"), {None: "none", "x": "ex"}, "else")).collect()] == ["ex", "none"]
    assert [r[0] for r in df.select(S.nth_position(F.lit("a-b-c"), "-", 2)).collect()] == [4, 4]
    assert [r[0] for r in df.select(S.nth_position(F.lit("a-b"), "-", 2)).collect()] == [0, 0]


def feed_in_batches(spark, folder, table, df, parts):
    """Write a table as several files and read it as one file per batch."""
    df.repartition(parts).write.parquet(f"{folder}/{table}_files")
    return (spark.readStream.schema(schema_of(table)).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{table}_files"))


def test_audit_stream_equals_its_batch(spark, tmp_path):
    orders = loaders.load(spark, "/root/testdata/sf0.001", "orders")
    changes = A.payment_changes_of(A.payments_of(feed_in_batches(spark, str(tmp_path), "orders", orders, 2)))
    path, want = str(tmp_path / "audit"), rows(payment_audit(A.payment_changes_of(A.payments_of(orders))))
    for _ in range(2):  # started again, the stream adds nothing
        jobs.stream_audit(changes, path).awaitTermination()
        assert rows(jobs.read_audit(spark, path)) == want


def test_vehicle_state_goes_on_after_a_restart(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    lines, cars = loaders.load(spark, data, "lineitem"), A.vehicles(spark, data).select("vehicle_id", "status", "mileage")
    folder, path = str(tmp_path / "lines"), str(tmp_path / "state")
    for k in range(3):
        # Events come in no order: the last state is not always in the last batch.
        lines.where(F.col("l_linenumber") % 3 == k).coalesce(1).write.mode("append").parquet(folder)
        jobs.stream_vehicle_state(A.vehicle_events_of(A.rentals_of(spark.readStream.schema(schema_of("lineitem")).parquet(folder))), path).awaitTermination()
        seen = A.vehicle_events_of(A.rentals_of(spark.read.schema(schema_of("lineitem")).parquet(folder)))
        assert rows(jobs.read_vehicle_state(spark, path, cars)) == rows(apply_vehicle_events(cars, seen))
    jobs.compact_vehicle_state(spark, path)
    assert spark.read.parquet(path).count() == lines.select("l_partkey").distinct().count()
    assert rows(jobs.read_vehicle_state(spark, path, cars)) == rows(apply_vehicle_events(cars, A.vehicle_events_of(A.rentals_of(lines))))
    # A batch run again gives the rows it gave before.
    last = spark.read.parquet(path).selectExpr("max(batch)").first()[0]
    again = spark.read.schema(jobs._state_schema("string")).parquet(path).where(F.col("batch") == last).drop("batch")
    checkpointed(again).write.mode("overwrite").parquet(f"{path}/batch={last}")
    assert jobs.vehicle_states(spark, path).count() == lines.select("l_partkey").distinct().count()
    assert spark.conf.get(jobs.PROVIDER, None) != jobs.ROCKSDB


def test_revenue_of_days_in_order(spark, tmp_path):
    lines = loaders.load(spark, "/root/testdata/sf0.001", "lineitem")
    folder, clock, path = str(tmp_path / "lines"), str(tmp_path / "clock"), str(tmp_path / "revenue")
    jobs.tick(spark, clock, datetime(1980, 1, 1))
    ends = [F.year("l_shipdate") < 1995, F.year("l_shipdate").between(1995, 1997), F.year("l_shipdate") > 1997, None]
    want = rows(monthly_summary(A.rentals_of(lines)))
    for part in ends:
        if part is None:
            assert rows(jobs.read_monthly_revenue(spark, path)) != want  # the last days are open
            jobs.tick(spark, clock, datetime(2100, 1, 1))
        else:
            lines.where(part).coalesce(1).write.mode("append").parquet(folder)
        feed = A.rentals_of(spark.readStream.schema(schema_of("lineitem")).parquet(folder))
        query = jobs.stream_monthly_revenue(feed, path, clock=clock)
        query.awaitTermination()
        assert jobs.late_rows(query) == 0
    assert rows(jobs.read_monthly_revenue(spark, path)) == want


def test_a_late_rental_is_dropped_and_counted(spark, tmp_path):
    def rental(day, status="COMPLETED", charge=10):
        return (datetime(2024, 1, day), Decimal(charge), status)

    schema = "actual_dropoff timestamp_ntz, total_charge decimal(10,2), status string"
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*items):
        spark.createDataFrame(items, schema).coalesce(1).write.mode("append").parquet(folder)
        query = jobs.stream_monthly_revenue(spark.readStream.schema(schema).parquet(folder), path, "2 days")
        query.awaitTermination()
        return jobs.late_rows(query), [(r.rental_count, int(r.total_revenue)) for r in jobs.read_monthly_revenue(spark, path).collect()]

    assert arrive(rental(1), rental(2), rental(5)) == (0, [(2, 20)])  # the 1st and 2nd are closed, the 5th is open
    assert arrive(rental(4, charge=7), rental(3)) == (0, [(2, 20)])  # in time
    assert arrive(rental(1, charge=99), rental(20, "ACTIVE")) == (1, [(5, 47)])  # too late; an open rental moves the time on
    assert arrive((None, Decimal(5), "COMPLETED")) == (0, [(5, 47)])


def test_stream_without_files(spark, tmp_path):
    assert jobs.read_audit(spark, str(tmp_path / "none")).count() == 0


def test_stream_reads_the_table_that_a_scan_reads(spark, tmp_path):
    folder, data = tmp_path / "in", "/root/testdata/sf0.001"
    nation = loaders.load(spark, data, "nation")
    nation.repartition(2).write.parquet(str(folder / "nation.parquet"))
    nation.coalesce(1).write.parquet(str(folder / "nation_old.parquet"))
    seen = []

    def run(source, name):
        query = loaders.load_stream(spark, str(source), "nation", 1).writeStream.foreachBatch(lambda batch, _: seen.append(batch.count()))
        query.option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()

    run(folder, "first")
    assert len(seen) == 2 and sum(seen) == loaders.load(spark, str(folder), "nation").count() == 25
    nation.limit(7).coalesce(1).write.mode("append").parquet(str(folder / "nation.parquet"))
    run(folder, "first")
    assert seen[2:] == [7]
    seen.clear()
    run(data, "single")
    assert seen == [25]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        loaders.load_stream(spark, str(tmp_path), "nation")
