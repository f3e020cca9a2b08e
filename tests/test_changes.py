from datetime import datetime

import pytest
import seed
from pyspark.sql import functions as F
from seed import rows

from motorlot.operators import changes as J, checks as C


def frame(spark, data, schema="id long, v string, w long"):
    return spark.createDataFrame(data, schema)


def test_upsert(spark):
    old = frame(spark, [(1, "a", 1), (2, "b", 2)])
    new = frame(spark, [(2, None, 9), (3, "c", 3)])
    assert rows(J.merge_upsert(old, new, ["id"])) == [(1, "a", 1), (2, None, 9), (3, "c", 3)]
    assert rows(J.merge_upsert(old, new, ["id"], {"w": F.lit(7).cast("long")})) == [(1, "a", 1), (2, None, 7), (3, "c", 7)]


def test_upsert_refuses_repeated_source_keys(spark):
    with pytest.raises(Exception, match="repeated source key"):
        J.merge_upsert(frame(spark, [(2, "b", 2)]), frame(spark, [(2, "x", 1), (2, "y", 1)]), ["id"]).collect()


def test_the_last_of_several_updates_wins(spark):
    sent = frame(spark, [(1, "late", 2), (1, "early", 1), (9, "x", 0), (9, "y", 1)])
    after, unknown = J.apply_updates(frame(spark, [(1, "a", 1), (2, "b", 2)]), sent, "id", ["v"], ["w"])
    assert rows(after) == [(1, "late", 1), (2, "b", 2)] and rows(unknown, "id") == [(9,), (9,)]


def test_number_text_keeps_whole_numbers(spark):
    df = frame(spark, [(100, "", 0)]).selectExpr("id", "cast(id as decimal(9,2)) d", "cast(0.50 as decimal(9,2)) h", "cast(null as int) n", "cast(1000.25 as decimal(9,2)) q")
    assert df.select(*[J.number_text(F.col(c)) for c in df.columns]).first()[:] == ("100", "100", "0.5", None, "1000.25")


def test_updates_set_nulls_and_report_unknown_keys(spark):
    after, unknown = J.apply_updates(frame(spark, [(1, "a", 1), (2, "b", 2)]), frame(spark, [(1, None, 5), (9, "x", 0)]), "id", ["v"])
    assert rows(after) == [(1, None, 1), (2, "b", 2)] and rows(unknown, "id") == [(9,)]


def test_deletes(spark):
    data = spark.createDataFrame([(1, "ACTIVE"), (2, "COMPLETED"), (3, None), (4, "DISPUTED")], "id long, status string")
    ids = spark.createDataFrame([(1,), (2,), (3,), (8,)], "id long")
    left, refused = J.delete_rentals(data, ids, "id")
    assert rows(left, "id") == [(1,), (4,)] and rows(refused, "id") == [(1,)]
    assert rows(J.delete_ids(data, ids, "id"), "id") == [(4,)]


def test_purge_keeps_the_cutoff(spark):
    log = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2023, 12, 31, 23, 59)), (3, None)], "id long, changed_at timestamp_ntz")
    assert rows(J.purge(log, datetime(2024, 3, 31), 90), "id") == [(1,), (3,)]


PAY = "payment_id long, amount decimal(10,2), payment_method string, status string"


def test_diff_replay_and_audit_text(spark):
    D = seed.D
    old = spark.createDataFrame([(1, D("10.00"), "CASH", "PENDING"), (2, D("5.50"), "CASH", "PENDING"), (3, D("7"), None, None)], PAY)
    new = spark.createDataFrame([(1, D("10.00"), "CASH", "COMPLETED"), (3, D("7"), None, None), (4, D("0.25"), "CREDIT_CARD", "PENDING")], PAY)
    changes = J.snapshot_diff(old, new, "payment_id")
    # Applying the changes to the old snapshot gives the new one.
    gone = changes.where("operation = 'DELETE'").select("payment_id")
    put = changes.where("operation != 'DELETE'").select("new.*")
    assert rows(J.merge_upsert(J.delete_ids(old, gone, "payment_id"), put, ["payment_id"])) == rows(new)
    assert rows(J.payment_audit(changes), "operation", "record_id", "old_values", "new_values") == [
        ("DELETE", 2, "amount=5.5,method=CASH", None),
        ("INSERT", 4, None, "amount=0.25,method=CREDIT_CARD,status=PENDING"),
        ("UPDATE", 1, "amount=10,status=PENDING", "amount=10,status=COMPLETED"),
    ]


def test_vehicle_events(spark):
    cars = spark.createDataFrame([(1, "AVAILABLE", 10), (2, "RENTED", 20), (3, "AVAILABLE", 30)], "vehicle_id long, status string, mileage long")
    t = datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [(1, t, "START", "a", None), (1, t, "COMPLETE", "b", 99), (2, t, "COMPLETE", "c", None), (3, t, "MAINTENANCE", "d", None)],
        "vehicle_id long, happened_at timestamp_ntz, event string, seq string, odometer long")
    assert rows(J.apply_vehicle_events(cars, events)) == [(1, "AVAILABLE", 99), (2, "AVAILABLE", 20), (3, "MAINTENANCE", 30)]


def test_points_and_usage(spark):
    people = spark.createDataFrame([(1001, 450), (1002, None), (9, 0)], "customer_id long, loyalty_points long")
    got = rows(J.award_points(people, seed.rentals(spark)), "customer_id", "loyalty_points", "tier")
    assert got == [(1001, 1035, "SILVER"), (1002, None, "PLATINUM"), (9, 0, "BRONZE")]
    uses = spark.createDataFrame([("FLAT50",), ("FLAT50",), (None,), ("GHOST",)], "promo_code string")
    assert dict(rows(J.bump_usage(seed.promos(spark), uses), "promo_code", "current_uses")) == {"FLAT50": 2, "SUMMER24": 0, "LOYALTY15": 0, "SPENT": 2}


def test_history(spark):
    t = [datetime(2024, 1, d) for d in range(1, 6)]
    log = spark.createDataFrame(
        [(1, 1, t[0], "INSERT", "a"), (1, 2, t[2], "UPDATE", "b"), (1, 3, t[2], "UPDATE", "c"), (2, 4, t[0], "INSERT", "x"), (2, 5, t[1], "DELETE", "x")],
        "k long, seq long, changed_at timestamp_ntz, operation string, v string")
    assert rows(J.as_of(log, t[0], "k", ["v"]), "k", "v") == [(1, "a"), (2, "x")]
    assert rows(J.as_of(log, t[3], "k", ["v"]), "k", "v") == [(1, "c")]
    got = rows(J.versions(log, "k", t[0], t[4], ["v"]), "k", "v", "version_end", "version_operation")
    assert got == sorted([(1, "a", t[2], "I"), (1, "b", t[2], "U"), (1, "c", None, "U"), (2, "x", None, "D"), (2, "x", t[1], "I")], key=repr)


def test_checks(spark):
    df = spark.createDataFrame([(1, 5, "long name"), (2, None, "ok"), (2, 50, None)], "id long, n long, s string")
    broken = C.check_rules(df, {"range": C.within("n", 0, 10), "size": C.at_most_long("s", 4), "there": C.present("s")}, ["id"])
    assert rows(broken) == [(1, "size"), (2, "range"), (2, "there")]
    assert rows(C.check_unique(df, ["id"])) == [(2, 2)]
    assert rows(C.orphans(df, spark.createDataFrame([(1,)], "id long"), "id", "id")) == [(2, 2)]
