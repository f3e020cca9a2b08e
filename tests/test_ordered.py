import random

import pytest
from pyspark.sql import functions as F

from motorlot.operators.changes import assign_keys, versions
from motorlot.operators.ordered import ntile, ordered_scan, range_cuts, with_ranges

random.seed(3)
# A third of the rows share one group and one order value; both also hold nulls.
ROWS = [(i, random.choice([1, 1, 1, 2, 3, None]), random.choice([5, 5, 5, 1, 2, None, 8]), random.choice([None, 1, 2, 3]))
        for i in range(400)]
NEAR = {
    "prev": lambda w: F.lag("v", 1, 0).over(w), "next": lambda w: F.lead("v", 1, 0).over(w),
    "recent": lambda w: F.sum("v").over(w.rowsBetween(-6, 0)), "ahead": lambda w: F.count("v").over(w.rowsBetween(1, 3)),
}


@pytest.mark.parametrize("group", [[], ["p"]])
@pytest.mark.parametrize("ranges", [1, 2, 7, 90])
def test_ranges_equal_plain_window(spark, group, ranges):
    df = spark.createDataFrame(ROWS, "id long, p int, o int, v int").repartition(5)
    options = dict(order=["o"], tie=["id"], partition=group, sums=["v"], edges=["v"], neighbours=NEAR, reach=6)
    plain = ordered_scan(df, **options).withColumn("tile", ntile(7))
    split = ordered_scan(df, **options, task_rows=0, ranges=ranges, costly=True).withColumn("tile", ntile(7))
    columns = sorted(plain.columns)
    assert sorted(map(str, plain.select(columns).collect())) == sorted(map(str, split.select(columns).collect()))


def test_hot_value_is_split(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("o"))
    sizes = [r["count"] for r in with_ranges(df, ["o", "id"], 3000, 10).groupBy("_range").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 1000


def test_cuts_of_small_inputs(spark):
    assert range_cuts(spark.range(0), ["id"], 0, 4) == []
    assert range_cuts(spark.range(1), ["id"], 1, 4) == []


def test_keys_are_dense(spark):
    df = spark.range(50).select(F.col("id"), (F.col("id") % 4).alias("o"))
    for options in ({}, {"task_rows": 0, "ranges": 6}):
        keys = [r.k for r in assign_keys(df, ["o", "id"], "k", 101, **options).orderBy("o", "id").collect()]
        assert keys == list(range(101, 151))


def test_versions_across_ranges(spark):
    df = spark.createDataFrame([(1 if i % 3 else 2, i, "UPDATE", i) for i in range(120)], "k long, seq long, operation string, x long")
    df = df.withColumn("changed_at", F.timestamp_seconds(F.col("seq") * 60).cast("timestamp_ntz"))
    from datetime import datetime
    span = (datetime(1970, 1, 1), datetime(1970, 1, 1, 1))
    plain, split = (sorted(map(str, versions(df, "k", *span, ["x"], task_rows=n).collect())) for n in (1000, 0))
    assert plain == split and len(plain) == 61


def test_both_ways_have_one_schema(spark):
    df = spark.createDataFrame([(i, i % 3, i) for i in range(50)], "id long, g long, n long").selectExpr("id", "g", "n", "cast(n as decimal(10,2)) d", "cast(n as double) f")
    plain, ranged = (ordered_scan(df, ["n"], ["id"], ["g"], sums=["n", "d", "f"], edges=["d"], task_rows=size) for size in (1000, 5))
    assert [(f.name, f.dataType) for f in plain.schema] == [(f.name, f.dataType) for f in ranged.schema]
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, ranged.collect()))
