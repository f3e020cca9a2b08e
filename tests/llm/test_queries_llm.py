"""Registered queries of the subpackage: check texts, schemas, empty tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from motorlot.llm import catalog
from tools.compare import rows_of

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


def checked(spark, folder, name):
    duck = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        duck.execute(f"create view {t} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    df = catalog.queries()[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    done = duck.execute(catalog.oracle_sql()[name])
    return got, rows_of([c[0] for c in done.description], done.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_check_text(spark, folder, name):
    got, expected = checked(spark, folder, name)
    assert got == expected and got


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    target = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{target}/{t}.parquet")
    return str(target)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_empty_tables(spark, folder, empty, name):
    df = catalog.queries()[name](spark, empty)
    assert df.collect() == []


def test_pipeline_is_registered():
    assert {"pipeline", *catalog.queries()} <= entry_points.queries().keys()
