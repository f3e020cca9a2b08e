"""Every registered query against DuckDB, and on empty tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from motorlot.plans.catalog import all_queries
from motorlot.plans.check_sql import all_texts
from motorlot.sources.schemas import STORED
from tools.compare import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
QUERIES, TEXTS = all_queries(), all_texts()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


@pytest.fixture(scope="module")
def empty_folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for table, schema in STORED.items():
        spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


def test_every_query_has_a_text_and_is_registered():
    assert set(QUERIES) == set(TEXTS)
    assert set(QUERIES) <= set(entry_points.queries()) and set(TEXTS) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    result = duck.execute(TEXTS[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_folder, name):
    QUERIES[name](spark, empty_folder).collect()


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
