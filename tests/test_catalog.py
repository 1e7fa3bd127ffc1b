"""Every query of the catalog against its SQL on the same tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from basketflow.plans.catalog import all_queries
from basketflow.plans.oracles import all_oracles

SF_DIR = "/root/testdata/sf0.01"
QUERIES = all_queries()


@pytest.fixture(scope="module")
def database():
    with duckdb.connect() as connection:
        for path in Path(SF_DIR).glob("*.parquet"):
            connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        yield connection


def test_every_query_has_sql():
    assert set(all_oracles()) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, database, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    result = database.execute(contract.oracle_sql()[name])
    found = [c[0] for c in result.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    wanted = Counter(tuple(row[i] for i in order) for row in result.fetchall())
    assert Counter(map(tuple, frame.select(columns).collect())) == wanted
    assert wanted


def test_flagship(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["minute", "total_sales", "total_transactions", "avg_transaction"]
    assert not frame.isEmpty()


def test_table_of_many_files(spark, tmp_path):
    """On a cluster the table is a folder; streams then take all its files at once."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("stream_aggregate_by_user", "stream_conversion_rate"):
        many = QUERIES[name](spark, str(tmp_path))
        one = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert many.exceptAll(one).isEmpty() and one.exceptAll(many).isEmpty()
        assert not one.isEmpty()
