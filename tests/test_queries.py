"""Every registered query against its SQL counterpart on the given tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from tableloom.plans.oracles import ORACLES
from tableloom.plans.queries import GIVEN_TABLES, QUERIES


@pytest.fixture(scope="module")
def sql(tables):
    connection = duckdb.connect()
    for name in GIVEN_TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet'")
    yield connection
    connection.close()


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def text(value):
        if value is None or value is pd.NaT or value != value:
            return "NULL"
        return str(value)

    columns = [[text(value) for value in frame[name].tolist()] for name in sorted(frame.columns)]
    return sorted(zip(*columns))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, tables, sql, name):
    ours = QUERIES[name](spark, tables).toPandas()
    theirs = sql.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_entry_points(spark):
    result = entry_points.entry(spark)
    assert result.columns[0] == "id"
    assert result.count() > 0
    assert set(entry_points.queries()) >= set(QUERIES)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
