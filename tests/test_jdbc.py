"""JDBC reads, short of a database: how a table is cut and what Spark is asked for."""

import collections
import functools
from unittest import mock

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableloom.sources import key_range_predicates, read_jdbc, read_jdbc_by_key, rows_to_frame
from tableloom.sources import jdbc


def hits(frame, predicates):
    """For each row, the number of predicates it meets; and the rows each predicate takes."""
    flags = [F.expr(p).cast("int") for p in predicates]
    flags = [F.coalesce(flag, F.lit(0)) for flag in flags]
    met = frame.select(F.array(*flags).alias("met"))
    per_row = collections.Counter(sum(row.met) for row in met.collect())
    per_predicate = [sum(column) for column in zip(*(row.met for row in met.collect()))]
    return per_row, per_predicate


def test_ranges_cover_given_table(spark, tables):
    part = spark.read.parquet(f"{tables}/part.parquet")
    low, high = part.agg(F.min("p_partkey"), F.max("p_partkey")).first()
    predicates = key_range_predicates("p_partkey", low, high + 1, 10)
    per_row, per_predicate = hits(part, predicates)
    assert per_row == {1: part.count()}
    assert max(per_predicate) - min(per_predicate) <= 1


def test_keys_beyond_the_bounds_and_nulls_are_kept(spark):
    keys = rows_to_frame(spark, [(k,) for k in (-50, 0, 5, 9, 10, 999, None)], "k bigint")
    per_row, per_predicate = hits(keys, key_range_predicates("k", 0, 10, 4))
    assert per_row == {1: 7}
    assert len(per_predicate) == 4


def test_a_hot_key_is_split_again(spark):
    rows = [(7, i) for i in range(300)] + [(i, i) for i in range(600)] + [(7, None), (None, 1)]
    frame = rows_to_frame(spark, rows, "k bigint, line bigint")
    predicates = key_range_predicates(
        "k", 0, 600, 6, hot_keys={7: 5}, spread_column="line"
    )
    per_row, per_predicate = hits(frame, predicates)
    assert per_row == {1: len(rows)}
    assert max(per_predicate) <= 101


@settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    keys=st.lists(st.one_of(st.none(), st.integers(-20, 40)), min_size=1, max_size=40),
    low=st.integers(-10, 10),
    width=st.integers(0, 30),
    parts=st.integers(1, 9),
    hot=st.dictionaries(st.integers(-20, 40), st.integers(1, 4), max_size=3),
)
def test_every_row_meets_exactly_one_predicate(spark, keys, low, width, parts, hot):
    frame = rows_to_frame(spark, list(zip(keys, range(-5, len(keys)))), "k bigint, v bigint")
    predicates = key_range_predicates(
        "k", low, low + width, parts, hot_keys=hot, spread_column="v"
    )
    per_row, _ = hits(frame, predicates)
    assert per_row == {1: len(keys)}


def test_bad_ranges():
    with pytest.raises(ValueError):
        key_range_predicates("k", 0, 10, 0)
    with pytest.raises(ValueError):
        key_range_predicates("k", 10, 0, 2)
    with pytest.raises(ValueError):
        key_range_predicates("k", 0, 10, 2, hot_keys={1: 2})


PROPERTIES = {"driver": "some.Driver", "user": "reader"}


def test_what_the_reader_is_asked_for():
    session = mock.Mock()
    read_jdbc(session, "jdbc:x", "drinks", PROPERTIES)
    session.read.jdbc.assert_called_with("jdbc:x", "drinks", properties=PROPERTIES)
    read_jdbc(session, "jdbc:x", "drinks", PROPERTIES, predicates=["k < 1", "k >= 1"])
    session.read.jdbc.assert_called_with(
        "jdbc:x", "drinks", predicates=["k < 1", "k >= 1"], properties=PROPERTIES
    )
    read_jdbc_by_key(
        session, "jdbc:x", "t", PROPERTIES, column="k", num_partitions=10, lower=1, upper=100
    )
    session.read.jdbc.assert_called_with(
        "jdbc:x",
        "t",
        column="k",
        lowerBound=1,
        upperBound=100,
        numPartitions=10,
        properties=PROPERTIES,
    )


@pytest.fixture
def database(spark):
    """Answers with the SQL a database would get, run on views of this session instead."""

    def answer(url, table, properties, predicates=("true",)):
        parts = [spark.sql(f"SELECT * FROM {table} WHERE {p}") for p in predicates]
        return functools.reduce(lambda left, right: left.union(right), parts)

    session = mock.Mock()
    session.read.jdbc.side_effect = answer
    return session


def test_bounds_and_predicates_as_sql(spark, tables, database):
    spark.read.parquet(f"{tables}/part.parquet").createOrReplaceTempView("jdbc_part")
    low, high = jdbc.key_bounds(database, "jdbc:x", "jdbc_part", PROPERTIES, "p_partkey")
    whole = read_jdbc(database, "jdbc:x", "jdbc_part", PROPERTIES)
    assert (low, high) == whole.agg(F.min("p_partkey"), F.max("p_partkey")).first()[:]
    pieces = read_jdbc(
        database,
        "jdbc:x",
        "jdbc_part",
        PROPERTIES,
        predicates=key_range_predicates("p_partkey", low, high + 1, 7),
    )
    assert sorted(map(tuple, pieces.collect())) == sorted(map(tuple, whole.collect()))
    empty = "(SELECT * FROM jdbc_part WHERE false) nothing"
    assert jdbc.key_bounds(database, "jdbc:x", empty, PROPERTIES, "p_partkey") is None


def test_a_table_with_a_hot_key_as_sql(spark, tables, database):
    lines = spark.read.parquet(f"{tables}/lineitem.parquet").withColumn(
        "l_suppkey", F.when(F.col("l_orderkey") % 3 == 0, 4).otherwise(F.col("l_partkey"))
    )
    lines.createOrReplaceTempView("jdbc_lines")
    rows = lines.count()
    hot = jdbc.frequent_keys(database, "jdbc:x", "jdbc_lines", PROPERTIES, "l_suppkey", 10)
    assert set(hot) == {4} and hot[4] == 4
    read = read_jdbc_by_key(
        database,
        "jdbc:x",
        "jdbc_lines",
        PROPERTIES,
        column="l_suppkey",
        num_partitions=10,
        spread_column="l_orderkey",
    )
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, lines.collect()))
    predicates = database.read.jdbc.call_args.kwargs["predicates"]
    assert len(predicates) == 24  # ten of them for rows without a key
    per_row, per_predicate = hits(lines, predicates)
    assert per_row == {1: rows}
    assert max(per_predicate) < rows / 6
    none_hot = jdbc.frequent_keys(database, "jdbc:x", "jdbc_part", PROPERTIES, "p_partkey", 10)
    assert none_hot == {}


def test_bounds_come_from_the_table():
    session = mock.Mock()
    with mock.patch.object(jdbc, "key_bounds", return_value=(5, 2004)):
        read_jdbc_by_key(session, "jdbc:x", "t", PROPERTIES, column="k", num_partitions=4)
    asked = session.read.jdbc.call_args.kwargs
    assert (asked["lowerBound"], asked["upperBound"]) == (5, 2005)
    with mock.patch.object(jdbc, "key_bounds", return_value=None):
        read_jdbc_by_key(session, "jdbc:x", "t", PROPERTIES, column="k", num_partitions=4)
    session.read.jdbc.assert_called_with("jdbc:x", "t", properties=PROPERTIES)
