"""JDBC table readers. Connection details always come from the caller."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    *,
    predicates: Sequence[str] | None = None,
) -> DataFrame:
    """Read a remote table; filters and column choice are pushed to the database.

    ``properties`` holds ``driver``, ``user``, ``password``, ``fetchsize`` and the
    like. One partition by default; with ``predicates``, one partition for each.
    """
    if predicates:
        return spark.read.jdbc(url, table, predicates=list(predicates), properties=properties)
    return spark.read.jdbc(url, table, properties=properties)


def key_bounds(
    spark: SparkSession, url: str, table: str, properties: dict[str, str], column: str
) -> tuple[int, int] | None:
    """Smallest and largest key, computed by the database; None for no keys."""
    bounds = read_jdbc(
        spark,
        url,
        f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}) key_bounds",
        properties,
    )
    low, high = bounds.first()
    return None if low is None else (int(low), int(high))


def frequent_keys(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    column: str,
    parts: int,
) -> dict[int, int]:
    """Keys with more than a fair share of the rows, counted by the database.

    A share is one of ``parts`` equal ones, so there are at most ``parts`` such keys.
    Each comes with the number of shares it fills.
    """
    counted = read_jdbc(
        spark,
        url,
        f"(SELECT {column} AS k, COUNT(*) AS n, (SELECT COUNT(*) FROM {table}) AS total"
        f" FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}"
        # Counts are 32-bit in some databases, and would overflow when multiplied.
        f" HAVING COUNT(*) > 1 AND CAST(COUNT(*) AS DECIMAL(38, 0)) * {parts}"
        f" > (SELECT COUNT(*) FROM {table}))"
        " frequent_keys",
        properties,
    )
    # By position: databases differ in the case of the names they give back.
    return {int(key): math.ceil(n * parts / total) for key, n, total in counted.collect()}


def read_jdbc_by_key(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    *,
    column: str,
    num_partitions: int,
    lower: int | None = None,
    upper: int | None = None,
    spread_column: str | None = None,
) -> DataFrame:
    """Read a remote table in ``num_partitions`` ranges of a numeric key.

    The bounds only set the width of the ranges and drop nothing: the first and
    last range take all keys beyond them, and NULL keys go to the first. Bounds
    far from the real keys therefore put most rows into one task, so they default
    to the smallest and largest key.

    A range is never narrower than one key. Where the key is not unique, name
    another integer column in ``spread_column``: keys with more than a fair share
    of the rows are then read in several parts, and rows without a key in
    ``num_partitions`` more, at most multiplying the partitions by four. No read from a
    live database has been run.
    """
    if lower is None or upper is None:
        found = key_bounds(spark, url, table, properties, column)
        if found is None:
            return read_jdbc(spark, url, table, properties)
        lower = found[0] if lower is None else lower
        upper = found[1] + 1 if upper is None else upper
    if spread_column is not None:
        hot = frequent_keys(spark, url, table, properties, column, num_partitions)
        predicates = key_range_predicates(
            column, lower, upper, num_partitions, hot_keys=hot, spread_column=spread_column
        )
        return read_jdbc(spark, url, table, properties, predicates=predicates)
    return spark.read.jdbc(
        url,
        table,
        column=column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=num_partitions,
        properties=properties,
    )


def key_range_predicates(
    column: str,
    lower: int,
    upper: int,
    parts: int,
    *,
    hot_keys: Mapping[int, int] | None = None,
    spread_column: str | None = None,
) -> list[str]:
    """WHERE clauses that split a table by key range, each row in exactly one.

    Rows of a key in ``hot_keys`` are cut a second time, into the given number of
    clauses by the remainder of ``spread_column``, so that no single task reads
    them all; with a ``spread_column``, rows without a key are cut into ``parts`` clauses.
    """
    hot_keys = dict(sorted((hot_keys or {}).items()))
    if parts < 1 or upper < lower:
        raise ValueError("need parts >= 1 and lower <= upper")
    if hot_keys and not spread_column:
        raise ValueError("hot_keys need a spread_column to be split by")
    cuts = sorted({lower + (upper - lower) * i // parts for i in range(1, parts)} - {lower})
    ranges = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        limits = [f"{column} IS NOT NULL"]
        limits += [f"{column} >= {low}"] if low is not None else []
        limits += [f"{column} < {high}"] if high is not None else []
        limits += [f"{column} NOT IN ({', '.join(map(str, hot_keys))})"] if hot_keys else []
        ranges.append(" AND ".join(limits))
    if spread_column:  # NULL keys may be many; their share is not known
        no_key = [
            f"{column} IS NULL AND COALESCE(ABS({spread_column} % {parts}), 0) = {way}"
            for way in range(parts)
        ]
    else:
        no_key = []
        ranges[0] = f"({ranges[0]}) OR {column} IS NULL"
    hot = [
        f"{column} = {key} AND COALESCE(ABS({spread_column} % {ways}), 0) = {way}"
        for key, ways in hot_keys.items()
        for way in range(ways)
    ]
    return ranges + hot + no_key
