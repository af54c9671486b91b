"""Union, replication, limits and redistribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_by_name(*frames: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Rows of all frames, columns matched by name, duplicates kept, nothing shuffled.

    A column missing on one side is an error unless ``allow_missing`` fills it with
    NULL. For sides with different types conform them to one schema first.
    """
    return reduce(
        lambda left, right: left.unionByName(right, allowMissingColumns=allow_missing), frames
    )


def union_rows(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, columns matched by position, duplicates kept."""
    return reduce(DataFrame.union, frames)


def replicate(df: DataFrame, copies: int, spread_to: int | None = None) -> DataFrame:
    """Every row ``copies`` times.

    Each task repeats the rows it reads: one scan, no shuffle, and a plan of the
    same size for any number of copies, unlike a union of the frame with itself.
    An input with fewer partitions than the cluster has cores can be dealt out to
    ``spread_to`` tasks first, while it is still small.
    """
    if copies < 0:
        raise ValueError("copies must not be negative")
    if spread_to is not None:
        df = df.repartition(spread_to)
    name = "copy"
    while name.lower() in (column.lower() for column in df.columns):
        name = "_" + name
    repeated = F.explode(F.array_repeat(F.lit(0), copies)).alias(name)
    return df.select("*", repeated).drop(name)


def first_rows(df: DataFrame, count: int, *order: Column | str) -> DataFrame:
    """The first rows in a given order: each task keeps at most ``count`` of them.

    Without an order it is any ``count`` rows, which is not repeatable.
    """
    return (df.orderBy(*order) if order else df).limit(count)


def spread(df: DataFrame, partitions: int) -> DataFrame:
    """The rows dealt out evenly to ``partitions`` tasks, whatever their values are."""
    return df.repartition(partitions)
