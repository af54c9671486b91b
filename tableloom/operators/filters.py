"""Filters, subquery filters and value edits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _own(name: str) -> Column:
    """A column by its name as it is, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def where_equal(df: DataFrame, **values: object) -> DataFrame:
    """Rows where each named column has the given value (all must hold)."""
    for name, value in values.items():
        df = df.where(_own(name) == F.lit(value))
    return df


def where_in(df: DataFrame, column: str, keys: DataFrame, *, unique: bool = False) -> DataFrame:
    """Rows whose ``column`` occurs in the single column of ``keys``.

    Planned as a left semi join: each row at most once, however often its key is
    listed. Catalyst broadcasts ``keys`` when their size is below the session's
    threshold and shuffles both sides otherwise. Then neither side's frequent
    values pile up in one task:

    - keys are made distinct, each task dropping its own repeats before the
      shuffle; say ``unique`` for a key column that has none, to skip this (if it has
      some after all, only time is lost);
    - rows and keys that are NULL, which match nothing, are dropped in the scan;
    - a frequent value of ``column`` is cut into several tasks by adaptive
      skew-join handling. It needs both shuffles right under the join, so the keys
      are made distinct under a second, different partitioning.
    """
    key = _own(keys.columns[0])
    keys = keys.where(key.isNotNull())
    if not unique:
        mark = "_hash" if keys.columns[0].lower() == "__hash" else "__hash"
        keys = keys.select(key, F.xxhash64(key).alias(mark)).distinct().select(key)
    return df.where(_own(column).isNotNull() & _own(column).isin(keys))


def where_scalar(df: DataFrame, column: str, one_row: DataFrame) -> DataFrame:
    """Rows whose ``column`` equals the value of a one-row, one-column frame.

    The subquery runs once. No row means nothing is equal; more than one is an
    error at run time.
    """
    return df.where(_own(column) == one_row.scalar())


def replace_values(
    df: DataFrame, values: Mapping[object, object], subset: Sequence[str]
) -> DataFrame:
    """Exact values replaced in the listed columns only; others are untouched."""
    return df.replace(dict(values), subset=list(subset))
