"""Frames that come from the program itself."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def integer_range(spark: SparkSession, size: int, partitions: int | None = None) -> DataFrame:
    """The integers ``0 .. size-1`` as bigint ``id``, generated inside the tasks."""
    return spark.range(0, size, 1, partitions)


def rows_to_frame(
    spark: SparkSession, rows: Iterable[Sequence], schema: StructType | str
) -> DataFrame:
    """A few literal rows as a frame of the declared schema.

    For lookup rows a program spells out; bulk data belongs in a file or table. The
    rows become part of the plan, so Catalyst knows their size when it picks a join,
    and no Python worker starts. A row with more or fewer values than the schema has
    fields is an error.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    rows = list(rows)
    for number, row in enumerate(rows):
        if len(row) != len(schema):
            raise ValueError(f"row {number} has {len(row)} values, the schema {len(schema)}")
    values = [pa.array([row[i] for row in rows]) for i in range(len(schema))]
    return spark.createDataFrame(pa.table(values, names=schema.names), schema)
